"""The trial funnel: listens promote a file, silence warns and deletes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions import tolerance as T


def trailing_listens(listens: DataFrame, item: str, ts: str, now: Column, days: int = T.PROMOTE_DAYS) -> DataFrame:
    """Listens of each item in the last ``days`` days, and the last of all."""
    recent = F.col(ts) >= now - F.make_dt_interval(F.lit(days))
    return listens.groupBy(item).agg(F.count_if(recent).alias("recent"), F.max(ts).alias("last_listen"))


def promotions(listens: DataFrame, item: str, ts: str, now: Column, days: int = T.PROMOTE_DAYS, least: int = T.PROMOTE_LISTENS) -> DataFrame:
    """Items with ``least`` listens in the trailing window."""
    return trailing_listens(listens, item, ts, now, days).where(F.col("recent") >= least).select(item, "recent")


def trailing_counts(events: DataFrame, item: str, ts: str, days: int = T.PROMOTE_DAYS, out: str = "recent") -> DataFrame:
    """``events`` with ``out``: how many events the item has in the ``days`` days up to each of them, itself and those of the same time included.

    An item's events are divided into slices of ``days`` days; each slice also sees the one
    before it, and nothing else can count. So no task holds an item's whole history. Events
    without an item or a time are left out.
    """
    span = days * 86_400_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(F.col(item).isNotNull() & F.col(ts).isNotNull()).withColumn("_at", micros)
    rows = rows.withColumn("_slice", F.explode(F.array(F.floor(F.col("_at") / span), F.floor(F.col("_at") / span) + 1)))
    frame = W.partitionBy(item, "_slice").orderBy("_at").rangeBetween(-span, 0)
    counted = rows.withColumn(out, F.count("*").over(frame))
    return counted.where(F.col("_slice") == F.floor(F.col("_at") / span)).drop("_at", "_slice")


def first_promotions(events: DataFrame, item: str, ts: str, days: int = T.PROMOTE_DAYS, least: int = T.PROMOTE_LISTENS) -> DataFrame:
    """(item, ts): when each item first has ``least`` events within ``days`` days; what the stream's promotions give."""
    return trailing_counts(events.select(item, ts), item, ts, days).where(F.col("recent") >= least).groupBy(item).agg(F.min(ts).alias(ts))


def classify(files: DataFrame, now: Column, warn: int = T.WARN_DAYS, delete: int = T.DELETE_DAYS, notice: int = T.NOTICE_DAYS, adopt: int = T.ADOPT_DAYS, least: int = T.PROMOTE_LISTENS) -> DataFrame:
    """``action`` of each trial file: replace, adopt, promote, delete, warn, cancel or keep, the first that holds.

    Columns of ``files``: replaced, starred (boolean), promoted, warned, last_listen,
    downloaded (timestamps or null), recent (listens in the trailing window). Deleting
    needs the memory of a warning that is ``notice`` days old. Starred and promoted files
    are neither warned, deleted nor let off a warning.
    """
    idle = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last_listen", "downloaded"))) / 86400
    since = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 86400
    free = ~F.coalesce("starred", F.lit(False)) & F.col("promoted").isNull()
    action = (
        F.when(F.coalesce("replaced", F.lit(False)), "replace")
        .when(F.col("promoted").isNotNull() & (since("promoted") >= adopt), "adopt")
        .when(F.col("promoted").isNull() & (F.coalesce("recent", F.lit(0)) >= least), "promote")
        .when(free & (idle >= delete) & F.col("warned").isNotNull() & (since("warned") >= notice), "delete")
        .when(free & (idle >= warn) & F.col("warned").isNull(), "warn")
        .when(free & F.col("warned").isNotNull() & (idle < warn), "cancel")
        .otherwise("keep")
    )
    return files.withColumns({"idle_days": idle, "action": action})


def settled(files: DataFrame, changed: str, now: Column, seconds: int = 60) -> DataFrame:
    """Files that weren't changed in the last ``seconds``: younger ones may still be written."""
    return files.where(F.unix_timestamp(now) - F.unix_timestamp(changed) >= seconds)


def downloaded(files: DataFrame, sources: Sequence[str], out: str = "downloaded") -> DataFrame:
    """``out``: the first time that is known of ``sources``, such as the download's record, the player's, the file's own."""
    return files.withColumn(out, F.coalesce(*sources))


def replacements(files: DataFrame, library: DataFrame, file: str, path: str, isrc: str, seconds: str, key: Sequence[str]) -> DataFrame:
    """(file, path): the library's song of each trial file that has one.

    First by ISRC where the durations agree, then by ``key`` within 3 seconds, where only
    one song is a candidate. Of several songs with the ISRC the first path counts, and only
    its duration is compared.
    """
    known = library.where(F.coalesce(F.col(isrc), F.lit("")) != "").groupBy(isrc).agg(F.min_by(F.struct(path, seconds), path).alias("_s"))
    by_isrc = files.join(known, isrc).where(~T.other_version(F.col(seconds), F.col(f"_s.{seconds}"))).select(file, F.col(f"_s.{path}").alias(path))
    songs = library.select(*key, path, F.col(seconds).alias("_seconds"))
    near = files.join(by_isrc.select(file), file, "left_anti").join(songs, [*key]).where(F.abs(F.col(seconds) - F.col("_seconds")) <= 3)
    only = near.groupBy(file).agg(F.count("*").alias("_n"), F.min(path).alias(path)).where("_n = 1").select(file, path)
    return by_isrc.unionByName(only)


def live_state(state: DataFrame, files: DataFrame, item: str) -> DataFrame:
    """State of files that still exist."""
    return state.join(files.select(item).distinct(), item, "left_semi")
