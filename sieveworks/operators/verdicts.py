"""Decision ladders over measured evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import tolerance


def audio_verdict(df: DataFrame, similarity: str, seconds: str, reference: str, lookup: str, isrc_difference: str) -> DataFrame:
    """``verdict`` on a suspicious file: wrong, ok or doubtful, by preview similarity, durations and the lookup's word."""
    sim, ref = F.col(similarity), F.col(reference)
    other = ref.isNotNull() & tolerance.other_version(F.col(seconds), ref)
    verdict = (
        F.when(sim < tolerance.OTHER_AUDIO, "wrong")
        .when(sim.isNull() & ref.isNull() & (F.col(lookup) == "WRONG") & (F.coalesce(isrc_difference, F.lit(0)) > 10), "wrong")
        .when(~other & (F.coalesce(sim, F.lit(0.0)) >= tolerance.GOOD_PREVIEW), "ok")
        .otherwise("doubtful")
    )
    return df.withColumn("verdict", F.when(F.col(lookup) == "OK", "ok").otherwise(verdict))


def print_verdict(results: DataFrame, item: str, score: str, same_id: str, same_song: str, same_version: str, same_title: str, has_id: str, least: float = 0.7) -> DataFrame:
    """OK, OTHER VERSION, REVIEW, WRONG or UNKNOWN for each item, from the recordings that its print found."""
    good = F.col(score) >= least
    flags = results.groupBy(item).agg(
        F.count_if(good).alias("n"),
        F.bool_or(good & F.col(same_id)).alias("id"),
        F.bool_or(good & F.col(same_song)).alias("song"),
        F.bool_or(good & F.col(same_song) & F.col(same_version)).alias("version"),
        F.max(F.when(good, F.struct(F.col(score), F.col(same_title).alias("title"))))["title"].alias("title"),
        F.bool_or(has_id).alias("known"),
    )
    verdict = (
        F.when(F.col("n") == 0, "UNKNOWN")
        .when(F.coalesce("id", F.lit(False)) | F.coalesce("version", F.lit(False)), "OK")
        .when(F.coalesce("song", F.lit(False)), "OTHER VERSION")
        .when(F.coalesce("title", F.lit(False)) & ~F.col("known"), "REVIEW")
        .otherwise("WRONG")
    )
    return flags.select(item, verdict.alias("verdict"))
