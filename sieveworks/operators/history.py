"""Listening history: song aggregates, selection rules, albums, rediscovery.

Events have ``artist_key``, ``title_key``, ``sid``, ``ts`` (timestamp), ``listen``,
``done`` and ``deliberate`` (booleans).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SONG = ("artist_key", "title_key")
RULES = ("1", "2", "3", "4", "5")


def song_history(events: DataFrame, song: Sequence[str] = SONG) -> DataFrame:
    """One row a song: starts, done, listens, days with a listen, days chosen deliberately, first and last listen."""
    day, listen = F.to_date("ts"), F.col("listen")
    return events.groupBy(*song).agg(
        F.count("*").alias("starts"),
        F.count_if("done").alias("done"),
        F.count_if(listen).alias("listens"),
        F.countDistinct(F.when(listen, day)).alias("days"),
        F.countDistinct(F.when(F.col("deliberate"), day)).alias("chosen_days"),
        F.min(F.when(listen, F.col("ts"))).alias("first_listen"),
        F.max(F.when(listen, F.col("ts"))).alias("last_listen"),
    )


def favourite_variant(events: DataFrame, song: Sequence[str] = SONG, variant: str = "sid") -> DataFrame:
    """The variant of each song with most listens, of equal ones the smallest; without listens the smallest of all."""
    counts = events.groupBy(*song, variant).agg(F.count_if("listen").alias("n"))
    return counts.groupBy(*song).agg(F.min_by(variant, F.struct(-F.col("n"), F.col(variant))).alias("favourite"), F.sum("n").alias("listens"))


def artist_strength(songs: DataFrame, artist: str = "artist_key") -> DataFrame:
    """Songs of each artist with at least two listens."""
    return songs.where("listens >= 2").groupBy(artist).agg(F.count("*").alias("songs"))


def select_songs(songs: DataFrame, end: Column, artist: str = "artist_key", recent_days: int = 60) -> DataFrame:
    """Songs that at least one rule takes, with the rules as a comma-joined list.

    1: 10 listens. 2: 3 listens on 3 days. 3: chosen on 2 days. 4: 4 songs of the artist
    have 2 listens, this one has 2 on 2 days and is current (last year or this) or has 3.
    5: first heard at most ``recent_days`` whole days before ``end``, 3 listens. A song
    that ends in less than a quarter of its starts and never was chosen is excluded.
    """
    strong = artist_strength(songs, artist)
    rows = songs.join(strong, artist, "left").withColumn("songs", F.coalesce("songs", F.lit(0)))
    since = F.floor((F.unix_timestamp(end) - F.unix_timestamp("first_listen")) / 86400)
    current = (F.year("last_listen") >= F.year(end) - 1) | (F.col("listens") >= 3)
    tests = (
        F.col("listens") >= 10,
        (F.col("listens") >= 3) & (F.col("days") >= 3),
        F.col("chosen_days") >= 2,
        (F.col("songs") >= 4) & (F.col("listens") >= 2) & (F.col("days") >= 2) & F.coalesce(current, F.lit(False)),
        F.coalesce(since <= recent_days, F.lit(False)) & (F.col("listens") >= 3),
    )
    rules = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in zip(tests, RULES))))
    excluded = (F.col("done") < 0.25 * F.col("starts")) & (F.col("chosen_days") == 0)
    return rows.withColumns({"rules": rules, "excluded": excluded}).where(F.size("rules") > 0).withColumn("rules", F.array_join("rules", ",")).drop("songs")


def rule_tallies(selected: DataFrame) -> DataFrame:
    """How many songs each rule takes."""
    return selected.select(F.explode(F.split("rules", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def listened_albums(events: DataFrame, editions: DataFrame, by: Sequence[str], title: str, least_titles: int = 4, least_days: int = 3, least_share: float = 0.7) -> DataFrame:
    """Albums heard as such: distinct titles, days and share of the edition's tracks (column ``tracks`` of ``editions``)."""
    heard = events.where("listen").groupBy(*by).agg(F.countDistinct(title).alias("titles"), F.countDistinct(F.to_date("ts")).alias("days"))
    joined = heard.join(editions, [c for c in by if c in editions.columns])
    share = F.col("titles") / F.col("tracks")
    return joined.where((F.col("titles") >= least_titles) & (F.col("days") >= least_days) & (share >= least_share)).withColumn("share", F.round(share, 6))


def followed_playlists(playlists: DataFrame, songs: DataFrame, playlist: str, song: Sequence[str], least_listens: int = 20) -> DataFrame:
    """Songs with two listens and one finish, of playlists whose songs have ``least_listens`` in all."""
    joined = playlists.select(playlist, *song).distinct().join(songs, [*song])
    counts = joined.groupBy(playlist).agg(F.sum("listens").alias("total")).where(F.col("total") >= least_listens).select(playlist)
    return joined.join(counts, playlist, "left_semi").where("listens >= 2 and done >= 1").select(playlist, *song, "listens")


def entity_rollup(events: DataFrame, entities: dict[str, Column], amount: Column, when: Column) -> DataFrame:
    """Each event counted for several entities: (kind, entity, n, amount, last)."""
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), col.cast("string").alias("entity")) for kind, col in entities.items())))
    flat = events.select(rows.alias("e"), amount.alias("_amount"), when.alias("_when")).where("e.entity is not null")
    return flat.groupBy(F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity")).agg(F.count("*").alias("n"), F.sum("_amount").alias("amount"), F.max("_when").alias("last"))


def play_counts(catalogue: DataFrame, events: DataFrame, path: str = "path") -> DataFrame:
    """Plays and last play of every path, those never played included."""
    counts = events.where("listen").groupBy(path).agg(F.count("*").alias("plays"), F.max("ts").alias("last_play"))
    return catalogue.select(path).distinct().join(counts, path, "left").withColumn("plays", F.coalesce("plays", F.lit(0)))


def capped_histogram(df: DataFrame, value: str, cap: int = 5) -> DataFrame:
    """Rows by value, everything above ``cap`` counted with it."""
    return df.groupBy(F.least(F.col(value), F.lit(cap)).alias("value")).agg(F.count("*").alias("n"))


def rediscovery(songs: DataFrame, days: int, least: int = 0, require_play: bool = False) -> DataFrame:
    """Songs last heard more than ``days`` before the newest listen; those never heard too, unless a play is required."""
    end = songs.agg(F.max("last_listen")).scalar()
    old = F.col("last_listen") < end - F.make_dt_interval(F.lit(days))
    never = F.lit(not require_play) & F.col("last_listen").isNull()
    return songs.where((old | never) & (F.col("listens") >= least))
