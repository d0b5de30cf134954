"""Fingerprint pairs in two stages: likely offsets by votes, then all offsets for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions import similarity, tolerance


def likely_offsets(pairs: DataFrame, pair: str, a: str, b: str, most: int = 3) -> DataFrame:
    """(pair, offset, votes): the offsets (place in a less place in b) at which most words are equal; at most ``most`` for a pair, ties to the smaller offset.

    Words meet in an equi-join on pair and word, and votes are counted before they are ranked.
    """
    side = lambda column, at: pairs.select(pair, F.posexplode(column).alias(at, "word"))
    votes = side(a, "_i").join(side(b, "_j"), [pair, "word"]).groupBy(pair, (F.col("_i") - F.col("_j")).alias("offset")).agg(F.count("*").alias("votes"))
    place = F.row_number().over(W.partitionBy(pair).orderBy(F.desc("votes"), "offset"))
    return votes.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def similarity_at(pairs: DataFrame, offsets: DataFrame, pair: str, a: str, b: str, around: int = 2, least_overlap: float = 0.5) -> DataFrame:
    """(pair, similarity): the best share of equal bits of 32-bit words at the given offsets and up to ``around`` beside them, where at least ``least_overlap`` of the shorter print overlaps; rounded to 3 digits."""
    at = offsets.select(pair, F.explode(F.sequence(F.col("offset") - around, F.col("offset") + around)).alias("_o")).distinct()
    rows = pairs.select(pair, a, b).join(at, pair)
    zero = F.lit(0)
    left = F.slice(F.col(a), F.greatest(F.col("_o"), zero) + 1, F.size(a))
    right = F.slice(F.col(b), F.greatest(-F.col("_o"), zero) + 1, F.size(b))
    rows = rows.select(pair, left.alias("_l"), right.alias("_r"), F.least(F.size(a), F.size(b)).alias("_short")).withColumn("_n", F.least(F.size("_l"), F.size("_r")))
    rows = rows.where((F.col("_n") > 0) & (F.col("_n") >= least_overlap * F.col("_short")))
    equal = F.zip_with(F.slice("_l", F.lit(1), F.col("_n")), F.slice("_r", F.lit(1), F.col("_n")), lambda x, y: F.lit(32) - F.bit_count(x.bitwiseXOR(y)))
    share = F.aggregate(equal, F.lit(0), lambda s, x: s + x) / (32.0 * F.col("_n"))
    return rows.groupBy(pair).agg(F.round(F.max(share), 3).alias("similarity"))


def pair_similarity(pairs: DataFrame, pair: str, a: str, b: str, enough: float = tolerance.SAME_AUDIO) -> DataFrame:
    """(pair, similarity, exhaustive): likely offsets first; a pair that stays below ``enough`` there slides over all offsets and has the larger value. A pair too short to slide has what the likely offsets give, or null."""
    quick = similarity_at(pairs, likely_offsets(pairs, pair, a, b), pair, a, b)
    rows = pairs.select(pair, a, b).join(quick, pair, "left")
    done = rows.where(F.col("similarity") >= enough).select(pair, "similarity", F.lit(False).alias("exhaustive"))
    rest = rows.where(F.coalesce(F.col("similarity") < enough, F.lit(True)))
    slid = rest.select(pair, "similarity", similarity.sliding_similarity(a, b).alias("_s"))
    return done.unionByName(slid.select(pair, F.greatest("similarity", "_s").alias("similarity"), F.lit(True).alias("exhaustive")))
