"""Votes, majorities, survivors and relational division.

Votes are counted before anything is compared, so a group's rows never meet in one task:
ranking works on one row for each group and value. Ties go to the smaller value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority(df: DataFrame, by: Sequence[str], value: str, out: str = "winner") -> DataFrame:
    """The most frequent non-null ``value`` of each group, its votes and all votes."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias(out)
    return votes.groupBy(*by).agg(best, F.max("n").alias("votes"), F.sum("n").alias("all_votes"))


def _has(lists: Mapping[str, Sequence[str]], name: Column, value: Column) -> Column:
    """Whether the list of ``name`` holds ``value``."""
    out = F.lit(False)
    for key, values in lists.items():
        out = out | ((name == key) & value.isin(*values))
    return out


def two_votes(
    df: DataFrame, by: Sequence[str], value: str, least_votes: int = 3, least_share: float = 0.2, prevails: Mapping[str, Sequence[str]] | None = None, ignored: Mapping[str, Sequence[str]] | None = None, doubtful_share: float = 0.7
) -> DataFrame:
    """First and second choice of each group.

    first is the most frequent value, unless one of ``prevails`` (value: the values that it
    beats) has a vote and beats it. second is the most frequent of the others that
    ``ignored`` (first choice: values) doesn't name for this first choice; it needs
    ``least_votes`` and ``least_share`` of all votes. doubtful: the first has less than
    ``doubtful_share`` of at least three votes for more than one value.
    """
    votes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    group = W.partitionBy(*by)
    ranked = votes.withColumns({"_most": F.first(value).over(group.orderBy(F.desc("n"), value)), "all": F.sum("n").over(group), "kinds": F.count("*").over(group)})
    for strong, beaten in reversed((prevails or {}).items()):
        there = F.max(F.when(F.col(value) == strong, True)).over(group).isNotNull()
        ranked = ranked.withColumn("_strong", F.when(there & F.col("_most").isin(*beaten), strong).otherwise(F.col("_strong") if "_strong" in ranked.columns else F.lit(None)))
    top = F.coalesce("_strong", "_most") if prevails else F.col("_most")
    ranked = ranked.withColumn("_top", top)
    counts = (F.col(value) != F.col("_top")) & (F.col("n") >= least_votes) & (F.col("n") >= least_share * F.col("all")) & ~_has(ignored or {}, F.col("_top"), F.col(value))
    second = F.min_by(F.when(counts, F.col(value)), F.when(counts, F.struct(-F.col("n"), F.col(value)))).alias("second")
    share = F.max(F.when(F.col(value) == F.col("_top"), F.col("n") / F.col("all")))
    doubtful = ((share < doubtful_share) & (F.max("all") >= 3) & (F.max("kinds") > 1)).alias("doubtful")
    return ranked.groupBy(*by).agg(F.max("_top").alias("first"), second, F.max("all").alias("votes"), doubtful)


def agreed_date(df: DataFrame, by: Sequence[str], date: str, folder_year: str) -> DataFrame:
    """The date of each album: the most frequent of those of the folder's year, else that year; without one, the most frequent of all. Albums with neither are left out."""
    year = F.coalesce(F.col(folder_year), F.lit(""))
    rows = df.select(*by, year.alias("_year"), F.coalesce(F.col(date), F.lit("")).alias("_date"))
    fits = rows.where("_date <> '' and (_year = '' or substr(_date, 1, 4) = _year)")
    best = majority(fits, [*by, "_year"], "_date", "_best").select(*by, "_year", "_best")
    out = rows.select(*by, "_year").distinct().join(best, [*by, "_year"], "left")
    return out.select(*by, F.coalesce("_best", F.nullif(F.col("_year"), F.lit(""))).alias("date")).where("date is not null")


def usual_combination(df: DataFrame, by: Sequence[str], values: str, without: Sequence[str] = ()) -> DataFrame:
    """The most frequent list of values of each group, members of ``without`` left out of all; empty lists don't vote."""
    rows = df.select(*by, F.filter(values, lambda x: ~x.isin(*without)).alias("_list")).where(F.size("_list") > 0)
    return majority(rows, by, "_list", values).select(*by, values, "votes")


def with_overrides(df: DataFrame, overrides: DataFrame, on: Sequence[str], value: str, fixed: str) -> DataFrame:
    """``value`` replaced by the ``fixed`` value of an override table where it has one; ``overridden`` says so. Decision tables are small and unique by ``on``; Spark broadcasts one when its size allows."""
    joined = df.join(overrides.select(*on, F.col(fixed).alias("_fixed")), [*on], "left")
    return joined.withColumn("overridden", F.col("_fixed").isNotNull()).withColumn(value, F.coalesce("_fixed", value)).drop("_fixed")


def survivors(df: DataFrame, by: Sequence[str], order: Sequence[Column], id_col: str, spread: Column | None = None, most_spread: float | None = None) -> DataFrame:
    """(by, keeper, n, dropped): a row for every row of a group of two or more that isn't its keeper, the first id by ``order``; n is the size of the group.

    With ``spread``, a group whose largest value lies more than ``most_spread`` above its
    smallest is left out whole. Groups stay rows: however many members one has, no task
    holds them.
    """
    aggregates = [F.min_by(F.col(id_col), F.struct(*order, F.col(id_col))).alias("keeper"), F.count("*").alias("n")]
    if spread is not None:
        aggregates.append((F.max(spread) - F.min(spread)).alias("spread"))
    best = df.groupBy(*by).agg(*aggregates).where("n > 1")
    if spread is not None:
        best = best.where(F.col("spread") <= most_spread).drop("spread")
    return df.select(*by, F.col(id_col).alias("dropped")).join(best, [*by]).where("dropped <> keeper").select(*by, "keeper", "n", "dropped")


def verified_survivors(df: DataFrame, by: str, order: Sequence[Column], id_col: str, title: str, spread: Column, verified: DataFrame, most_spread: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(:func:`survivors`, (by, n)): copies to set aside, and groups to look at instead.

    Groups within the spread whose members differ in ``title`` are only taken where
    ``verified`` (by) says that they are the same; the others are to be looked at.
    """
    facts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(title, F.lit(""))).alias("_titles"), (F.max(spread) - F.min(spread)).alias("_spread"))
    facts = facts.where((F.col("n") > 1) & (F.col("_spread") <= most_spread)).join(verified.select(by, F.lit(True).alias("_known")).distinct(), by, "left")
    same = (F.col("_titles") == 1) | F.coalesce("_known", F.lit(False))
    return survivors(df.join(facts.where(same).select(by), by, "left_semi"), [by], order, id_col), facts.where(~same).select(by, "n")


def conflicts(df: DataFrame, by: Sequence[str], differs: str, spread: Column, most_spread: float) -> DataFrame:
    """Groups within the spread whose members differ in ``differs``."""
    found = df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(differs).alias("kinds"), (F.max(spread) - F.min(spread)).alias("spread"))
    return found.where((F.col("n") > 1) & (F.col("kinds") > 1) & (F.col("spread") <= most_spread))


def mixed_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Groups with more than one distinct value, and the values."""
    return df.groupBy(*by).agg(F.countDistinct(value).alias("kinds"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("seen")).where("kinds > 1")


def division(members: DataFrame, required: DataFrame, by: str, value: str) -> DataFrame:
    """The groups that have every value of ``required``."""
    wanted = required.select(value).distinct()
    have = members.select(by, value).distinct().join(wanted, value)
    size = wanted.agg(F.count("*")).scalar()
    return have.groupBy(by).agg(F.count("*").alias("matched")).where(F.col("matched") == size)


def best_cover(pairs: DataFrame, covers: DataFrame, by: str, id_col: str, area: str, most_bits: int = 20, store: DataFrame | None = None) -> DataFrame:
    """The cover of each group: its largest where all pairs (distance ``bits``) look the same, else that of ``store`` (by, cover; unique) if it has one, else the largest of the most frequent ``look``."""
    same = pairs.groupBy(by).agg(F.bool_and(F.col("bits") <= most_bits).alias("same"))
    looks = covers.groupBy(by, "look").agg(F.count("*").alias("n"), F.max_by(id_col, F.struct(F.col(area), -F.col(id_col))).alias("cover"), F.max(area).alias("area"))
    whole = looks.groupBy(by).agg(F.max_by("cover", F.struct("area", "n")).alias("largest"), F.max_by("cover", F.struct("n", "area")).alias("usual"))
    rows = whole.join(same, by, "left")
    rows = rows.withColumn("_store", F.lit(None)) if store is None else rows.join(store.select(by, F.col("cover").alias("_store")), by, "left")
    return rows.select(by, F.when(F.coalesce("same", F.lit(True)), F.col("largest")).otherwise(F.coalesce("_store", "usual")).alias("cover"))
