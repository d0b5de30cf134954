"""Numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.sources.storage import written


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``, the place from 1 of each row in its group ``by``, in ``order``.

    Rows are divided by ranges of group and order, so a group of any size lies in as many
    ranges as it needs. Each range numbers its own rows; what earlier ranges of a group
    hold is added. Only the counts of ranges, one row for each range and group, are summed
    in one place a group. Rows that are equal in order may have their numbers either way;
    null is a group of its own. ``parts``: ranges, by default the session's shuffle partitions.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    local = ranges.withColumn("_place", F.row_number().over(W.partitionBy("_range", *by).orderBy(*order)).cast("long"))
    counts = ranges.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    offsets = counts.withColumn("_before", before).drop("_n").withColumnsRenamed(names | {"_range": "_in"})
    same = F.col("_range") == F.col("_in")
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return local.join(offsets, same).withColumn(out, F.col("_place") + F.col("_before")).select(*df.columns, out)
