"""Change-log, merge and snapshot queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.operators import changes
from sieveworks.sources import published
from sieveworks.sources.storage import shared_dir


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clerk of fifty customers hands over to the next order's; every 17th record removes."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("desk"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("old"))
    following = F.lead("old").over(W.partitionBy("desk", F.floor(F.col("seq") / 1000)).orderBy("seq"))
    return orders.select("seq", "old", F.when(F.col("seq") % 17 == 0, None).otherwise(F.coalesce(following, F.concat("old", F.lit("x")))).alias("new"))


def change_log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.compact(_log(spark, sf_dir))


def incremental_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in four batches, by thirds of its numbers and the rest, each compacted into what is published; the second arrives twice."""
    log = _log(spark, sf_dir)
    end = log.agg(F.max("seq")).first()[0] or 0
    table = published.Published(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", published.CHANGE_MAP)
    sink = published.change_map_sink(table, "log")
    for i in (0, 1, 1, 2, 3):
        sink(log.where((F.col("seq") >= i * (end // 3)) & (F.col("seq") < (i + 1) * (end // 3))), i)
    return table.read()


def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events as a stream into published counters; the stream runs again from nothing, under the same name, and adds nothing."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    table = published.Published(spark, f"{folder}/counts", "user_id long, event_type string, plays long, last string")
    on, merged = ["user_id", "event_type"], {"plays": "sum", "last": "max"}
    sink = published.counter_sink(table, on, merged, "events")
    for run in ("first", "again"):
        rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(*on, F.lit(1).cast("long").alias("plays"), F.date_format("ts", "yyyy-MM-dd").alias("last"))
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/{run}").trigger(availableNow=True).start().awaitTermination()
    return published.counters(table, on, merged)


def remap_with_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playlist entries of their priority, by customer; odd customers moved to the next one, every fifth was removed."""
    orders = _t(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("item"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old"))
    moved = customers.where("old % 5 = 0 or old % 2 = 1").select("old", F.when(F.col("old") % 5 != 0, F.col("old") + 1).alias("new"))
    return changes.remap(orders, "item", moved, unique=["o_orderpriority", "item"], position="pos").select("o_orderpriority", "item", "pos")


def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the first half of January 2024 merged with those of the second."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    part = lambda when: rows.where(when).groupBy("user_id", "event_type").agg(F.count("*").alias("plays"), F.max("day").alias("last"))
    return changes.upsert(part("day < '2024-01-16'"), part("day >= '2024-01-16'"), ["user_id", "event_type"], {"plays": "sum", "last": "max"})


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in long form against a snapshot with changed sizes, no brands for every tenth part and notes for every 25th."""
    part = _t(spark, sf_dir, "part")
    long_ = lambda df: df.select("p_partkey", F.explode(F.array(*(F.struct(F.lit(c).alias("tag"), F.col(c).cast("string").alias("value")) for c in ("p_name", "p_brand", "p_size", "note")))).alias("t")).select("p_partkey", "t.tag", "t.value").where("value is not null")
    old = part.withColumn("note", F.lit(None).cast("string"))
    new = part.withColumns({"p_size": F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_brand": F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")), "note": F.when(F.col("p_partkey") % 25 == 0, F.lit("new"))})
    return changes.snapshot_diff(long_(old), long_(new), "p_partkey", "tag", "value")


def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey")
    out = changes.missing_rows(rows, "c_custkey", rows.where("c_custkey % 4 = 0"), rows.where("c_custkey % 6 = 0"), rows.where("c_custkey % 9 = 0"))
    return out.groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (change_log_compaction, incremental_change_log, incremental_counts, remap_with_removals, counter_upsert, snapshot_diff, missing_rows)}

_COMPACTED = """with recursive o as (select o_orderkey seq, o_custkey % 50 desk, 'c' || o_custkey as old from orders),
      l as (select seq, old, case when seq % 17 = 0 then null else coalesce(lead(old) over (partition by desk, seq // 1000 order by seq), old || 'x') end as new from o),
      log as (select * from l where new is null or old <> new), nxt as (select r.seq, min(x.seq) nx from log r join log x on x.old = r.new and x.seq > r.seq group by 1),
      chain(seq, cur) as (select seq, seq from log union all select c.seq, n.nx from chain c join nxt n on n.seq = c.cur), ends as (select seq, max(cur) fin from chain group by 1),
      again as (select e.seq, min(x.seq) nx from ends e join log r on r.seq = e.fin and r.new is null join log own on own.seq = e.seq join log x on x.old = own.old and x.seq > e.fin group by 1),
      restarted(seq, cur) as (select seq, seq from log union all select c.seq, n.nx from restarted c join again n on n.seq = c.cur), last as (select seq, max(cur) fin from restarted group by 1),
      starts as (select old, min(seq) filter (removed is null or seq > removed) seq from (select *, max(case when new is null then seq end) over (partition by old) removed from log) group by 1)
      select s.old, f.new from starts s left join last using (seq) left join ends e on e.seq = last.fin left join log f on f.seq = e.fin"""
_COUNTS = "select user_id, event_type, count(*) plays, strftime(max(ts), '%Y-%m-%d') as last from events group by 1, 2"

ORACLE_SQL = {
    "change_log_compaction": _COMPACTED,
    "incremental_change_log": _COMPACTED,
    "incremental_counts": _COUNTS,
    "remap_with_removals": "select o_orderpriority, case when o_custkey % 2 = 1 then o_custkey + 1 else o_custkey end item, min(o_orderkey) pos from orders where o_custkey % 5 <> 0 group by 1, 2",
    "counter_upsert": _COUNTS,
    "snapshot_diff": "select '~' as change, 'p_size' tag, count(*) n from part where p_partkey % 7 = 0 having count(*) > 0 union all select '-', 'p_brand', count(*) from part where p_partkey % 10 = 0 having count(*) > 0 union all select '+', 'note', count(*) from part where p_partkey % 25 = 0 having count(*) > 0",
    "missing_rows": "select case when c_custkey % 4 = 0 then 'removed' when c_custkey % 6 = 0 then 'awaited' when c_custkey % 9 = 0 then 'moved' else 'unexplained' end reason, count(*) n from customer group by 1",
}
