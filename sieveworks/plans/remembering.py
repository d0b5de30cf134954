"""Queries on what is remembered between runs: playlists, annotations, loads, lookups, saved tags, verdicts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.operators import audit, changes, match, verdicts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_back_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of their customer's playlist; every seventh was lost and returns."""
    orders = _t(spark, sf_dir, "orders")
    entries = orders.select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), "o_orderkey")
    return changes.put_back(entries.where("o_orderkey % 7 <> 0"), entries.where("o_orderkey % 7 = 0"), "o_custkey", "pos", "o_orderkey")


def annotation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plays of customers by priority; odd customers moved to the next one, every fifth was removed."""
    plays = _t(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("item"), F.lit(1).alias("plays"), F.col("o_orderkey").alias("last"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old"))
    moved = customers.where("old % 5 = 0 or old % 2 = 1").select("old", F.when(F.col("old") % 5 != 0, F.col("old") + 1).alias("new"))
    return changes.fold_into(plays, moved, "item", ["o_orderpriority"], {"plays": "sum", "last": "max"})


def new_load_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key and customer an earlier load, every hundredth order, didn't have."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return changes.new_loads(orders, orders.where("o_orderkey % 100 = 0"), ["o_orderkey", "o_custkey"])


def lookups_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lookups: purchases found something, clicks nothing."""
    status = F.when(F.col("event_type") == "purchase", "found").when(F.col("event_type") == "click", "absent").otherwise("unknown")
    lookups = _t(spark, sf_dir, "events").select("event_id", status.alias("status"), F.to_date("ts").alias("looked_up"))
    return changes.retry_due(lookups, F.lit("2024-02-14").cast("date")).select("event_id", "status")


def tag_restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved brand and type of parts against tags of which some are swapped, cut or gone."""
    part = _t(spark, sf_dir, "part").where("p_brand is not null and p_type is not null")
    saved = part.select("p_partkey", F.lit("names").alias("tag"), F.array("p_brand", "p_type").alias("values"))
    cut = F.when(F.col("p_partkey") % 10 == 0, F.array("p_brand")).otherwise(F.array("p_type", "p_brand"))
    now = part.where("p_partkey % 13 <> 0").select("p_partkey", F.lit("names").alias("tag"), cut.alias("values"))
    plan = changes.restore_plan(saved, now, "p_partkey", "tag", "values")
    return plan.select("p_partkey", "tag", F.array_join("old", "|").alias("old"), F.array_join("new", "|").alias("new"))


def reverted_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that undoes closing all open orders."""
    opened = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return changes.reverted(opened.select("o_orderkey", F.col("o_orderstatus").alias("old"), F.lit("F").alias("new")))


def best_that_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest line items of each supplier whose part is a large one."""
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    large = _t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return match.first_resolved(lines, large, ["l_partkey"], ["l_suppkey"], [F.desc("l_quantity"), "l_partkey", "l_orderkey", "l_linenumber"], 5)


def print_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings that a user's print found; remainders of k are what agrees."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    found = _t(spark, sf_dir, "events").select(
        "user_id", (F.coalesce("value", F.lit(0.0)) / 100).alias("score"), (k % 50 == 0).alias("same_id"), (k % 3 == 0).alias("same_song"),
        (k % 10 == 0).alias("same_version"), (k % 5 == 0).alias("same_title"), (k % 40 == 0).alias("has_id"),
    )
    return verdicts.print_verdict(found, "user_id", "score", "same_id", "same_song", "same_version", "same_title", "has_id")


def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in all, and those open, urgent, and large."""
    wanted = {"open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority").startswith("1"), "large": F.col("o_totalprice") > 100_000}
    return audit.totals(_t(spark, sf_dir, "orders"), wanted)


def section_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by section and severity: durations and missing tags of events."""
    events = _t(spark, sf_dir, "events")
    return audit.tallies(audit.union([audit.durations(events, "event_id", "value"), audit.basics(events, "event_id", ["value", "event_type"])]))


QUERIES = {f.__name__: f for f in (put_back_position, annotation_fold, new_load_rows, lookups_to_retry, tag_restore_plan, reverted_plan, best_that_resolve, print_verdicts, library_totals, section_tallies)}

ORACLE_SQL = {
    "put_back_position": """with e as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) pos from orders),
      j as (select l.o_custkey, l.o_orderkey, max(s.pos) filter (s.pos < l.pos) as after, min(s.pos) filter (s.pos > l.pos) behind
        from e l left join e s on s.o_custkey = l.o_custkey and s.o_orderkey % 7 <> 0 and abs(s.pos - l.pos) <= 10 where l.o_orderkey % 7 = 0 group by 1, 2)
      select o_custkey, o_orderkey, after, case when after is null then behind end ahead_of from j""",
    "annotation_fold": "select o_orderpriority, case when o_custkey % 2 = 1 then o_custkey + 1 else o_custkey end item, count(*) plays, max(o_orderkey) as last from orders where o_custkey % 5 <> 0 group by 1, 2",
    "new_load_rows": "select o_orderkey, o_custkey from orders where o_orderkey % 100 <> 0 and o_custkey not in (select o_custkey from orders where o_orderkey % 100 = 0)",
    "lookups_to_retry": """select event_id, status from (select event_id, ts, case event_type when 'purchase' then 'found' when 'click' then 'absent' else 'unknown' end status from events)
      where status = 'unknown' or status = 'absent' and date_diff('day', cast(ts as date), date '2024-02-14') >= 30""",
    "tag_restore_plan": """select p_partkey, 'names' tag, case when p_partkey % 13 <> 0 then p_brand end as old, least(p_brand, p_type) || '|' || greatest(p_brand, p_type) as new
      from part where (p_partkey % 13 = 0 or p_partkey % 10 = 0) and p_brand is not null and p_type is not null""",
    "reverted_plan": "select o_orderkey, 'F' as old, o_orderstatus as new from orders where o_orderstatus = 'O'",
    "best_that_resolve": """select * from (select l_suppkey, l_partkey, l_quantity, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_quantity desc, l_partkey, l_orderkey, l_linenumber) place
      from lineitem where l_partkey in (select p_partkey from part where p_size > 25)) where place <= 5""",
    "print_verdicts": """with e as (select user_id, coalesce(value, 0) / 100 score, try_cast(json_extract_string(props, '$.k') as int) k from events),
      b as (select *, max(score) filter (score >= 0.7) over (partition by user_id) best from e),
      g as (select user_id, count(*) filter (score >= 0.7) n, bool_or(k % 50 = 0) filter (score >= 0.7) same, bool_or(k % 3 = 0) filter (score >= 0.7) song,
        bool_or(k % 3 = 0 and k % 10 = 0) filter (score >= 0.7) as version, bool_or(k % 5 = 0) filter (score = best) title, bool_or(k % 40 = 0) known from b group by 1)
      select user_id, case when n = 0 then 'UNKNOWN' when coalesce(same, false) or coalesce(version, false) then 'OK' when coalesce(song, false) then 'OTHER VERSION'
        when coalesce(title, false) and not coalesce(known, false) then 'REVIEW' else 'WRONG' end verdict from g""",
    "library_totals": "select count(*) as total, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderpriority like '1%') as urgent, count(*) filter (o_totalprice > 100000) as large from orders",
    "section_tallies": """select * from (select 'odd duration' section, 'decide' severity, count(*) n from events where value < 20 or value > 1200
      union all select 'missing tags', 'fix', count(*) from events where value is null or coalesce(event_type, '') = '') where n > 0""",
}
