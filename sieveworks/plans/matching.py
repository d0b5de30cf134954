"""Matching queries over customers, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import tolerance
from sieveworks.operators import match


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coalesced_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers: a decision for every 50th, an id for every 3rd, else the nation's first supplier."""
    customers, suppliers = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    decisions = customers.where("c_custkey % 50 = 0").select("c_custkey", F.lit(-1).cast("long").alias("v"))
    by_id = customers.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 100).alias("v"))
    by_key = suppliers.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("v"))
    return match.coalesced_lookup(customers.select("c_custkey", "c_nationkey"), [(decisions, ["c_custkey"], "v"), (by_id, ["c_custkey"], "v"), (by_key, ["c_nationkey"], "v")])


def missing_from_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with no item shipped since July 2001."""
    recent = _t(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2001-07-01'").select(F.col("l_partkey").alias("p_partkey"))
    return match.missing(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), [(recent, ["p_partkey"])])


def customers_without_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where("year(o_orderdate) = 2001").select(F.col("o_custkey").alias("c_custkey"))
    return match.missing(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [(orders, ["c_custkey"])])


def novelty_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers new by id and by (nation, segment, hundreds of balance)."""
    customers = _t(spark, sf_dir, "customer")
    key = F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string")).alias("k")
    own = customers.select("c_custkey", key)
    known = customers.where("c_custkey % 4 = 0").select(key)
    ids = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    own_ids = customers.select("c_custkey", F.col("c_custkey").alias("id"))
    return match.novel(customers.select("c_custkey"), "c_custkey", [(own, known, "k"), (own_ids, ids, "id")])


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    a = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("price_a"))
    b = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("price_b"))
    near = ~tolerance.other_version(F.col("price_a"), F.col("price_b"))
    return match.band_join(a, b, ["o_custkey"], near & (F.col("a") != F.col("b")), (tolerance.band(F.col("price_a")), tolerance.band(F.col("price_b"))))


def band_join_same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer whose totals differ by at most 3, or 1 % of the second."""
    return _order_pairs(spark, sf_dir).select("o_custkey", "a", "b")


def unique_candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.only_candidate(_order_pairs(spark, sf_dir).select("a", "b"), "a")


def duplicate_pairs_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    reasons = {"text": F.md5("text"), "size": F.concat_ws("|", "source", F.col("n_chars").cast("string"))}
    return match.duplicate_pairs(docs, "doc_id", reasons)


def inverted_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least five words which 2 to 20 documents have."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return match.shared_word_pairs(_t(spark, sf_dir, "documents"), "doc_id", words, least_shared=5)


def near_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the same first word at most three edits apart."""
    return match.near_names(_t(spark, sf_dir, "part"), "p_name", 3, F.substring_index("p_name", " ", 1))


def exact_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand as titles of an artist, sizes as durations, alike by the exact ratio."""
    return match.similar_titles(_t(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_name", "p_size").select("a", "b", F.round("ratio", 6).alias("ratio"))


def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of odd keys to those of even keys, nearest totals first, each once."""
    pairs = _order_pairs(spark, sf_dir).where("a % 2 = 1 and b % 2 = 0").withColumn("far", F.abs(F.col("price_a") - F.col("price_b")))
    return match.greedy_pairs(pairs, ["o_custkey"], "a", "b", ["far"]).select("o_custkey", "a", "b")


def dir_vs_player_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in one of two years only."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("y"))
    return match.difference(orders.where("y = 2000"), orders.where("y = 2001"), ["custkey"])


def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as artists and album artists of the parts that they share a number with."""
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("albumartist"))
    tracks = parts.withColumn("path", F.concat(F.lit("p/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    return match.library_index(tracks)


def nearest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the nearest other order of its customer, those of the same priority first."""
    orders = _t(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    own = match.nearest_other(orders, ["o_custkey", "o_orderpriority"], "o_orderkey", "cents")
    # where the priority has no other, all others are of another one
    left = match.nearest_other(orders, ["o_custkey"], "o_orderkey", "cents").join(own.select("id"), "id", "left_anti")
    return own.unionByName(left).select(F.col("id").alias("o_orderkey"), F.col("other").alias("b"))


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each part from three sources: all items, returned ones, large ones; their items' flags, quantities, taxes and lines stand for what speaks for them."""
    items = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    sources = [("all", items), ("large", items.where("l_quantity >= 40")), ("returned", items.where("l_returnflag = 'R'"))]
    facts = _t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.bool_or(F.col("l_returnflag") == "N").alias("record"), (F.max("l_quantity") > 45).alias("isrc"), F.when(F.min("l_tax") < 0.01, True).alias("print"), F.nullif(F.max("l_linenumber") % 4, F.lit(0)).alias("level"), F.when(F.min("l_discount") > 0.01, F.min("l_quantity")).alias("seconds_off")
    )
    out = match.ranked_candidates(sources, ["l_partkey"], "l_suppkey", facts).where("place <= 3")
    return out.select("l_partkey", "l_suppkey", F.array_join("sources", ",").alias("sources"), "place")


QUERIES = {f.__name__: f for f in (coalesced_lookup, missing_from_library, customers_without_recent, novelty_multi_key, band_join_same_key, unique_candidate_match, duplicate_pairs_reasons, inverted_index_pairs, near_name_pairs, exact_ratio_pairs, greedy_assignment, dir_vs_player_diff, library_index, nearest_store, ranked_candidates)}

_P = "with p as (select a.o_custkey, a.o_orderkey a, b.o_orderkey b from orders a join orders b using (o_custkey) where a.o_orderkey <> b.o_orderkey and not abs(a.o_totalprice - b.o_totalprice) > greatest(3.0, 0.01 * b.o_totalprice))"

ORACLE_SQL = {
    "coalesced_lookup": """select c_custkey, c_nationkey, case when c_custkey % 50 = 0 then -1 when c_custkey % 3 = 0 then c_custkey % 100 else v end as found,
      case when c_custkey % 50 = 0 then 1 when c_custkey % 3 = 0 then 2 when v is not null then 3 end as level from customer left join (select s_nationkey, min(s_suppkey) v from supplier group by 1) on s_nationkey = c_nationkey""",
    "missing_from_library": "select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_shipdate >= timestamp '2001-07-01')",
    "customers_without_recent": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 2001)",
    "novelty_multi_key": """with c as (select c_custkey, c_nationkey || '|' || c_mktsegment || '|' || cast(floor(c_acctbal / 100) as bigint) k from customer)
      select c_custkey from c where k not in (select k from c where c_custkey % 4 = 0) and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "band_join_same_key": f"{_P} select o_custkey, a, b from p",
    "unique_candidate_match": f"{_P} select a, b from p where a in (select a from p group by 1 having count(*) = 1)",
    "duplicate_pairs_reasons": """with r as (select doc_id id, 'text' reason, md5(text) key from documents where text is not null union select doc_id, 'size', concat_ws('|', source, n_chars) from documents),
      g as (select * from r where key <> '' and (reason, key) in (select (reason, key) from r group by reason, key having count(*) between 2 and 6))
      select x.id a, y.id b, string_agg(distinct x.reason, ',' order by x.reason) reasons from g x join g y on x.reason = y.reason and x.key = y.key and x.id < y.id group by 1, 2""",
    "inverted_index_pairs": """with w as (select distinct doc_id id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) word from documents), r as (select * from w where word in (select word from w group by 1 having count(*) between 2 and 20))
      select x.id a, y.id b, count(*) shared from r x join r y on x.word = y.word and x.id < y.id group by 1, 2 having count(*) >= 5""",
    "near_name_pairs": "with n as (select distinct p_name a from part) select x.a, y.a b, levenshtein(x.a, y.a) edits from n x join n y on split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1) and x.a < y.a where levenshtein(x.a, y.a) <= 3",
    "dir_vs_player_diff": "with a as (select distinct o_custkey custkey from orders where year(o_orderdate) = 2000), b as (select distinct o_custkey custkey from orders where year(o_orderdate) = 2001) select custkey, 'left' side from a where custkey not in (select custkey from b) union all select custkey, 'right' from b where custkey not in (select custkey from a)",
    "library_index": """with k as (select 'p/' || lpad(cast(p_partkey as varchar), 9, '0') path, regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g') title_key, unnest([regexp_replace(lower(p_brand), '[^a-z0-9_]', '', 'g'), regexp_replace(lower(p_type), '[^a-z0-9_]', '', 'g')]) artist_key from part)
      select artist_key, title_key, min(path) path from k where artist_key <> '' group by 1, 2""",
    "nearest_store": """select a.o_orderkey, first(b.o_orderkey order by case when a.o_orderpriority = b.o_orderpriority then 0 else 1 end, round(abs(b.o_totalprice - a.o_totalprice), 2), b.o_orderkey) b from orders a join orders b using (o_custkey) where a.o_orderkey <> b.o_orderkey group by 1""",
    "ranked_candidates": """with s as (select distinct l_partkey, l_suppkey, 'all' source from lineitem union select l_partkey, l_suppkey, 'large' from lineitem where l_quantity >= 40 union select l_partkey, l_suppkey, 'returned' from lineitem where l_returnflag = 'R'),
      m as (select l_partkey, l_suppkey, string_agg(source, ',' order by source) sources, count(*) n from s group by all),
      f as (select l_partkey, l_suppkey, max(case when l_returnflag = 'N' then 1 else 0 end) rec, case when max(l_quantity) > 45 then 1 else 0 end isrc, case when min(l_tax) < 0.01 then 1 else 0 end pr, max(l_linenumber) % 4 lev, case when min(l_discount) > 0.01 then min(l_quantity) else 0 end off from lineitem group by all)
      select l_partkey, l_suppkey, sources, cast(row_number() over (partition by l_partkey order by rec desc, isrc desc, pr desc, lev desc, off, n desc, l_suppkey) as int) place from m join f using (l_partkey, l_suppkey) qualify place <= 3""",
}
