"""Consensus, survivor and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import consensus, genres


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedupe_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts: the document of the most frequent language, then the longest, then the smallest id survives."""
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "n_chars", F.md5("text").alias("key"))
    langs = docs.groupBy("lang").agg(F.count("*").alias("of_lang"))
    docs = docs.join(langs, "lang", "left").withColumn("of_lang", F.coalesce("of_lang", F.lit(0)))
    return consensus.survivors(docs, ["key"], [-F.col("of_lang"), -F.col("n_chars")], "doc_id").select("keeper", "n", "dropped")


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part").withColumn("isrc", F.concat_ws("/", "p_brand", (F.col("p_size") % 20).cast("string")))
    verified = part.where("p_partkey % 5 = 0").select("isrc").distinct()
    return consensus.verified_survivors(part, "isrc", [-F.col("p_size"), F.length("p_name")], "p_partkey", "p_name", F.col("p_retailprice") % 4, verified)


def verified_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size class as copies: the largest stays, where their names are the same or the group was verified."""
    return _copies(spark, sf_dir)[0].select("isrc", "keeper", "n", "dropped")


def copies_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir)[1]


def dedupe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name and brand within 3 of each other in price that differ in type."""
    out = consensus.conflicts(_t(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_type", F.col("p_retailprice"), 3.0)
    return out.select("p_name", "p_brand", "n", "kinds", F.round("spread", 4).alias("spread"))


def genre_two_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each nation's customers as its genres; machinery beats automobiles, and household makes furniture and building count for nothing."""
    rules = {"prevails": {"MACHINERY": ["AUTOMOBILE"]}, "ignored": {"HOUSEHOLD": ["FURNITURE", "BUILDING"], "FURNITURE": ["MACHINERY"]}}
    return consensus.two_votes(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", **rules)


#: Priorities of orders as names that sources give to genres, one with no meaning.
_SOURCES = {"1-URGENT": "Rap/Hip Hop", "2-HIGH": "Urbano latino", "3-MEDIUM": "Latin Music", "4-NOT SPECIFIED": "Salsa", "5-LOW": "Films/Games"}


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as songs: customers are artists, every tenth a collection of various artists, of which a year is an album, every tenth a soundtrack by the customer before."""
    orders, key = _t(spark, sf_dir, "orders"), F.col("o_custkey")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    artist = F.when(key % 10 == 0, "Various Artists").when(key % 10 == 1, "Soundtracks").otherwise(name(key))
    source = F.try_element_at(F.create_map(*(F.lit(x) for pair in _SOURCES.items() for x in pair)), F.col("o_orderpriority"))
    rows = orders.select(artist.alias("albumartist"), name(key + 2).alias("artist"), F.year("o_orderdate").cast("string").alias("album"), F.when((key % 7 != 3) | (key % 10 == 1), genres.genre_of(source)).alias("genre"))
    return genres.voters(rows, "albumartist", "artist", "album")


def genre_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres of customers by the vote of their orders; every fiftieth's are decided by hand."""
    fixed = _t(spark, sf_dir, "customer").where("c_custkey % 50 in (3, 13)").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.lit("Jazz").alias("fixed"))
    return genres.choose(_songs(spark, sf_dir), fixed).select("kind", "name", F.array_join("genres", ",").alias("genres"), "doubtful")


def agreed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month that most of a customer's orders of one year have; the year stands for the folder's, for every third customer the next one does."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    first = orders.groupBy("o_custkey").agg(F.min(F.substring("date", 1, 4)).alias("first"))
    year = F.when(F.col("o_custkey") % 3 == 0, (F.col("first").cast("int") + 20).cast("string")).when(F.col("o_custkey") % 3 == 1, F.col("first"))
    return consensus.agreed_date(orders.join(first, "o_custkey").withColumn("folder", year), ["o_custkey"], "date", "folder")


def fixed_override_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = consensus.majority(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "genre")
    fixed = spark.createDataFrame([(3, "FIXED"), (7, "OTHER")], "c_nationkey int, given string")
    return consensus.with_overrides(votes, fixed, ["c_nationkey"], "genre", "given").select("c_nationkey", "genre", "votes", "overridden")


def consensus_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual month of each customer's orders in a year."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return consensus.majority(orders, ["o_custkey", "year"], "month").select("o_custkey", "year", "winner", "votes")


def majority_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.majority(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who have ordered with every priority."""
    orders = _t(spark, sf_dir, "orders")
    return consensus.division(orders, orders, "o_custkey", "o_orderpriority")


def album_mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.mixed_values(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


def best_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as covers: the total is the area, the priority the look; neighbours by key are compared."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("area"), F.col("o_orderpriority").alias("look"))
    marks = orders.groupBy("o_custkey").agg(F.min(F.substring("look", 1, 1).cast("int")).alias("low"), F.max(F.substring("look", 1, 1).cast("int")).alias("high"))
    pairs = marks.select("o_custkey", ((F.col("high") - F.col("low")) * 10).alias("bits"))
    return consensus.best_cover(pairs, orders, "o_custkey", "o_orderkey", "area")


def share_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each flag in a supplier's items, counted before the window sees them."""
    from pyspark.sql import Window

    counts = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")), 6))


QUERIES = {f.__name__: f for f in (dedupe_survivor, verified_survivors, copies_to_verify, dedupe_conflicts, genre_two_votes, genre_choice, agreed_date, fixed_override_vote, consensus_date, majority_home, relational_division, album_mixed_values, best_cover, share_in_group)}

_V = "v as (select c_nationkey, c_mktsegment, count(*) n from customer where c_mktsegment is not null group by all)"
_COPIES = """with p as (select p_brand || '/' || p_size % 20 as isrc, p_partkey, p_name, p_size, p_retailprice % 4 as s from part), g as (select isrc, count(*) as n, count(distinct p_name) as titles, bool_or(p_partkey % 5 = 0) as known, max(s) - min(s) as spread,
  first(p_partkey order by p_size desc, length(p_name), p_partkey) as keeper from p group by 1 having count(*) > 1 and max(s) - min(s) <= 3)"""
ORACLE_SQL = {
    "verified_survivors": f"{_COPIES} select isrc, keeper, n, p_partkey as dropped from p join g using (isrc) where (titles = 1 or known) and p_partkey <> keeper",
    "copies_to_verify": f"{_COPIES} select isrc, n from g where titles > 1 and not known",
    "dedupe_survivor": """with l as (select lang, count(*) of_lang from documents where text is not null group by 1), d as (select md5(text) key, doc_id, coalesce(of_lang, 0) of_lang, n_chars from documents left join l using (lang) where text is not null),
      g as (select key, first(doc_id order by of_lang desc, n_chars desc, doc_id) keeper, count(*) n from d group by 1 having count(*) > 1) select keeper, n, doc_id dropped from d join g using (key) where doc_id <> keeper""",
    "dedupe_conflicts": "select p_name, p_brand, count(*) n, count(distinct p_type) kinds, round(max(p_retailprice) - min(p_retailprice), 4) spread from part group by 1, 2 having count(*) > 1 and count(distinct p_type) > 1 and max(p_retailprice) - min(p_retailprice) <= 3",
    "genre_two_votes": f"""with {_V}, m as (select c_nationkey, first(c_mktsegment order by n desc, c_mktsegment) most, max(n) filter (c_mktsegment = 'MACHINERY') machines, sum(n) a, count(*) kinds from v group by 1),
      t as (select *, case when most = 'AUTOMOBILE' and machines > 0 then 'MACHINERY' else most end top from m),
      o as (select c_nationkey, first(c_mktsegment order by n desc, c_mktsegment) o, max(n) o_n from v join t using (c_nationkey) where c_mktsegment <> top and not (top = 'HOUSEHOLD' and c_mktsegment in ('FURNITURE', 'BUILDING')) and not (top = 'FURNITURE' and c_mktsegment = 'MACHINERY') group by 1)
      select c_nationkey, top as first, case when o_n >= 3 and o_n >= 0.2 * a then o end as second, cast(a as bigint) votes, (select n from v where v.c_nationkey = t.c_nationkey and c_mktsegment = top) / a < 0.7 and a >= 3 and kinds > 1 doubtful from t left join o using (c_nationkey)""",
    "genre_choice": """with o as (select o_custkey k, year(o_orderdate) as y, case when o_custkey % 7 <> 3 or o_custkey % 10 = 1 then case o_orderpriority when '1-URGENT' then 'Hip Hop' when '2-HIGH' then 'Reggaeton' when '3-MEDIUM' then 'Latin' when '4-NOT SPECIFIED' then 'Tropical' when '5-LOW' then 'Soundtrack' end end g from orders),
      s as (select case k % 10 when 0 then 'album' when 1 then 'soundtrack' else 'artist' end kind, case k % 10 when 0 then cast(y as varchar) when 1 then 'c' || (k + 2) else 'c' || k end as name, g from o),
      v as (select kind, name, g, count(*) n from s where g is not null group by all),
      m as (select kind, name, first(g order by n desc, g) most, sum(n) a, count(*) kinds, max(n) filter (g = 'Reggaeton') r, max(n) filter (g = 'Tropical') t from v group by all),
      t as (select *, case when r > 0 and most in ('Hip Hop', 'Latin') then 'Reggaeton' when t > 0 and most in ('Latin', 'Pop') then 'Tropical' else most end top from m),
      x as (select kind, name, first(g order by n desc, g) g2, max(n) n2 from v join t using (kind, name) where g <> top and not (top = 'Reggaeton' and g in ('Hip Hop', 'Latin')) and not (top = 'Tropical' and g in ('Latin', 'Pop')) group by all),
      w as (select t.kind, t.name, [top] || case when n2 >= 3 and n2 >= 0.2 * a then [g2] else [] end gs, v.n / a < 0.7 and a >= 3 and kinds > 1 doubtful from t join v on v.kind = t.kind and v.name = t.name and v.g = top left join x on x.kind = t.kind and x.name = t.name),
      f as (select 'c' || c_custkey as name from customer where c_custkey % 50 in (3, 13)),
      d as (select kind, name, case when kind = 'artist' and name in (select name from f) then ['Jazz'] else gs end gs, doubtful and not (kind = 'artist' and name in (select name from f)) doubtful from w union all select 'artist', name, ['Jazz'], false from f where name not in (select name from w where kind = 'artist'))
      select kind, name, array_to_string(gs, ',') genres, doubtful from d where kind <> 'soundtrack'
      union all select 'soundtrack', p.name, array_to_string(list_filter(coalesce(a.gs, d.gs), lambda g: g <> 'Soundtrack')[1:2] || ['Soundtrack'], ','), coalesce(d.doubtful, false) from (select distinct name from s where kind = 'soundtrack') p
        left join d on d.kind = 'soundtrack' and d.name = p.name left join d a on a.kind = 'artist' and a.name = p.name where a.gs is not null or d.gs is not null""",
    "agreed_date": """with o as (select o_custkey, strftime(o_orderdate, '%Y-%m') as date from orders), y as (select o_custkey, case o_custkey % 3 when 0 then cast(cast(min(date[1:4]) as int) + 20 as varchar) when 1 then min(date[1:4]) end y from o group by 1),
      v as (select o_custkey, date, count(*) n from o join y using (o_custkey) where y is null or date[1:4] = y group by all), b as (select o_custkey, first(date order by n desc, date) best from v group by 1)
      select o_custkey, coalesce(best, y) as date from y left join b using (o_custkey)""",
    "fixed_override_vote": f"with {_V} select c_nationkey, case c_nationkey when 3 then 'FIXED' when 7 then 'OTHER' else first(c_mktsegment order by n desc, c_mktsegment) end genre, max(n) votes, c_nationkey in (3, 7) overridden from v group by 1",
    "consensus_date": "with v as (select o_custkey, year(o_orderdate) as year, strftime(o_orderdate, '%Y-%m') m, count(*) n from orders group by all) select o_custkey, cast(year as int) as year, first(m order by n desc, m) winner, max(n) votes from v group by o_custkey, year",
    "majority_home": "with v as (select l_suppkey, l_returnflag, count(*) n from lineitem where l_returnflag is not null group by all) select l_suppkey, first(l_returnflag order by n desc, l_returnflag) winner, max(n) votes, cast(sum(n) as bigint) all_votes from v group by 1",
    "relational_division": "select o_custkey, count(distinct o_orderpriority) matched from orders group by 1 having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders)",
    "album_mixed_values": "select o_custkey, count(distinct o_orderstatus) kinds, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) seen from orders group by 1 having count(distinct o_orderstatus) > 1",
    "best_cover": """with o as (select o_custkey, o_orderkey, cast(round(o_totalprice) as bigint) area, o_orderpriority look from orders), l as (select o_custkey, look, count(*) n, first(o_orderkey order by area desc, o_orderkey) cover, max(area) area from o group by all)
      select o_custkey, case when (max(cast(look[1] as int)) - min(cast(look[1] as int))) * 10 <= 20 then first(cover order by area desc, n desc) else first(cover order by n desc, area desc) end cover from l group by 1""",
    "share_in_group": "select l_suppkey, l_returnflag, count(*) n, round(count(*) / sum(count(*)) over (partition by l_suppkey), 6) as share from lineitem group by 1, 2",
}
