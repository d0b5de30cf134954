"""Edition, collection and shared-id queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import audit, prints, releases
from sieveworks.sources.storage import settled


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edition_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a folder of parts, a supplier's deliveries are an edition; the supplier with the earliest one is preferred."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    out = releases.choose_edition(items, items.select("l_suppkey", "l_partkey", "l_linenumber", "shipped"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ["shipped"])
    return out.select("l_orderkey", "l_suppkey", "fits", "ambiguous")


def _edition_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Orders as folders of parts, suppliers as editions; durations of the two sides differ by up to ten seconds, a third of the parts has no ISRC, and parts share titles."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    items = settled(items.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey"))
    title, isrc = (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string"))
    songs = items.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("folder"), F.col("l_partkey").alias("song")).agg(F.array(F.coalesce(F.first(isrc), F.lit(""))).alias("isrcs"), F.first(title).alias("title_key"), F.first(100.0 + F.col("p_size") + F.col("l_orderkey") % 11).alias("seconds"), F.min("month").alias("date"))
    tracks = items.repartition("l_suppkey").groupBy(F.col("l_suppkey").alias("edition"), F.col("l_partkey").alias("track")).agg(F.coalesce(F.first(isrc), F.lit("")).alias("isrc"), F.first(title).alias("title_key"), F.first(100.0 + F.col("p_size") + F.col("l_suppkey") % 5).alias("seconds"), (1 + F.col("l_suppkey") % 2).alias("disc"), (F.min("l_linenumber").cast("long") + F.col("l_partkey") % 2).alias("pos"))
    editions = items.groupBy(F.col("l_suppkey").alias("edition")).agg(F.min("month").alias("date"), F.lit(None).cast("long").alias("nb_tracks"))
    candidates = items.select(F.col("l_orderkey").alias("folder"), F.col("l_suppkey").alias("edition")).distinct()
    return songs, editions, tracks, candidates


def edition_by_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition of every order's parts by ISRC, title and duration, with its state."""
    return releases.number_by_edition(*_edition_tables(spark, sf_dir))[0]


def edition_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disc and place of the parts of every order with one sure edition."""
    return releases.number_by_edition(*_edition_tables(spark, sf_dir))[1]


def edition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts join the small ones of their brand; price stands for length."""
    part = _t(spark, sf_dir, "part")
    out = releases.merge_editions(part.where("p_size <= 25"), part.where("p_size > 25"), ["p_type"], "p_brand", "p_partkey", "p_retailprice", near=30)
    return out.select("p_brand", "p_partkey", "copy_of", F.col("number").cast("long").alias("number"))


def collected_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all customers of a nation as one album, in the order of their dates."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    works = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("work"))
    return releases.collected_album(orders, works, "o_custkey", "work", ["day", "o_orderkey"], "day").select("work", "o_orderkey", F.col("number").cast("long").alias("number"), "album_date")


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a number behind their repeats."""
    return releases.with_suffixes(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a part share its id: the dearest keeps it, a large discount is bad evidence. Counted by part."""
    items = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice", (1 - 5 * F.col("l_discount")).alias("evidence"))
    out = releases.shared_ids(items, "l_partkey", "l_orderkey", "l_extendedprice", "evidence", least=0.75)
    return out.groupBy("l_partkey", "keeper").agg(F.count("*").alias("n"), F.count_if("demoted").alias("demoted"))


def list_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with as many ship months as supplier 1 that shares most of them."""
    months = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return releases.choose_list(months.where("l_suppkey <> 1"), months.where("l_suppkey = 1"), "l_suppkey", "month", 0.5)


def agreed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a customer's orders made one; two customers have an official one."""
    official = spark.createDataFrame([(1, "X"), (7, "Y")], "o_custkey long, official string")
    return releases.agreed_names(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus", official)


def sibling_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tracks: a part's size class is the release group, a third has none; folders are orders, suppliers' ranges the album artists."""
    k = F.col("l_partkey")
    rows = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("string")).alias("path"), F.col("l_orderkey").alias("folder"), F.when(k % 3 != 0, F.concat(F.lit("g"), (k % 40).cast("string"))).alias("release_group"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string"))).alias("release"), (k % 5).cast("string").alias("album_key"), F.concat(F.lit("Artist "), (F.col("l_suppkey") % 4).cast("string")).alias("album_artist"),
    )
    official = spark.createDataFrame([("r0", "Artist 0"), ("r1", "Other")], "release string, artist string")
    names = spark.createDataFrame([("Other", "Artist 2")], "source_name string, library_name string")
    return releases.sibling_artists(rows, official, names)


def best_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that stands for each customer: a finished one first, then the oldest."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("official"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return releases.best_release(orders, "o_custkey", "o_orderkey", "official", "day")


def better_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as covers of their part: price and a little less are the sides, the discount the distance."""
    items = _t(spark, sf_dir, "lineitem")
    rows = items.select("l_partkey", "l_orderkey", F.floor("l_extendedprice").alias("w"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("h"), F.round(F.col("l_discount") * 300).cast("long").alias("bits"), F.lit(300).alias("now"))
    return releases.better_cover(rows, "l_partkey", "l_orderkey", "w", "h", "bits", "now")


def text_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 customers whose name holds both words."""
    return releases.find(_t(spark, sf_dir, "customer"), F.col("c_name"), "cust 1", order=["c_custkey"]).select("c_custkey", "c_name")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with tags that disagree with their paths for some."""
    part = _t(spark, sf_dir, "part")
    key = F.col("p_partkey")
    year = (1980 + F.col("p_size")).cast("string")
    folder = F.concat(F.when(key % 13 == 0, F.lit("")).otherwise(F.concat(year, F.lit(" - "))), F.col("p_type"))
    number = F.lpad((key % 30 + 1).cast("string"), 2, "0")
    path = F.concat(F.col("p_brand"), F.lit("/"), folder, F.lit("/"), F.when(key % 17 == 0, F.lit("track")).otherwise(F.concat(number, F.lit(" - "), "p_name")), F.lit(".flac"))
    return part.select(
        path.alias("path"), (key % 30 + 1 + F.when(key % 7 == 0, 1).otherwise(0)).cast("string").alias("tracknumber"), F.when(key % 5 == 0, F.lit("2001")).otherwise(F.concat(year, F.lit("-05-01"))).alias("date"),
        F.when(key % 11 == 0, F.lit("Other")).otherwise(F.col("p_type")).alias("album"), F.when(key % 19 == 0, F.lit("Nobody")).otherwise(F.col("p_brand")).alias("albumartist"),
    )


def path_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose paths and tags disagree: violations by section and severity."""
    return audit.paths(_tracks(spark, sf_dir)).groupBy("section", "severity").agg(F.count("*").alias("n"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as prints of whole numbers, each with that of the next vector of its label moved by two words."""
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(x * 4), F.lit(1 << 20)).cast("long")).alias("a"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.concat(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), "a").alias("b"))
    return vectors.join(following, "vec_id")


def likely_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.likely_offsets(_prints(spark, sf_dir), "vec_id", "a", "b").select("vec_id", F.col("offset").cast("long").alias("offset"), "votes")


def two_stage_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.pair_similarity(_prints(spark, sf_dir), "vec_id", "a", "b")


QUERIES = {f.__name__: f for f in (edition_choice, edition_by_tolerance, edition_numbers, edition_merge, collected_album, repeated_names, shared_ids, list_choice, agreed_names, sibling_artists, best_release, better_cover, text_find, path_audit, likely_offsets, two_stage_similarity)}

_PRINTS = """with v as (select vec_id, list_transform(embedding, lambda x: ((cast(floor(cast(x as float) * 4) as bigint) % 1048576) + 1048576) % 1048576) w from embeddings),
  p as (select x.vec_id, x.w a, list_concat([1, 2], y.w) b from v x join v y on y.vec_id = x.vec_id + 1)"""
_EDITIONS = """with recursive i as (select l_orderkey as folder, l_partkey as p, l_suppkey as edition, l_linenumber as n, strftime(l_shipdate, '%Y-%m') as d, p_size as z from lineitem join part on p_partkey = l_partkey),
      songs as (select folder, p as song, case when p % 3 <> 0 then p end as isrc, p % 50 as title, 100.0 + z + folder % 11 as sec, min(d) as d from i group by all),
      tracks as (select edition, p as track, case when p % 3 <> 0 then p end as isrc, p % 50 as title, 100.0 + z + edition % 5 as sec, 1 + edition % 2 as disc, n + p % 2 as pos from (select edition, p, z, min(n) as n from i group by all)),
      eds as (select edition, date, tracks, discs from (select edition, count(*) as tracks, max(disc) as discs from tracks group by 1) join (select edition, min(d) as date from i group by 1) using (edition)),
      cand as (select distinct folder, edition from i),
      num as (select folder, song, row_number() over (partition by folder order by song) as k, count(*) over (partition by folder) as size from songs),
      hits as (select folder, edition, song, 1 as pass, list(track order by track) as ts from cand join songs using (folder) join tracks using (edition, isrc) where abs(songs.sec - tracks.sec) <= greatest(7, 0.03 * tracks.sec) group by all
        union all select folder, edition, song, 2, list(track order by track) from cand join songs using (folder) join tracks using (edition, title) where abs(songs.sec - tracks.sec) <= greatest(3, 0.01 * tracks.sec) group by all),
      steps as (select folder, edition, song, k + (pass - 1) * size as step, pass, size, coalesce(ts, []) as ts from cand join num using (folder) cross join (values (1), (2)) v(pass) left join hits using (folder, edition, song, pass)),
      st as (select folder, edition, 0::bigint as step, []::bigint[] as used, []::bigint[] as done, null::bigint as song, null::bigint as track, 0 as pass from cand
        union all
        select folder, edition, step, case when pick is null then used else list_append(used, pick) end, case when pick is null then done else list_append(done, song) end, song, pick, pass
        from (select st.folder, st.edition, s.step, st.used, st.done, s.song, s.pass, case when not list_contains(st.done, s.song) then list_filter(s.ts, lambda x: not list_contains(st.used, x))[1] end as pick
          from st join steps s on s.folder = st.folder and s.edition = st.edition and s.step = st.step + 1)),
      placed as (select folder, edition, song, pass, disc, pos from st join tracks using (edition, track)),
      votes as (select folder, d, count(*) as v from songs group by all), sized as (select folder, size, d from (select folder, count(*) as size from songs group by 1) join (select folder, first(d order by v desc, d) as d from votes group by 1) using (folder)),
      fits as (select folder, edition, count(*) filter (pass = 1) as by_isrc, string_agg(song || ':' || disc || ':' || pos, ',' order by song) as places from placed group by all),
      whole as (select f.*, e.date, e.tracks, e.discs > 1 as more, sized.d, size from fits f join eds e using (edition) join sized using (folder) where len(string_split(places, ',')) = size),
      best as (select folder, first(edition order by by_isrc desc, date <> d, left(date, 4) <> left(d, 4), tracks, edition) as edition, count(*) as fits, count(distinct (places, more)) as signs from whole group by 1)"""
ORACLE_SQL = {
    "edition_by_tolerance": f"{_EDITIONS} select folder, case when signs = 1 then edition end as edition, coalesce(fits, 0) as fits, case when signs = 1 then 'numbered' when signs > 1 then 'ambiguous' else 'none' end as state from sized left join best using (folder)",
    "edition_numbers": f"{_EDITIONS} select folder, song, disc, pos from placed join best using (folder, edition) where signs = 1",
    "edition_choice": """with s as (select distinct l_orderkey, l_partkey from lineitem), n as (select l_orderkey, count(*) size from s group by 1),
      t as (select l_suppkey, l_partkey, min(l_linenumber) place, min(strftime(l_shipdate, '%Y-%m-%d')) shipped from lineitem group by all),
      f as (select l_orderkey, l_suppkey, count(*) n, string_agg(l_partkey || ':' || place, ',' order by l_partkey) places, min(shipped) shipped from s join t using (l_partkey) group by all)
      select l_orderkey, first(l_suppkey order by shipped, l_suppkey) l_suppkey, count(*) fits, count(distinct places) > 1 ambiguous from f join n using (l_orderkey) where n = size group by 1""",
    "edition_merge": """with b as (select * from part where p_size <= 25), o as (select * from part where p_size > 25),
      c as (select o.p_brand, o.p_partkey, first(b.p_partkey order by abs(o.p_retailprice - b.p_retailprice), b.p_partkey) copy_of from o join b on o.p_brand = b.p_brand and o.p_type = b.p_type and abs(o.p_retailprice - b.p_retailprice) <= 30 group by all)
      select o.p_brand, o.p_partkey, copy_of, case when copy_of is null then 900 + row_number() over (partition by o.p_brand, copy_of is null order by o.p_type, o.p_partkey) end number from o left join c on c.p_partkey = o.p_partkey""",
    "collected_album": """with r as (select c_nationkey || '/' || c_mktsegment as work, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d from orders join customer on c_custkey = o_custkey),
      f as (select work, min(d) album_date from r group by 1 having count(*) >= 3) select work, o_orderkey, row_number() over (partition by work order by d, o_orderkey) number, album_date from r join f using (work)""",
    "repeated_names": "with r as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) k from part) select p_partkey, case when k = 1 then p_name else p_name || ' (' || k || ')' end unique_name from r",
    "shared_ids": """with k as (select l_partkey, first(l_orderkey order by l_extendedprice desc, l_orderkey) keeper from lineitem group by 1 having count(*) > 1)
      select l_partkey, keeper, count(*) n, count(*) filter (l_orderkey <> keeper and 1 - 5 * l_discount < 0.75) demoted from lineitem join k using (l_partkey) group by all""",
    "list_choice": """with m as (select distinct l_suppkey, strftime(l_shipdate, '%Y-%m') mo from lineitem), w as (select mo from m where l_suppkey = 1),
      f as (select l_suppkey, count(*) size, count(*) filter (mo in (select mo from w)) shared from m where l_suppkey <> 1 group by 1)
      select l_suppkey, shared from f where size = (select count(*) from w) and shared >= 0.5 * size order by shared desc, l_suppkey limit 1""",
    "agreed_names": """with v as (select o_custkey, o_orderstatus s, count(*) n from orders group by all), w as (select o_custkey, case o_custkey when 1 then 'X' when 7 then 'Y' else first(s order by n desc, s) end winner from v group by 1 having count(*) > 1)
      select o_custkey, o_orderkey, o_orderstatus old, winner as new from orders join w using (o_custkey) where o_orderstatus <> winner""",
    "sibling_artists": """with t as (select concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) as path, l_orderkey as folder, case when l_partkey % 3 <> 0 then 'g' || l_partkey % 40 end as rg, case when l_partkey % 4 = 0 then '' else 'r' || l_suppkey % 3 end as rel, cast(l_partkey % 5 as varchar) as ak, 'Artist ' || l_suppkey % 4 as aa from lineitem),
      v as (select rg, ak, aa, count(*) as n from t where rg is not null group by all), r as (select rg, ak, rel, count(*) as n from t where rg is not null group by all),
      f as (select rg, ak, first(aa order by n desc, aa) as usual from v group by 1, 2 having count(*) > 1), w as (select rg, ak, first(rel order by n desc, rel) as rel from r group by 1, 2),
      d as (select rg, ak, case rel when '' then usual when 'r0' then 'Artist 0' when 'r1' then 'Artist 2' end as new from f join w using (rg, ak) where rel <> 'r2'),
      x as (select rg, ak, path, aa as old from t where rg is not null union all select g.rg, t.ak, t.path, t.aa from t join (select distinct rg, ak, folder from t where rg is not null) g on g.folder = t.folder and g.ak = t.ak where t.rg is null)
      select rg as release_group, ak as album_key, path, old, new from x join d using (rg, ak) where old <> new""",
    "best_release": "select o_custkey, first(o_orderkey order by o_orderstatus <> 'F', strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) o_orderkey from orders group by 1",
    "better_cover": """with c as (select l_partkey, l_orderkey, floor(l_extendedprice) w, floor(l_extendedprice * (1 - l_tax)) h, cast(round(l_discount * 300) as bigint) bits from lineitem)
      select l_partkey, first(l_orderkey order by least(w, h) < 1000, bits, least(w, h) desc, l_orderkey) cover from c where bits <= 20 and abs(w - h) <= 0.05 * greatest(w, h) and least(w, h) > 300 group by 1""",
    "text_find": "select c_custkey, c_name from customer where contains(lower(c_name), 'cust') and contains(c_name, '1') order by c_custkey limit 40",
    "path_audit": """with k as (select p_partkey k, p_size s from part), n as (select 'outside pattern' section, 'fix' severity, count(*) n from k where k % 17 = 0
      union all select 'album without year', 'fix', count(*) from k where k % 13 = 0 union all select 'number unlike file', 'fix', count(*) from k where k % 17 <> 0 and k % 7 = 0
      union all select 'year unlike folder', 'fix', count(*) from k where k % 13 <> 0 and k % 5 = 0 and s <> 21 union all select 'album unlike folder', 'decide', count(*) from k where k % 11 = 0
      union all select 'artist unlike folder', 'decide', count(*) from k where k % 19 = 0) select * from n where n > 0""",
    "likely_offsets": f"""{_PRINTS}, i as (select vec_id, unnest(a) w, generate_subscripts(a, 1) i from p), j as (select vec_id, unnest(b) w, generate_subscripts(b, 1) j from p),
      c as (select vec_id, i - j as o, count(*) votes from i join j using (vec_id, w) group by all) select vec_id, cast(o as bigint) as "offset", votes from c qualify row_number() over (partition by vec_id order by votes desc, o) <= 3""",
}
