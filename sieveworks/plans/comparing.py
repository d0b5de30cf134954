"""Queries on albums, artists, releases and dates that look alike or foreign, and the rows behind the tallies of other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import audit, consensus
from sieveworks.plans import auditing


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(*parts: object):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def album_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as album folders of their customers: names repeat, as editions, with other signs, or share release groups; some pairs are known to differ."""
    k = F.col("o_orderkey")
    name = _s("Al", k % 4)
    shown = F.when(k % 5 == 0, _s(name, " (Deluxe Edition)")).when(k % 5 == 1, _s(name, "!")).otherwise(name)
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("artist"), _s(F.year("o_orderdate"), " - ", shown).alias("folder"), F.array(_s("g", F.floor(k / 8) % 6)).alias("groups"))
    known = spark.createDataFrame([("2000 - Al1", "1999 - Al1")], "folder_1 string, folder_2 string")
    return audit.albums_alike(rows, "artist", "folder", known, "groups")


def artist_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' numbers as artists, with and without an article and signs."""
    k = F.col("c_custkey") % 400
    name = F.when(F.col("c_custkey") % 3 == 0, _s("The Q", k)).when(F.col("c_custkey") % 3 == 1, _s("Q-", k)).otherwise(_s("Q", k))
    known = spark.createDataFrame([("The Q3", "Q3"), ("Q-7", "Q7")], "artist_1 string, artist_2 string")
    rows = _t(spark, sf_dir, "customer").where(F.length(k.cast("string")) < 4).select(name.alias("artist"))
    return audit.artists_alike(rows, "artist", known)


def folder_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as albums in the folders of their customers, lines as songs of suppliers, some with a guest."""
    i = _t(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    who = lambda n: _s("Ar ", n % 4)
    rows = i.select(_s(who(k), "/", k).alias("folder"), F.when(k % 3 != 0, who(k + F.floor(F.col("l_linenumber") / 3))).alias("album_artist"), F.when(F.col("l_linenumber") % 2 == 0, F.array(who(F.col("l_suppkey")), who(k + 1))).otherwise(F.array(who(F.col("l_suppkey")))).alias("artists"))
    return audit.folder_artists(rows, "folder", "album_artist", "artists")


def foreign_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as songs whose release has the name of another, and whose recording has another title or duration."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    k, no = F.col("k"), F.array().cast("array<string>")
    rows = part.withColumns({
        "album": F.when(k % 4 == 0, "Blue Sky").otherwise("Thunder"), "release": F.when(k % 4 < 2, "Blue Sky (Deluxe)").otherwise("Thunder Live"),
        "title": F.lit("Harbour"), "rec_title": F.when(k % 3 == 0, "Quiet Mill").otherwise("Harbour"), "seconds": F.lit(200.0), "rec_seconds": F.when(k % 11 != 0, 190.0 + F.col("p_size")), "isrcs": F.array(F.lit("A")), "rec_isrcs": F.when(k % 5 == 0, F.array(F.lit("A"))).otherwise(no),
    })
    return audit.union([audit.foreign_releases(rows, "k", "album", "release"), audit.foreign_recordings(rows, "k", "title", "rec_title", "seconds", "rec_seconds", "isrcs", "rec_isrcs")])


def date_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as tags, some cut, turned round or of another century."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    tag = F.when(k % 10 == 0, F.substring(day, 1, 7)).when(k % 10 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 10 == 2, F.concat(F.lit("18"), F.substring(day, 3, 8))).when(k % 10 == 3, "").when(k % 10 != 4, day)
    return audit.dates(_t(spark, sf_dir, "orders").withColumn("tag", tag), "o_orderkey", "tag", 2000)


def usual_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent pair of flags of each part's lines, without one that doesn't count."""
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", F.array("l_returnflag", "l_linestatus").alias("flags"))
    out = consensus.usual_combination(rows, ["l_partkey"], "flags", ["N"])
    return out.select("l_partkey", F.array_join("flags", ",").alias("flags"), "votes")


def pair_verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs behind ``pair_verdicts``, one by one."""
    return auditing.judged_pairs(spark, sf_dir)


def audio_verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files behind ``audio_verdicts``, one by one."""
    return auditing.judged_files(spark, sf_dir)


def media_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violations behind ``media_sections``, with what was found."""
    return auditing.media_violations(spark, sf_dir)


QUERIES = {f.__name__: f for f in (album_folders, artist_folders, folder_artists, foreign_parts, date_section, usual_combination, pair_verdict_rows, audio_verdict_rows, media_rows)}

_ID = "concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
ORACLE_SQL = {
    "album_folders": """with f as (select o_custkey % 300 as artist, year(o_orderdate) || ' - Al' || o_orderkey % 4 || case o_orderkey % 5 when 0 then ' (Deluxe Edition)' when 1 then '!' else '' end as folder, 'al' || o_orderkey % 4 as core,
        year(o_orderdate) || 'al' || o_orderkey % 4 || case when o_orderkey % 5 = 0 then 'deluxeedition' else '' end as flat, 'g' || o_orderkey // 8 % 6 as g from orders),
      d as (select distinct artist, folder, core, flat from f), s as (select distinct a.artist, a.folder as a, b.folder as b from f a join f b using (artist, g) where a.folder < b.folder),
      p as (select a.artist, a.folder as a, b.folder as b, a.core = b.core as same, a.flat = b.flat as flat, s.a is not null as grouped from d a join d b on a.artist = b.artist and a.folder < b.folder left join s on s.artist = a.artist and s.a = a.folder and s.b = b.folder)
      select 'albums alike' as section, case when same and flat then 'fix' when same then 'decide' else 'info' end as severity, a || ' | ' || b as key, case when same and flat then 'misspelled' when same then 'editions' else 'same release group' end as detail
      from p where (same or grouped) and not (a = '1999 - Al1' and b = '2000 - Al1')""",
    "artist_folders": """with n as (select distinct case c_custkey % 3 when 0 then 'The Q' || c_custkey % 400 when 1 then 'Q-' || c_custkey % 400 else 'Q' || c_custkey % 400 end as id, c_custkey % 400 as n from customer)
      select 'artists alike' as section, 'decide' as severity, a.id || ' | ' || b.id as key, 'nearly the same name' as detail from n a join n b on a.n = b.n and a.id < b.id where (a.id, b.id) not in (('Q3', 'The Q3'), ('Q-7', 'Q7'))""",
    "folder_artists": """with i as (select l_orderkey as k, 'Ar ' || l_orderkey % 4 as top, case when l_orderkey % 3 <> 0 then 'Ar ' || (l_orderkey + l_linenumber // 3) % 4 else 'Ar ' || l_suppkey % 4 end as who, 'Ar ' || l_suppkey % 4 as one, case when l_linenumber % 2 = 0 then 'Ar ' || (l_orderkey + 1) % 4 end as two from lineitem),
      f as (select k, top, count(*) as songs, bool_or(one = top or coalesce(two = top, false)) as sings from i group by 1, 2), o as (select k, who, count(*) as n from i where who <> top group by 1, 2),
      v as (select k, string_agg(who || '×' || n, ' / ' order by n desc, who) as seen, sum(n) as n from o group by 1)
      select case when sings then 'folder of a singing artist' else 'folder of another artist' end as section, case when sings then 'info' else 'decide' end as severity, top || '/' || k as key, seen || '; ' || n || ' of ' || songs as detail from v join f using (k)""",
    "foreign_parts": """with r as (select p_partkey as k, case when p_partkey % 4 = 0 then 'Blue Sky' else 'Thunder' end as album, case when p_partkey % 4 < 2 then 'Blue Sky (Deluxe)' else 'Thunder Live' end as release, p_partkey % 3 <> 0 as same, case when p_partkey % 11 <> 0 then 190.0 + p_size end as sec, p_partkey % 5 = 0 as isrc from part),
      m as (select *, coalesce(abs(200 - sec) <= 6, false) as len from r)
      select 'foreign release' as section, 'decide' as severity, cast(k as varchar) as key, album || ' | ' || release as detail from r where k % 4 = 1
      union all select 'foreign recording', 'fix', cast(k as varchar), 'no match' from m where not (isrc and len or same and len or same and sec is null or same and isrc)""",
    "date_section": """with t as (select o_orderkey as k, case o_orderkey % 10 when 0 then strftime(o_orderdate, '%Y-%m') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then '18' || strftime(o_orderdate, '%Y-%m-%d')[3:] when 3 then '' when 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as tag from orders)
      select 'odd date' as section, 'fix' as severity, cast(k as varchar) as key, case when contains(tag, '/') then 'odd format' else 'year out of range' end as detail from t where tag <> '' and (contains(tag, '/') or cast(tag[1:4] as int) not between 1900 and 2000)""",
    "usual_combination": """with l as (select l_partkey, array_to_string(list_filter([l_returnflag, l_linestatus], lambda x: x <> 'N'), ',') as flags from lineitem), c as (select l_partkey, flags, count(*) as n from l where flags <> '' group by all)
      select l_partkey, first(flags order by n desc, string_split(flags, ',')) as flags, max(n) as votes from c group by 1""",
    "pair_verdict_rows": f"""with r as (select {_ID} as id, 1 - round(l_discount * 100) * round(l_discount * 100) / 200 s, l_linenumber = 1 song, l_returnflag = 'R' ids, l_linenumber <= 4 alike, case when l_tax > 0 then 1 - round(l_tax * 100) / 25 end a, case when l_linenumber <> 3 then 0.9 end b, l_linestatus = 'O' title from lineitem)
      select id, case when s >= 0.9 then case when song then 'copies' when coalesce(a < 0.8, false) or coalesce(b < 0.8, false) then 'wrong audio' when a is null or b is null or a < 0.85 or b < 0.85 then 'same audio, unconfirmed'
        when s >= 0.98 and alike then case when title then 'copies' else 'same audio, two names' end else 'shared audio' end when s < 0.75 and ids and not song then 'wrong id' when s is not null then 'versions' end verdict from r""",
    "audio_verdict_rows": f"""with r as (select {_ID} as id, case when l_discount > 0 then 1 - 3 * l_discount end sim, l_quantity * 10 as seconds, case when l_linenumber % 2 = 0 then l_quantity * 10 + l_linenumber - 2 end ref, case when l_tax < 0.02 then 'OK' when l_tax > 0.06 then 'WRONG' else 'REVIEW' end lookup from lineitem),
      v as (select *, coalesce(abs(seconds - ref) > greatest(3.0, 0.01 * ref), false) other from r)
      select id, case when lookup = 'OK' then 'ok' when sim < 0.75 then 'wrong' when sim is null and ref is null and lookup = 'WRONG' then 'wrong' when not other and coalesce(sim, 0) >= 0.85 then 'ok' else 'doubtful' end verdict from v""",
    "media_rows": f"""with i as (select {_ID} as key, l_linenumber n, l_quantity q, floor(l_extendedprice)::bigint % 700 + 1 w, floor(l_extendedprice)::bigint % 700 + l_linenumber * 5 h from lineitem),
      s as (select key, case when n = 1 then 'lyrics missing' when n = 2 then 'lyrics without marks' when 40 - q > 12 then 'lyrics too long' when 40 - q > 5 then 'lyrics slightly long' end section, case when n > 2 then '40.0' end as detail from i
        union all select key, 'cover missing', null from i where n = 7 union all select key, 'cover too small', null from i where n <> 7 and least(w, h) < 290 union all select key, 'cover small', null from i where n <> 7 and least(w, h) between 290 and 499
        union all select key, 'cover not square', null from i where n <> 7 and abs(w - h) > 0.05 * greatest(w, h) union all select key, 'cover not a front', null from i where n = 6)
      select section, case when section in ('lyrics too long', 'cover missing', 'cover too small') then 'fix' else 'info' end severity, key, detail from s where section is not null""",
}
