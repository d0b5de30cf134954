"""Text keys, scraping and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import keys
from sieveworks.operators import audit, verdicts
from sieveworks.sources import readers

#: Titles, artists, albums and codes that the rules were made for.
TITLES = (
    "Bohemian Rhapsody - Remastered 2011", "Bohemian Rhapsody", "Shaky Shaky - Remix", "Shaky Shaky", "Thriller (Deluxe)", "Song (Live) [Remix]", "Best Friends (feat. Someone) - Radio Edit",
    "Canción - En Vivo", "Title (Acoustic Version) - 2009 Remaster", "Pa-Kum-Pa!", "One - Two - Three", "Song (From the Film)", "Ñandú (Original Mix)", "Part 4 (Instrumental)", "Song (!!!)", "",
)
ARTISTS = ("Wisin & Yandel, Daddy Yankee", "Kavinsky • Lovefoxxx", "Artist feat. Guest", "Björk x Arca", "Simon y Garfunkel", "X Ambassadors", "Daft Punk", "Taylor Swift ft Bon Iver", "")
ALBUMS = ("Thriller (25th Anniversary)", "Thriller", "Abbey Road - Super Deluxe", "Hits [Deluxe Edition]", "Version of Me", "Random Access Memories (Bonus)")
CODES = ("USRC17607839", "GBAYE0601498", "usrc17607839", "B'QZMEP2276434'", "QZMEP2276434", "US-RC1-76-07839", "")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, values: tuple[str, ...], column: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _values(spark, TITLES, "title").unionByName(_t(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct())
    return titles.select("title", keys.title_key(F.col("title")).alias("key"), keys.base_title(F.col("title")).alias("base"))


def artist_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _values(spark, ARTISTS, "artist").unionByName(_t(spark, sf_dir, "customer").select(F.col("c_name").alias("artist")))
    credits = F.array_join(keys.credited_artists(F.col("artist")), "|")
    return names.select("artist", keys.artist_key(F.col("artist")).alias("key"), keys.first_artist(F.col("artist")).alias("first"), credits.alias("credits"))


def album_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _values(spark, ALBUMS, "album").unionByName(_t(spark, sf_dir, "part").select(F.col("p_type").alias("album")).distinct())
    return names.select("album", keys.album_base(F.col("album")).alias("base"), keys.album_core(F.col("album")).alias("core"))


def paren_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every line of all documents, by line: how many lines share one."""
    lines = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    # equal lines first: one key for each
    counts = lines.groupBy("line").agg(F.count("*").alias("n")).select(keys.without_brackets(F.col("line")).alias("key"), "n")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def path_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _t(spark, sf_dir, "pages")
    return urls.select("page_id", keys.clean_file(F.col("url")).alias("file"), keys.clean_dir(F.concat("url", F.lit(" .. "))).alias("dir"), keys.cut_to_bytes(F.col("url"), 20).alias("cut"))


def id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", keys.link_id(F.col("url")).alias("link_id"), keys.number_of(keys.link_id(F.col("url"))).alias("number"))


def page_title_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_facts(_t(spark, sf_dir, "pages")).select("page_id", "title", "lang", "n_links")


def html_entity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_facts(_t(spark, sf_dir, "pages")).where("n_entities > 0").select("page_id", "n_entities")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand more than once in a document."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("doc_id", F.md5("line").alias("line")).agg(F.count("*").alias("n")).where("n > 1")


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.private_data(_t(spark, sf_dir, "documents"), "doc_id", "text", allowed=None)


def code_format_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _values(spark, CODES, "code").unionByName(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct())
    return codes.select("code", keys.is_isrc(F.col("code")).alias("isrc"), keys.date_problem(F.col("code"), 2026).alias("date_problem"))


def marks_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyrics made of conversation turns: each line gets the mark of its turn."""
    turns = _t(spark, sf_dir, "conversations").withColumn("line", F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":0"), (F.col("turn") % 10).cast("string"), F.lit(".50] "), F.coalesce("text", F.lit(""))))
    marks = turns.select("conv_id", F.explode(keys.lyric_marks(F.col("line"))).alias("mark"))
    return marks.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("mark").alias("last"))


def repeated_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_positions(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of several sections over several tables, in one schema."""
    part, orders, pages = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "pages")
    return audit.union(
        [
            audit.codes(part, "p_partkey", "p_brand"),
            audit.durations(part.withColumn("seconds", F.col("p_retailprice")), "p_partkey", "seconds"),
            audit.outside(part, "p_partkey", "p_size", list(range(1, 46))),
            audit.mixed(orders, "o_custkey", "o_orderstatus"),
            audit.basics(pages, "page_id", ["url", "html"]),
            audit.texts(part, "p_partkey", ["p_name", "p_type"]),
        ]
    )


def more_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on tags, covers and a player's albums: customers are artists or folders, their orders songs, the order's priority, status and clerk's day genre, cover and album."""
    orders = _t(spark, sf_dir, "orders").withColumns({"artist": F.when(F.col("o_custkey") % 9 == 0, "Various Artists").when(F.col("o_custkey") % 9 == 1, "Soundtracks").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), "track_artist": F.concat(F.lit("t"), (F.col("o_custkey") % 20).cast("string"))})
    songs = orders.withColumn("genres", F.array(F.when(F.col("o_orderpriority") == "5-LOW", "Soundtrack").otherwise(F.col("o_orderpriority"))))
    media = orders.where("o_orderstatus <> 'F'").select(F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string"), F.lit("/f"), (F.col("o_custkey") % 200).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("x"), (F.floor(F.col("o_custkey") / 3) % 70).cast("string")).alias("album_id"))
    albums = media.select(F.col("album_id").alias("id")).distinct().withColumn("name", F.when(F.col("id") != "x3", F.upper("id")))
    states = orders.withColumns({"code": F.when(F.col("o_orderkey") % 97 == 1, 1).otherwise(0), "lossy": F.when(F.col("o_orderkey") % 50 == 0, "MP3"), "error": F.when(F.col("o_orderkey") % 89 == 0, "broken"), "signed": F.when(F.col("o_orderkey") % 41 != 0, F.lit(True)), "silent": F.col("o_orderkey") % 31 == 0})
    return audit.union(
        [
            audit.artists_of_many_genres(songs, "artist", "track_artist", "genres", most=2),
            audit.mixed_covers(orders, "o_custkey", "o_orderstatus"),
            audit.player_albums(media, albums),
            audit.damaged(states, "o_orderkey", "code", "o_orderstatus"),
            audit.unreadable(states, "o_orderkey", "error"),
            audit.unsigned(states, "o_orderkey", "signed"),
            audit.lossy_files(states, "o_orderkey", "lossy"),
            audit.lyrics_of_instrumentals(states, "o_orderkey", "o_orderpriority", "silent"),
        ]
    )


def file_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on files: orders by customer and year as paths, those of a status as other files; all customers have folders of three years."""
    orders = _t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    files = orders.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "y", F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", ".jpg").otherwise(".flac"))).alias("path"))
    folders = _t(spark, sf_dir, "customer").select(F.explode(F.array(F.col("c_custkey").cast("string"), *(F.concat(F.col("c_custkey").cast("string"), F.lit(f"/{y}")) for y in (1999, 2000, 2001)))).alias("folder"))
    inodes = orders.select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 9000).alias("ino"))
    tags = orders.select("o_orderkey", F.array_distinct(F.array("o_orderstatus", F.substring("o_orderpriority", 3, 1))).alias("mark"))
    return audit.union([audit.empty_folders(folders, files), audit.other_files(files, "path", readers.is_audio(F.element_at(F.split("path", "/"), -1))), audit.hardlinks(inodes, "path", "ino"), audit.several_values(tags, "o_orderkey", ["mark"])])


def media_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of lyrics and covers: items as songs, their quantity as seconds, marks made of their lines, sizes of covers of their prices."""
    items = _t(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))))
    marks = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "no marks").otherwise(F.concat(F.lit("[00:0"), F.col("l_linenumber").cast("string"), F.lit(".50] a\n[00:40] b")))
    side = lambda c: (F.floor(F.col(c)) % 700).cast("int")
    pictures = F.when(F.col("l_linenumber") != 7, F.array(F.struct(F.when(F.col("l_linenumber") == 6, 2).otherwise(3).alias("type"), (side("l_extendedprice") + 1).alias("w"), (side("l_extendedprice") + F.col("l_linenumber") * 5).alias("h"))))
    rows = items.select("id", marks.alias("lyrics"), F.col("l_quantity").alias("seconds"), pictures.alias("pictures"))
    return audit.union([audit.lyrics(rows, "id", "lyrics", "seconds"), audit.covers(rows, "id", "pictures")])


def media_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many violations of lyrics and covers there are in each section."""
    return media_violations(spark, sf_dir).groupBy("section", "severity").agg(F.count("*").alias("n"))


_ITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as pairs of songs: discount and tax stand for scores and previews, flags for what they have in common."""
    i = _t(spark, sf_dir, "lineitem")
    rows = i.select(
        F.concat_ws("/", *(F.col(c).cast("string") for c in _ITEM)).alias("id"), (1 - F.round(F.col("l_discount") * 100) * F.round(F.col("l_discount") * 100) / 200).alias("score"), (F.col("l_linenumber") == 1).alias("song"), (F.col("l_returnflag") == "R").alias("ids"), F.lit(200.0).alias("a"), (F.lit(200.0) + F.col("l_linenumber")).alias("b"),
        F.when(F.col("l_tax") > 0, 1 - F.round(F.col("l_tax") * 100) / 25).alias("pa"), F.when(F.col("l_linenumber") != 3, F.lit(0.9)).alias("pb"), (F.col("l_linestatus") == "O").alias("title"),
    )
    return audit.audio_pairs(rows, "score", "song", "ids", "a", "b", "pa", "pb", "title").select("id", "verdict")


def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs have each verdict."""
    return judged_pairs(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def judged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as suspicious files: the discount stands for the similarity, the quantity for the length, its tax for the lookup."""
    items = _t(spark, sf_dir, "lineitem")
    rows = items.select(
        F.concat_ws("/", *(F.col(c).cast("string") for c in _ITEM)).alias("id"), F.when(F.col("l_discount") > 0, 1 - 3 * F.col("l_discount")).alias("sim"), (F.col("l_quantity") * 10).alias("seconds"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 10 + F.col("l_linenumber") - 2).alias("reference"), F.when(F.col("l_tax") < 0.02, "OK").when(F.col("l_tax") > 0.06, "WRONG").otherwise("REVIEW").alias("lookup"), F.lit(11).alias("off"),
    )
    return verdicts.audio_verdict(rows, "sim", "seconds", "reference", "lookup", "off").select("id", "verdict")


def audio_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files have each verdict."""
    return judged_files(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (title_key, artist_key, album_base, paren_strip, path_sanitise, id_from_url, page_title_scrape, html_entity_audit, repeated_lines, pii_scan, code_format_validation, marks_to_seconds, repeated_position, audit_union, more_sections, file_sections, media_sections, pair_verdicts, audio_verdicts)}


def _sql(values: tuple[str, ...], column: str) -> str:
    quoted = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"(select * from (values {quoted}) x({column}))"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PLAIN = "strip_accents(lower(coalesce({0}, '')))"
_LETTERS = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
_BRACKETS = "'[\\(\\[][^\\)\\]]*[\\)\\]]'"
_BARE = f"regexp_replace({_PLAIN}, {_BRACKETS}, ' ', 'g')"


def _fill(template: str, value: str) -> str:
    return template.replace("{0}", value).replace("{{", "{").replace("}}", "}")


def _letters(value: str) -> str:
    return _fill(_LETTERS, value)


_T = f"(select title from {_sql(TITLES, 'title')} union all select distinct p_name from part)"
_A = f"(select artist from {_sql(ARTISTS, 'artist')} union all select c_name from customer)"
_CREDIT = "artist"
for _s in keys.CREDIT_SEPARATORS:
    _CREDIT = f"replace({_CREDIT}, '{_s}', ',')"
_ARTIST_BREAK = _q(r"\s*(,|&|\bfeat\.?|\bft\.?|\bx\b|\bcon\b|\by\b)\s*")
_B = f"(select album from {_sql(ALBUMS, 'album')} union all select distinct p_type from part)"
_C = f"(select code from {_sql(CODES, 'code')} union all select distinct p_brand from part)"
_CUT = _q(r'[/\\:*?"<>|]')
_KINDS = " union all ".join(f"select id, line, {_q(k)} kind, unnest(regexp_extract_all(value, {_q(p)})) as found from l" for k, p in keys.PRIVATE.items())

ORACLE_SQL = {
    "title_key": f"""with t as (select title, {_fill(_PLAIN, 'title')} f from {_T}), p as (select *, regexp_extract_all(f, '[\\(\\[]([^\\)\\]]*)[\\)\\]]', 1) inside, list_transform(string_split(regexp_replace(f, {_BRACKETS}, ' ', 'g'), ' - '), lambda x: trim(x)) parts from t),
      q as (select *, list_sort(list_distinct(list_transform(list_filter(list_transform(list_concat(inside, parts[2:]), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, {_q(keys.SAME_RECORDING)})), lambda x: {_letters('x')}))) kept from p)
      select title, {_letters('parts[1]')} || case when len(kept) > 0 then '|' || array_to_string(kept, '|') else '' end as key, {_letters("regexp_replace(" + _fill(_BARE, 'title') + ", '\\s+-\\s+.*$', '')")} base from q""",
    "artist_key": f"""select artist, {_letters("string_split(regexp_replace(" + _fill(_PLAIN, 'artist') + f", {_ARTIST_BREAK}, chr(1), 'g'), chr(1))[1]")} as key,
      string_split(regexp_replace(artist, {_q(r'(?i)\s*(,|&|\bfeat\b\.?|\bft\b\.?| x | con )\s*')}, chr(1), 'g'), chr(1))[1] as first, array_to_string(list_filter(list_transform(string_split({_CREDIT}, ','), lambda a: trim(a)), lambda a: a <> ''), '|') credits from {_A}""",
    "album_base": f"""select album, {_letters(_fill(_PLAIN, f"regexp_replace(album, {_q(keys.EDITION_TAIL)}, '', 'g')"))} base, {_letters(f"regexp_replace({_fill(_PLAIN, 'album')}, {_q(keys.EDITION_WORDS)}, ' ', 'g')")} core from {_B}""",
    "paren_strip": f"select {_letters(_fill(_BARE, 'line'))} as key, count(*) n from (select unnest(string_split(text, chr(10))) line from documents) group by 1",
    "path_sanitise": f"""with u as (select page_id, url, trim(regexp_replace(url, {_CUT}, '_', 'g')) f, regexp_replace(trim(regexp_replace(url || ' .. ', {_CUT}, '_', 'g')), '[. ]+$', '') d from pages)
      select page_id, case when f = '' then '_' else f end as file, case when d = '' then '_' else d end as dir, substr(url, 1, 20) cut from u""",
    "id_from_url": "with u as (select page_id, regexp_extract(string_split(url, '?')[1], '([^/:]*)$', 1) link_id from pages) select page_id, link_id, try_cast(nullif(regexp_extract(trim(link_id), '^([0-9]+)', 1), '') as int) number from u",
    "page_title_scrape": "select page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) title, regexp_extract(coalesce(html, ''), '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1) lang, len(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*href=')) n_links from pages",
    "html_entity_audit": "with p as (select page_id, len(regexp_extract_all(coalesce(html, ''), '&(apos|amp|quot|lt|gt|#[0-9]+);')) n_entities from pages) select * from p where n_entities > 0",
    "repeated_lines": "with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents) select doc_id, md5(line) line, count(*) n from l where line <> '' group by 1, 2 having count(*) > 1",
    "pii_scan": f"with l as (select id, cast(i as bigint) line, parts[i] as value from (select doc_id id, string_split(coalesce(text, ''), chr(10)) parts from documents) s, unnest(range(1, len(parts) + 1)) r(i)), f as ({_KINDS}) select * from f",
    "code_format_validation": f"""select code, regexp_matches(code, '^[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}$') isrc, case when code = '' then null when not regexp_matches(code, '^[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?$') then 'odd format' when cast(code[1:4] as int) not between 1900 and 2026 then 'year out of range' end date_problem from {_C}""",
    "marks_to_seconds": "with m as (select conv_id, turn * 60 + turn % 10 + 0.5 mark from conversations) select conv_id, count(*) n, cast(max(mark) as double) as last from m group by 1",
    "repeated_position": "select 'repeated position' section, 'fix' severity, l_orderkey || '/' || l_linenumber as key, cast(count(*) as varchar) detail from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "audit_union": """select 'odd isrc' section, 'fix' severity, cast(p_partkey as varchar) as key, p_brand detail from part where not regexp_matches(p_brand, '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$')
      union all select 'odd duration', 'decide', cast(p_partkey as varchar), cast(round(p_retailprice, 1) as varchar) from part where p_retailprice < 20 or p_retailprice > 1200
      union all select 'p_size outside list', 'fix', cast(p_partkey as varchar), cast(p_size as varchar) from part where p_size not between 1 and 45
      union all select 'mixed o_orderstatus', 'fix', cast(o_custkey as varchar), string_agg(distinct o_orderstatus, ',' order by o_orderstatus) from orders group by o_custkey having count(distinct o_orderstatus) > 1
      union all select 'missing tags', 'fix', cast(page_id as varchar), case when coalesce(url, '') = '' then case when coalesce(html, '') = '' then 'url,html' else 'url' end else 'html' end from pages where coalesce(url, '') = '' or coalesce(html, '') = ''
      union all select 'odd text', 'fix', cast(p_partkey as varchar), tag || ': ' || case when v <> trim(v) then 'edge spaces' else 'double space' end from (select p_partkey, 'p_name' tag, p_name v from part union all select p_partkey, 'p_type', p_type from part) where v <> trim(v) or contains(v, '  ')""",
    "more_sections": """with o as (select *, case o_custkey % 9 when 0 then 'Various Artists' when 1 then 'Soundtracks: t' || (o_custkey % 20) else 'c' || o_custkey end artist, case when o_orderpriority = '5-LOW' then 'Soundtrack' else o_orderpriority end g from orders),
      gs as (select distinct artist, g from o where artist <> 'Various Artists' and not (artist like 'Soundtracks%' and g = 'Soundtrack') and g is not null),
      cs as (select o_custkey, o_orderstatus, count(*) n from orders where o_orderstatus is not null group by all),
      ms as (select distinct 'a' || (o_custkey % 40) || '/f' || (o_custkey % 200) folder, 'x' || (cast(floor(o_custkey / 3) as bigint) % 70) id from orders where o_orderstatus <> 'F'), nm as (select *, case when id = 'x3' then id else upper(id) end as name from ms),
      jn as (select id, name, count(*) n, count(distinct string_split(folder, '/')[1]) artists, string_agg(folder, ' | ' order by folder) seen from nm group by id, name having count(*) > 1)
      select 'many genres' section, 'fix' severity, artist as key, string_agg(g, ' ; ' order by g) detail from gs group by artist having count(*) > 2
      union all select 'mixed covers', 'fix', cast(o_custkey as varchar), string_agg(o_orderstatus || '×' || n, ' / ' order by n desc, o_orderstatus) from cs group by o_custkey having count(*) > 1
      union all select 'split folder', 'fix', folder, string_agg(name, ' / ' order by name) from nm group by folder having count(*) > 1
      union all select case when artists < n then 'joined folders' else 'album of several artists' end, case when artists < n then 'fix' else 'info' end, name, seen from jn
      union all select 'damaged', 'fix', cast(o_orderkey as varchar), o_orderstatus from orders where o_orderkey % 97 = 1
      union all select 'unreadable', 'fix', cast(o_orderkey as varchar), 'broken' from orders where o_orderkey % 89 = 0
      union all select 'no checksum', 'info', cast(o_orderkey as varchar), null from orders where o_orderkey % 41 = 0
      union all select 'lossy', 'info', cast(o_orderkey as varchar), 'MP3' from orders where o_orderkey % 50 = 0
      union all select 'instrumental with lyrics', 'fix', cast(o_orderkey as varchar), null from orders where o_orderkey % 31 = 0 and coalesce(o_orderpriority, '') <> ''""",
    "file_sections": """with f as (select o_custkey || '/' || year(o_orderdate) || '/' || o_orderkey || case when o_orderstatus = 'P' then '.jpg' else '.flac' end path, cast(o_custkey as varchar) top, o_custkey || '/' || year(o_orderdate) dir from orders),
      d as (select cast(c_custkey as varchar) folder from customer union all select c_custkey || '/' || y from customer, unnest([1999, 2000, 2001]) u(y))
      select 'empty folder' section, 'fix' severity, folder as key, cast(null as varchar) detail from d where folder not in (select top from f) and folder not in (select dir from f)
      union all select 'not audio', 'fix', path, null from f where path like '%.jpg'
      union all select 'hardlinks', 'info', min('p' || o_orderkey), cast(count(*) as varchar) from orders group by o_orderkey % 9000 having count(*) > 1
      union all select 'several values', 'fix', cast(o_orderkey as varchar), 'mark: ' || o_orderstatus || ' ; ' || o_orderpriority[3] from orders where o_orderstatus <> o_orderpriority[3]""",
    "media_sections": """with i as (select l_linenumber n, l_quantity q, floor(l_extendedprice)::bigint % 700 + 1 w, floor(l_extendedprice)::bigint % 700 + l_linenumber * 5 h from lineitem),
      s as (select case when n = 1 then 'lyrics missing' when n = 2 then 'lyrics without marks' when 40 - q > 12 then 'lyrics too long' when 40 - q > 5 then 'lyrics slightly long' end section from i
        union all select 'cover missing' from i where n = 7 union all select 'cover too small' from i where n <> 7 and least(w, h) < 290 union all select 'cover small' from i where n <> 7 and least(w, h) between 290 and 499
        union all select 'cover not square' from i where n <> 7 and abs(w - h) > 0.05 * greatest(w, h) union all select 'cover not a front' from i where n = 6)
      select section, case when section in ('lyrics too long', 'cover missing', 'cover too small') then 'fix' else 'info' end severity, count(*) n from s where section is not null group by 1""",
    "pair_verdicts": """with r as (select 1 - round(l_discount * 100) * round(l_discount * 100) / 200 s, l_linenumber = 1 song, l_returnflag = 'R' ids, l_linenumber <= 4 alike, case when l_tax > 0 then 1 - round(l_tax * 100) / 25 end a, case when l_linenumber <> 3 then 0.9 end b, l_linestatus = 'O' title from lineitem)
      select case when s >= 0.9 then case when song then 'copies' when coalesce(a < 0.8, false) or coalesce(b < 0.8, false) then 'wrong audio' when a is null or b is null or a < 0.85 or b < 0.85 then 'same audio, unconfirmed'
        when s >= 0.98 and alike then case when title then 'copies' else 'same audio, two names' end else 'shared audio' end when s < 0.75 and ids and not song then 'wrong id' when s is not null then 'versions' end verdict, count(*) n from r group by 1""",
    "audio_verdicts": """with r as (select case when l_discount > 0 then 1 - 3 * l_discount end sim, l_quantity * 10 as seconds, case when l_linenumber % 2 = 0 then l_quantity * 10 + l_linenumber - 2 end ref, case when l_tax < 0.02 then 'OK' when l_tax > 0.06 then 'WRONG' else 'REVIEW' end lookup from lineitem),
      v as (select *, coalesce(abs(seconds - ref) > greatest(3.0, 0.01 * ref), false) other from r)
      select case when lookup = 'OK' then 'ok' when sim < 0.75 then 'wrong' when sim is null and ref is null and lookup = 'WRONG' then 'wrong' when not other and coalesce(sim, 0) >= 0.85 then 'ok' else 'doubtful' end verdict, count(*) n from v group by 1""",
}
