"""Queries on shops' offers, pages of songs and albums, and a player's JSON tags, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import match
from sieveworks.sources import readers


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def store_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as songs and as the offers of four shops, two of which are looked through again by how titles begin."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (100.0 + F.col("p_size")).alias("seconds"))
    k = F.col("k")
    artist, title = _text("Art ", k % 11), _text("Song ", k % 40)
    songs = part.select(k.alias("song"), F.when(k % 4 == 0, _text(artist, " & Duo")).otherwise(artist).alias("artist"), F.when(k % 5 == 0, _text(title, " - Remix")).when(k % 5 == 1, _text(title, " (Remastered 2009)")).otherwise(title).alias("title"), F.when(k % 6 != 0, F.col("seconds")).alias("seconds"))
    names = F.array_compact(F.array(F.when(k % 3 == 0, _text(artist, " 4.40")).otherwise(artist), F.when(k % 7 == 0, F.lit("Duo"))))
    offers = part.where("k % 10 < 7").select(k.alias("offer"), ((k / 10).cast("long") % 4).alias("store"), names.alias("artists"), F.when(k % 6 == 1, _text(title, " - Remix")).when(k % 6 == 2, _text(title, " Extended")).otherwise(title).alias("title"), (F.col("seconds") + F.col("k") % 3).alias("seconds"))
    return match.shop_matches(songs, offers, looser=[2, 3])


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a player's songs, their tags as it keeps them: some broken, some no object, some null."""
    k = F.col("p_partkey")
    value = lambda c: F.struct(c.alias("value"))
    tags = F.to_json(F.struct(F.when(k % 2 == 0, F.array(value(_text("i", k % 300)), value(_text("J", k)))).otherwise(F.array(value(_text("i", k % 300)))).alias("isrc"), F.array(value(F.col("p_brand"))).alias("genre"), F.col("p_size").alias("bpm")))
    text = F.when(k % 17 == 0, F.substring(tags, 1, 20)).when(k % 19 == 0, None).when(k % 23 == 0, F.lit("[1]")).otherwise(tags)
    return _t(spark, sf_dir, "part").select(k.alias("id"), text.alias("tags"), (k % 5 == 0).alias("missing"), F.when(k % 3 == 0, _text("r", k)).alias("mbz_recording_id"))


def player_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.player_tags(_media(spark, sf_dir))


def unknown_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recommendations of which neither the ISRC nor the recording is in the library."""
    isrcs, recordings = readers.library_ids(_media(spark, sf_dir))
    wanted = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _text("I", F.col("p_partkey") * 7).alias("isrc"), _text("r", F.col("p_partkey") * 2).alias("recording"))
    return match.missing(wanted, [(isrcs, ["isrc"]), (recordings, ["recording"])])


def song_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that parts' pages give; names are escaped twice on them, and an old title stands first."""
    k = F.col("p_partkey")
    meta = lambda name, value: _text(f'<meta property="{name}" content="', value, '">')
    html = _text("<html><head>", meta("og:title", F.lit("old")), meta("og:title", _text(F.col("p_name"), " &amp;amp; caf&amp;eacute;")), meta("og:description", _text(F.col("p_brand"), ", Guest · ", F.col("p_type"), " · Song · ", 1990 + F.col("p_size"))), meta("music:duration", F.col("p_size") + 100))
    album = F.when(k % 11 == 0, F.lit("")).otherwise(meta("music:album", _text("https://open.spotify.com/album/a", k % 7)))
    pages = _t(spark, sf_dir, "part").select(k.alias("page"), F.when(k % 13 != 0, _text(html, album, "</head></html>")).alias("html"))
    out = readers.song_records(pages, "page")
    return out.select("page", "title", F.array_join("artists", "|").alias("artists"), "album", "album_id", "year", "seconds", "error")


def album_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track lists of orders' pages; every fifth part is no song, some data is broken or absent."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = lambda x: F.when(x["l_partkey"] % 5 == 0, "episode").otherwise("track")
    track = lambda x: F.struct(F.concat(F.lit("spotify:"), kind(x), F.lit(":p"), x["l_partkey"].cast("string")).alias("uri"), F.concat(F.lit("T "), x["l_linenumber"].cast("string")).alias("title"), F.lit("First One, Second").alias("subtitle"), (x["l_quantity"] * 1000 + 500).cast("long").alias("duration"))
    entity = F.struct(_text("Order ", F.col("l_orderkey")).alias("name"), F.lit("Many").alias("subtitle"), F.transform("items", track).alias("trackList"))
    nested = entity
    for name in ("entity", "data", "state", "pageProps", "props"):
        nested = F.struct(nested.alias(name))
    data = F.when(F.col("l_orderkey") % 29 == 0, F.lit('{"props":')).otherwise(F.to_json(nested))
    html = F.when(F.col("l_orderkey") % 31 != 0, _text('<script id="__NEXT_DATA__" type="application/json">', data, "</script>"))
    return readers.album_records(lists.select(F.col("l_orderkey").alias("page"), html.alias("html")), "page")


QUERIES = {f.__name__: f for f in (store_matching, player_tag_rows, unknown_by_ids, song_pages, album_pages)}

_MEDIA = """with m as (select p_partkey as id, case when p_partkey % 17 = 0 then left('{"isrc":[{"value":"i' || p_partkey % 300, 20) when p_partkey % 19 = 0 then null when p_partkey % 23 = 0 then '[1]' else '' end as error,
    case when p_partkey % 2 = 0 then ['i' || p_partkey % 300, 'J' || p_partkey] else ['i' || p_partkey % 300] end as isrcs, p_brand, p_partkey % 5 = 0 as missing, case when p_partkey % 3 = 0 then 'r' || p_partkey end as rec from part),
  tags as (select id, 'isrc' as tag, cast(unnest(range(len(isrcs))) as int) as pos, unnest(isrcs) as value, missing from m where error = '' union all select id, 'genre', 0, p_brand, missing from m where error = '')"""

ORACLE_SQL = {
    "store_matching": """with s as (select p_partkey as song, 'art' || p_partkey % 11 as first, case when p_partkey % 4 = 0 then ['art' || p_partkey % 11, 'duo'] else ['art' || p_partkey % 11] end as names, 'song' || p_partkey % 40 as base,
        'song' || p_partkey % 40 || case when p_partkey % 5 = 0 then '|remix' else '' end as title, case when p_partkey % 6 <> 0 then 100.0 + p_size end as sec from part),
      o as (select p_partkey as offer, p_partkey // 10 % 4 as store, list_filter(['art' || p_partkey % 11 || case when p_partkey % 3 = 0 then '440' else '' end, case when p_partkey % 7 = 0 then 'duo' end], lambda x: x is not null) as names,
        'song' || p_partkey % 40 || case p_partkey % 6 when 1 then '|remix' when 2 then 'extended' else '' end as title, 'song' || p_partkey % 40 || case p_partkey % 6 when 1 then 'remix' when 2 then 'extended' else '' end as whole, 100.0 + p_size + p_partkey % 3 as sec from part where p_partkey % 10 < 7),
      p as (select song, offer, store, s.sec as known, abs(o.sec - s.sec) as off, s.title = o.title as same, starts_with(whole, base) as begins from s join o on list_has_any(s.names, o.names) or len(list_filter(o.names, lambda n: contains(n, s.first))) > 0),
      good as (select song, offer, store, case when known is null then 'review' else 'ok' end as state, coalesce(off, 0.0) as off, 0 as late from p where same and (known is null or off <= greatest(3, 0.01 * (select sec from s where s.song = p.song)))
        union all select song, offer, store, 'review title', off, 1 from p where store in (2, 3) and known is not null and begins and off <= 1),
      best as (select song, first(struct_pack(offer, store, state, off) order by late, store, off, offer) as b from good group by 1)
      select s.song, b.offer as offer, b.store as store, coalesce(b.state, 'none') as state, cast(b.off as double) as seconds_off from s left join best using (song)""",
    "player_tag_rows": f"{_MEDIA} select id, tag, pos, value, null as error from tags union all select id, null, null, null, error from m where error <> ''",
    "unknown_by_ids": f"""{_MEDIA} select p_partkey as id, 'I' || p_partkey * 7 as isrc, 'r' || p_partkey * 2 as recording from part where 'I' || p_partkey * 7 not in (select upper(value) from tags where tag = 'isrc' and not missing)
      and 'r' || p_partkey * 2 not in (select rec from m where not missing and rec is not null)""",
    "song_pages": """with r as (select p_partkey as page, p_name || ' & café' as title, p_brand || '|Guest' as artists, p_type as album, 'a' || p_partkey % 7 as album_id, cast(1990 + p_size as varchar) as year, cast(p_size + 100 as bigint) as seconds, p_partkey % 13 <> 0 and p_partkey % 11 <> 0 as good from part)
      select page, case when good then title end as title, case when good then artists end as artists, case when good then album end as album, case when good then album_id end as album_id, case when good then year end as year, case when good then seconds end as seconds, case when not good then 'no record' end as error from r""",
    "album_pages": """with t as (select l_orderkey as page, l_partkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as place from lineitem)
      select page, 'Order ' || page as album, 'Many' as album_artist, place, 'p' || l_partkey as song, 'T ' || l_linenumber as title, 'First One' as artist, cast(round_even((l_quantity * 1000 + 500) / 1000, 0) as bigint) as seconds, null as error from t where l_partkey % 5 <> 0 and page % 29 <> 0 and page % 31 <> 0
      union all select distinct page, null, null, null, null, null, null, null, case when page % 31 = 0 then 'no data' else 'not JSON' end from t where page % 29 = 0 or page % 31 = 0""",
}
