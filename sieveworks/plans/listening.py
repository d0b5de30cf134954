"""Listening-history queries. Events stand for plays: the user is the artist, k modulo 10 the song, k the variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import funnel, history, match

SONG = ["artist_key", "title_key"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").try_cast("int")
    value = F.coalesce("value", F.lit(0.0))
    return rows.select(
        F.col("user_id").alias("artist_key"), (k % 10).alias("title_key"), k.alias("sid"), "ts", "event_type",
        (value >= 30).alias("listen"), F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("done"), F.coalesce(F.col("event_type") == "click", F.lit(False)).alias("deliberate"),
    )


E = """with e as (select user_id artist_key, k % 10 title_key, k sid, ts, event_type, coalesce(value, 0) >= 30 as listen,
  coalesce(event_type = 'purchase', false) as done, coalesce(event_type = 'click', false) as deliberate
  from (select *, try_cast(json_extract_string(props, '$.k') as int) k from events))"""
S = f"""{E}, s as (select artist_key, title_key, count(*) starts, count(*) filter (done) done, count(*) filter (listen) listens,
  count(distinct cast(ts as date)) filter (listen) as days, count(distinct cast(ts as date)) filter (deliberate) chosen_days,
  min(ts) filter (listen) first_listen, max(ts) filter (listen) last_listen from e group by all)"""


def _shown(songs: DataFrame) -> DataFrame:
    """Times as text, which compares alike everywhere."""
    return songs.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_listen", "last_listen")})


def song_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.song_history(events(spark, sf_dir)))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    end = rows.agg(F.max("ts")).scalar()
    return history.select_songs(history.song_history(rows), end, recent_days=10)


def select_rules_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select(*SONG, "listens", "days", "chosen_days", "rules", "excluded")


def rule_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rule_tallies(_selected(spark, sf_dir))


def favourite_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.favourite_variant(events(spark, sf_dir))


def artist_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.artist_strength(history.song_history(events(spark, sf_dir)))


def listened_as_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type stands for an album of ten tracks."""
    rows = events(spark, sf_dir)
    editions = rows.select("event_type").distinct().withColumn("tracks", F.lit(10))
    return history.listened_albums(rows, editions, ["artist_key", "event_type"], "title_key").select("artist_key", "event_type", "titles", "days", "share")


def history_rollup_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    entities = {"part": F.col("l_partkey"), "supplier": F.col("l_suppkey"), "order": F.col("l_orderkey")}
    out = history.entity_rollup(items, entities, F.col("l_quantity"), F.col("l_shipdate"))
    return out.select("kind", "entity", "n", F.round("amount", 4).alias("amount"), F.date_format("last", "yyyy-MM-dd").alias("last"))


def capped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.capped_histogram(history.song_history(events(spark, sf_dir)), "listens")


def rediscovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(history.rediscovery(history.song_history(events(spark, sf_dir)), 10)).select(*SONG, "listens", "last_listen")


def recent_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs first heard at most 20 whole days before the newest event, with three listens."""
    rows = events(spark, sf_dir)
    end = rows.agg(F.max("ts")).scalar()
    since = F.floor((F.unix_timestamp(end) - F.unix_timestamp("first_listen")) / 86400)
    return history.song_history(rows).withColumn("since", since).where("since <= 20 and listens >= 3").select(*SONG, "listens", "since")


def fallback_majority_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's path: the own one of even variants, else that of most of the song's events."""
    rows = events(spark, sf_dir).withColumn("path", F.when(F.col("sid") % 2 == 0, F.concat(F.lit("p"), F.col("sid").cast("string"))))
    usual = match.majority_path(rows, SONG, "path").withColumnRenamed("path", "usual")
    out = rows.join(usual, SONG, "left").select(F.coalesce("path", "usual").alias("path"), "listen")
    return out.groupBy("path").agg(F.count("*").alias("n"), F.count_if("listen").alias("listens"))


def play_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("path", F.concat_ws("/", F.col("artist_key").cast("string"), F.col("title_key").cast("string")))
    out = history.play_counts(rows, rows)
    return out.select("path", "plays", F.date_format("last_play", "yyyy-MM-dd HH:mm:ss").alias("last_play"))


def followed_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type stands for a playlist of the songs that occur in it."""
    rows = events(spark, sf_dir)
    songs = history.song_history(rows)
    lists = rows.select("event_type", *SONG).distinct()
    return history.followed_playlists(lists, songs, "event_type", SONG, least_listens=20)


def trailing_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("listen").withColumn("item", F.concat_ws("/", F.col("artist_key").cast("string"), F.col("title_key").cast("string")))
    end = rows.agg(F.max("ts")).scalar()
    month = funnel.promotions(rows, "item", "ts", end).withColumn("window_days", F.lit(28))
    week = funnel.promotions(rows, "item", "ts", end, days=7).withColumn("window_days", F.lit(7))
    return month.unionByName(week)


def funnel_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song as a trial file: warned after 5 idle days, deleted after 10; songs with an odd artist were warned 3 days ago, every seventh artist's are starred, every fifth's were promoted 3 or 20 days ago."""
    rows = events(spark, sf_dir).where("listen")
    end = rows.agg(F.max("ts")).scalar()
    heard = rows.groupBy(*SONG).agg(F.max("ts").alias("last_listen"), F.min("ts").alias("downloaded"))
    files = heard.withColumns(
        {
            "recent": F.col("title_key") % 5, "replaced": F.col("artist_key") % 11 == 0, "starred": F.col("artist_key") % 7 == 0,
            "promoted": F.when(F.col("artist_key") % 10 == 0, end - F.expr("interval 20 days")).when(F.col("artist_key") % 5 == 0, end - F.expr("interval 3 days")),
            "warned": F.when(F.col("artist_key") % 2 == 1, end - F.expr("interval 3 days")),
        }
    )
    return funnel.classify(files, end, warn=5, delete=10, notice=2).select(*SONG, F.round("idle_days", 6).alias("idle_days"), "action")


QUERIES = {f.__name__: f for f in (song_history, select_rules_v4, rule_tallies, favourite_variant, artist_strength, listened_as_album, history_rollup_entities, capped_histogram, rediscovery, recent_discovery, fallback_majority_path, play_counts, followed_playlists, trailing_promote, funnel_states)}

_SHOWN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_RULES = f"""{S}, a as (select artist_key, count(*) songs from s where listens >= 2 group by 1), m as (select max(ts) m from e),
  r as (select s.*, list_filter([case when listens >= 10 then '1' end, case when listens >= 3 and days >= 3 then '2' end, case when chosen_days >= 2 then '3' end,
    case when coalesce(songs, 0) >= 4 and listens >= 2 and days >= 2 and (year(last_listen) >= year(m) - 1 or listens >= 3) then '4' end,
    case when floor((epoch(date_trunc('second', m)) - epoch(date_trunc('second', first_listen))) / 86400) <= 10 and listens >= 3 then '5' end], lambda x: x is not null) rules
    from s left join a using (artist_key), m)"""

ORACLE_SQL = {
    "song_history": f"{S} select artist_key, title_key, starts, done, listens, days, chosen_days, {_SHOWN.format('first_listen')} first_listen, {_SHOWN.format('last_listen')} last_listen from s",
    "select_rules_v4": f"{_RULES} select artist_key, title_key, listens, days, chosen_days, array_to_string(rules, ',') rules, done < 0.25 * starts and chosen_days = 0 excluded from r where len(rules) > 0",
    "rule_tallies": f"{_RULES} select rule, count(*) n from (select unnest(rules) rule from r) group by 1",
    "favourite_variant": f"{E}, v as (select artist_key, title_key, sid, count(*) filter (listen) n from e group by all) select artist_key, title_key, first(sid order by n desc, sid) favourite, cast(sum(n) as bigint) listens from v group by all",
    "artist_strength": f"{S} select artist_key, count(*) songs from s where listens >= 2 group by 1",
    "listened_as_album": f"{E} select artist_key, event_type, count(distinct title_key) titles, count(distinct cast(ts as date)) as days, round(count(distinct title_key) / 10.0, 6) as share from e where listen group by all having titles >= 4 and days >= 3 and count(distinct title_key) / 10.0 >= 0.7",
    "history_rollup_entities": """select kind, entity, count(*) n, round(sum(q), 4) amount, strftime(max(d), '%Y-%m-%d') as last from (
      select 'part' kind, cast(l_partkey as varchar) entity, l_quantity q, l_shipdate d from lineitem union all select 'supplier', cast(l_suppkey as varchar), l_quantity, l_shipdate from lineitem
      union all select 'order', cast(l_orderkey as varchar), l_quantity, l_shipdate from lineitem) where entity is not null group by all""",
    "capped_histogram": f"{S} select least(listens, 5) as value, count(*) n from s group by 1",
    "rediscovery": f"{S} select artist_key, title_key, listens, {_SHOWN.format('last_listen')} last_listen from s where last_listen < (select max(last_listen) from s) - interval 10 days or last_listen is null",
    "recent_discovery": f"{S}, d as (select *, cast(floor((epoch(date_trunc('second', (select max(ts) from e))) - epoch(date_trunc('second', first_listen))) / 86400) as bigint) since from s) select artist_key, title_key, listens, since from d where since <= 20 and listens >= 3",
    "fallback_majority_path": f"{E}, p as (select *, case when sid % 2 = 0 then 'p' || sid end path from e), c as (select artist_key, title_key, path, count(*) n from p where path is not null group by all), u as (select artist_key, title_key, first(path order by n desc, path) usual from c group by all) select coalesce(path, usual) path, count(*) n, count(*) filter (listen) listens from p left join u using (artist_key, title_key) group by 1",
    "play_counts": f"{E} select artist_key || '/' || title_key path, count(*) filter (listen) plays, {_SHOWN.format('max(ts) filter (listen)')} last_play from e group by 1",
    "followed_playlists": f"{S}, l as (select distinct event_type, artist_key, title_key from e), j as (select * from l join s using (artist_key, title_key)), t as (select event_type from j group by 1 having sum(listens) >= 20) select event_type, artist_key, title_key, listens from j where event_type in (select event_type from t) and listens >= 2 and done >= 1",
    "trailing_promote": f"{E}, i as (select artist_key || '/' || title_key item, ts from e where listen), m as (select max(ts) m from i) select item, count(*) recent, 28 window_days from i, m where ts >= m - interval 28 days group by 1 having count(*) >= 3 union all select item, count(*), 7 from i, m where ts >= m - interval 7 days group by 1 having count(*) >= 3",
    "funnel_states": f"""{E}, i as (select artist_key, title_key, max(ts) last_listen from e where listen group by all), m as (select max(last_listen) m from i),
      f as (select *, (epoch(date_trunc('second', m)) - epoch(date_trunc('second', last_listen))) / 86400.0 idle, artist_key % 2 = 1 warned, artist_key % 7 = 0 starred, artist_key % 5 = 0 promoted from i, m)
      select artist_key, title_key, round(idle, 6) idle_days, case when artist_key % 11 = 0 then 'replace' when promoted then case when artist_key % 10 = 0 then 'adopt' else 'keep' end when title_key % 5 >= 3 then 'promote' when starred then 'keep'
        when warned then case when idle < 5 then 'cancel' when idle >= 10 then 'delete' else 'keep' end when idle >= 5 then 'warn' else 'keep' end as action from f""",
}
