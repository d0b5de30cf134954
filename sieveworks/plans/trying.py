"""Queries on the trial funnel. Even parts stand for trial files, odd ones for the library; events for what happens to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import tolerance
from sieveworks.operators import funnel
from sieveworks.plans.listening import E, events
from sieveworks.sources.storage import shared_dir
from sieveworks.streaming import funnel as stream

#: The tables hold a month, so the funnel's days are fewer than its own.
RULES = stream.Rules(warn=4, delete=7, notice=2, adopt=5, window=10, least=3)


def trial_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole review: of the settled trial files each with what it is replaced by, when it was downloaded, how long it is idle, and the action on it."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    heard = events(spark, sf_dir).where("listen").withColumn("file", F.col("artist_key") * 10 + F.col("title_key"))
    end = heard.agg(F.max("ts")).scalar()
    songs = parts.select(F.col("p_partkey").alias("file"), F.col("p_partkey").alias("path"), F.concat(F.lit("I"), (F.col("p_partkey") % 700).cast("string")).alias("isrc"), (F.lit(100.0) + F.col("p_size")).alias("seconds"), F.col("p_brand").alias("artist"), F.col("p_type").alias("title"), F.col("p_size").alias("size"))
    ago = lambda unit, n: F.timestamp_add(unit, -n.cast("int"), end)
    files = songs.where("file % 2 = 0").drop("path").withColumns({"changed": ago("SECOND", F.col("size") * 20), "recorded": F.when(F.col("file") % 3 == 0, ago("DAY", F.col("size")))})
    files = funnel.downloaded(funnel.settled(files, "changed", end), ["recorded", "changed"])
    found = funnel.replacements(files, songs.where("file % 2 = 1 and path % 5 = 0").drop("file"), "file", "path", "isrc", "seconds", ["artist", "title"]).withColumnRenamed("path", "replaced_by")
    state = files.where("file % 8 = 0").select("file", F.when(F.col("file") % 16 == 0, ago("DAY", F.col("size") % 9)).alias("promoted"), F.when(F.col("file") % 16 == 8, ago("DAY", F.col("size") % 5)).alias("warned"))
    kept = funnel.live_state(state, files, "file")
    listens = funnel.trailing_listens(heard, "file", "ts", end, RULES.window)
    rows = files.join(found, "file", "left").join(kept, "file", "left").join(listens, "file", "left")
    rows = rows.withColumns({"replaced": F.col("replaced_by").isNotNull(), "starred": F.col("file") % 26 == 0})
    out = funnel.classify(rows, end, RULES.warn, RULES.delete, RULES.notice, RULES.adopt, RULES.least)
    return out.select("file", "replaced_by", F.date_format("downloaded", "yyyy-MM-dd HH:mm:ss").alias("downloaded"), F.round(F.col("idle_days") * 86400).cast("long").alias("idle_seconds"), "action")


def trial_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions on every file, day by day, as a stream over the events that ends when all are read: a signup adds or takes off a star, an error of high value brings the song into the library, all others are listens."""
    stream.use_state_store(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.when(F.col("event_type") == "signup", F.when(F.col("value") < 4, "starred").when(F.col("value") < 20, "unstarred").otherwise("listen")).when((F.col("event_type") == "error") & (F.col("value") >= 60), "library").otherwise("listen")
    told = rows.select(F.concat_ws("/", F.col("user_id").cast("string"), (k % 10).cast("string")).alias("item"), "ts", kind.alias("kind")).where(F.col("user_id").isNotNull() & k.isNotNull())
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    query = stream.trial_actions(stream.timed(told, "ts"), RULES).writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/actions").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.ACTIONS).parquet(f"{folder}/actions").select("item", F.date_format("day", "yyyy-MM-dd").alias("day"), "action", F.round("idle_days", 5).alias("idle_days"))


def _listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 30")
    return rows.select("event_id", F.concat_ws("/", F.col("event_type"), (F.col("user_id") % 20).cast("string")).alias("item"), "ts")


def trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every listen those of its item in the two days before."""
    return funnel.trailing_counts(_listens(spark, sf_dir), "item", "ts", days=2).select("event_id", "item", "recent")


def first_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each item first had three listens in two days."""
    return funnel.first_promotions(_listens(spark, sf_dir), "item", "ts", days=2).select("item", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


QUERIES = {f.__name__: f for f in (trial_review, trial_actions, trailing_counts, first_promotions)}
_TRAILING = "with l as (select event_id, event_type || '/' || user_id % 20 as item, ts from events where value >= 30 and event_type is not null and user_id is not null), c as (select *, count(*) over (partition by item order by ts range between interval 2 days preceding and current row) as recent from l)"

_R = RULES
_OTHER = "abs(f.seconds - l.seconds) > greatest(3, 0.01 * l.seconds)"
_SEC = "epoch(date_trunc('second', {0}))"

ORACLE_SQL = {
    "trailing_counts": f"{_TRAILING} select event_id, item, recent from c",
    "first_promotions": f"{_TRAILING} select item, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as ts from c where recent >= 3 group by 1",
    "trial_review": f"""{E}, h as (select artist_key * 10 + title_key as file, ts from e where listen), m as (select max(ts) as m from h),
      songs as (select p_partkey as file, 'I' || p_partkey % 700 as isrc, 100.0 + p_size as seconds, p_brand as artist, p_type as title, p_size as size from part),
      f as (select s.*, coalesce(case when file % 3 = 0 then m - size * interval 1 day end, m - size * 20 * interval 1 second) as downloaded,
          case when file % 16 = 0 then m - size % 9 * interval 1 day end as promoted, case when file % 16 = 8 then m - size % 5 * interval 1 day end as warned, m
        from songs s, m where file % 2 = 0 and {_SEC.format("m")} - {_SEC.format("m - size * 20 * interval 1 second")} >= 60),
      lib as (select file as path, isrc, seconds, artist, title from songs where file % 2 = 1 and file % 5 = 0),
      one as (select isrc, min(path) as path, min_by(seconds, path) as seconds from lib where coalesce(isrc, '') <> '' group by 1),
      by_isrc as (select f.file, l.path from f join one l on f.isrc = l.isrc where not ({_OTHER})),
      near as (select f.file, min(l.path) as path from f join lib l on f.artist = l.artist and f.title = l.title and abs(f.seconds - l.seconds) <= 3 where f.file not in (select file from by_isrc) group by 1 having count(*) = 1),
      got as (select * from by_isrc union all select * from near),
      t as (select file, count(*) filter (ts >= m - interval {_R.window} days) as recent, max(ts) as last_listen from h, m group by 1),
      r as (select f.*, got.path as replaced_by, coalesce(recent, 0) as recent, ({_SEC.format("m")} - {_SEC.format("coalesce(last_listen, downloaded)")}) / 86400.0 as idle,
          ({_SEC.format("m")} - {_SEC.format("promoted")}) / 86400.0 as promoted_days, ({_SEC.format("m")} - {_SEC.format("warned")}) / 86400.0 as warned_days, f.file % 26 <> 0 and promoted is null as free
        from f left join got on got.file = f.file left join t on t.file = f.file)
      select file, replaced_by, strftime(downloaded, '%Y-%m-%d %H:%M:%S') as downloaded, cast(round(idle * 86400) as bigint) as idle_seconds, case when replaced_by is not null then 'replace' when promoted_days >= {_R.adopt} then 'adopt' when promoted is null and recent >= {_R.least} then 'promote'
        when free and idle >= {_R.delete} and warned_days >= {_R.notice} then 'delete' when free and idle >= {_R.warn} and warned is null then 'warn' when free and warned is not null and idle < {_R.warn} then 'cancel' else 'keep' end as action from r""",
    "trial_actions": f"""with recursive k as (select *, try_cast(json_extract_string(props, '$.k') as int) as k from events),
      ev as (select user_id || '/' || k % 10 as item, ts, case when event_type = 'signup' then case when value < 4 then 'starred' when value < 20 then 'unstarred' else 'listen' end when event_type = 'error' and value >= 60 then 'library' else 'listen' end as kind
        from k where user_id is not null and k is not null and ts is not null),
      days as (select unnest(generate_series(date_trunc('day', min(ts)), max(ts) - interval 1 day, interval 1 day)) as day from ev),
      seen as (select item, day, min(ts) as downloaded, max(ts) filter (kind = 'listen') as last_listen, count(*) filter (kind = 'listen' and ts >= day - interval {_R.window} days) as recent,
          coalesce(arg_max(kind, ts) filter (kind in ('starred', 'unstarred')) = 'starred', false) as starred, bool_or(kind = 'library') as replaced
        from ev join days on ts <= day group by all),
      facts as (select *, epoch(day - coalesce(last_listen, downloaded)) / 86400.0 as idle, row_number() over (partition by item order by day) as n from seen),
      st as (
        select item, n - 1 as n, null::timestamp as day, null::timestamp as promoted, null::timestamp as warned, false as gone, 'keep' as action, null::double as idle from facts where n = 1
        union all
        select item, n, day, case when action = 'promote' then day else promoted end, case when action = 'warn' then day when action <> 'cancel' then warned end, gone or action in ('replace', 'adopt', 'delete'), case when gone then 'keep' else action end, idle
        from (select f.item, f.n, f.day, s.promoted, s.warned, s.gone, f.idle, case when replaced then 'replace' when s.promoted is not null and f.day - s.promoted >= interval {_R.adopt} days then 'adopt' when s.promoted is null and recent >= {_R.least} then 'promote'
            when starred or s.promoted is not null then 'keep' when s.warned is not null and f.idle >= {_R.delete} and f.day - s.warned >= interval {_R.notice} days then 'delete' when s.warned is null and f.idle >= {_R.warn} then 'warn'
            when s.warned is not null and f.idle < {_R.warn} then 'cancel' else 'keep' end as action
          from st s join facts f on f.item = s.item and f.n = s.n + 1))
      select item, strftime(day, '%Y-%m-%d') as day, action, round(idle, 5) as idle_days from st where action <> 'keep'""",
}
