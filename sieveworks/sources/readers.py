"""Readers of catalogues, histories, playlists, decision tables and scraped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions import keys

AUDIO_GLOB = "*.{flac,mp3,m4a,mp4,ogg,oga,opus}"
_AUDIO = r"(?i)^[^.].*\.(flac|mp3|m4a|mp4|ogg|oga|opus)$"

HISTORY = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField("reason_start", T.StringType()),
        T.StructField("reason_end", T.StringType()),
        T.StructField("spotify_track_uri", T.StringType()),
        T.StructField("master_metadata_track_name", T.StringType()),
        T.StructField("master_metadata_album_artist_name", T.StringType()),
        T.StructField("master_metadata_album_album_name", T.StringType()),
    ]
)
#: Ways of starting a song that are a choice of it.
DELIBERATE = ("clickrow", "playbtn", "backbtn")
PLAYLISTS = "playlists array<struct<name: string, items: array<struct<track: struct<trackName: string, artistName: string, albumName: string, trackUri: string>>>>>"
LOGS = "cambios array<struct<old_path: string, new_path: string>>, quitadas array<string>"


def is_audio(name: Column) -> Column:
    """Whether a file name is one of audio and not hidden."""
    return name.rlike(_AUDIO)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and time of the audio files under a folder, hidden files and folders left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return files.where(is_audio(F.element_at(F.split("path", "/"), -1)) & ~F.col("path").rlike(r"/\.[^/]"))


def lossy(extension: Column, codec: Column) -> Column:
    """Whether the format loses quality; an unknown one counts as lossless."""
    return F.when(extension.isin("mp3", "ogg", "oga", "opus"), True).when(extension.isin("m4a", "mp4"), F.coalesce(codec != "alac", F.lit(True))).otherwise(False)


def history(spark: SparkSession, path: str, names: str = "Streaming_History_Audio_*.json") -> DataFrame:
    """Streaming history from JSON arrays in files of the given names, at any depth; events without a link or a track name left out."""
    rows = spark.read.schema(HISTORY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path)
    return rows.where("coalesce(spotify_track_uri, '') <> '' and coalesce(master_metadata_track_name, '') <> ''")


def history_events(rows: DataFrame, deliberate: tuple[str, ...] = DELIBERATE) -> DataFrame:
    """History rows as events of song keys, see :mod:`sieveworks.operators.history`."""
    return rows.select(
        keys.artist_key(F.col("master_metadata_album_artist_name")).alias("artist_key"),
        keys.title_key(F.col("master_metadata_track_name")).alias("title_key"),
        keys.link_id(F.col("spotify_track_uri")).alias("sid"),
        F.to_timestamp("ts").alias("ts"),
        (F.coalesce("ms_played", F.lit(0)) >= 30_000).alias("listen"),
        F.coalesce(F.col("reason_end") == "trackdone", F.lit(False)).alias("done"),
        F.coalesce(F.col("reason_start").isin(*deliberate), F.lit(False)).alias("deliberate"),
    )


def account_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(playlist, pos, uri, artist, title) of an account export."""
    rows = spark.read.schema(PLAYLISTS).option("multiLine", True).json(path).select(F.explode("playlists").alias("p"))
    return rows.select(F.col("p.name").alias("playlist"), F.posexplode("p.items").alias("pos", "item")).select("playlist", "pos", F.col("item.track.trackUri").alias("uri"), F.col("item.track.artistName").alias("artist"), F.col("item.track.trackName").alias("title"))


def m3u(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(playlist, title, pos, path): the entries of playlist files in order; ``#PLAYLIST:`` names one, other comments are skipped. With ``folder``, in which the playlists lie, relative paths are resolved from there."""
    files = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("playlist"))
    title = F.nullif(F.trim(F.regexp_extract("value", r"(?m)^#PLAYLIST:(.*)$", 1)), F.lit(""))
    entries = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    rows = files.select("playlist", title.alias("title"), F.posexplode(entries).alias("pos", "path"))
    return rows if folder is None else rows.withColumn("path", keys.resolved_path(F.lit(folder), F.col("path")))


def decisions(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A tab-separated decision table; ``#`` starts a comment line, fields are trimmed, lines without a first field are skipped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return rows.select(*(F.trim(c).alias(c) for c in columns)).where(F.coalesce(F.col(columns[0]), F.lit("")) != "")


def json_state(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken texts) of JSON lines; a broken line never hides the others."""
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r._broken is null").select("r.*").drop("_broken"), parsed.where("r._broken is not null").select(F.col("value").alias("broken"))


def change_logs(spark: SparkSession, pending: str, explicit: str | None = None) -> DataFrame:
    """(seq, old, new): the records of change-log files in order; new is null for a removal.

    ``explicit`` files come first, by the time of their last change, then the ``pending``
    ones by name. Within a file changes come before removals. Changes with an empty end and
    removals of nothing are skipped.
    """
    files = _logs(spark, pending, F.lit(1), F.lit(None).cast("timestamp"))
    if explicit is not None:
        files = _logs(spark, explicit, F.lit(0), F.col("_metadata.file_modification_time")).unionByName(files)
    return _numbered(files)


def _numbered(files: DataFrame) -> DataFrame:
    file = ["source", "changed", "file"]
    moved = files.select(*file, F.posexplode("cambios").alias("pos", "c")).select(*file, F.lit(0).alias("kind"), "pos", F.col("c.old_path").alias("old"), F.col("c.new_path").alias("new"))
    gone = files.select(*file, F.posexplode("quitadas").alias("pos", "old")).select(*file, F.lit(1).alias("kind"), "pos", "old", F.lit(None).cast("string").alias("new"))
    rows = moved.where("coalesce(old, '') <> '' and coalesce(new, '') <> ''").unionByName(gone.where("coalesce(old, '') <> ''"))
    # one number in file order without a global sort of the records: the window has one row a file
    sizes = rows.groupBy(*file).agg(F.max("pos").alias("most"))
    number = F.sum(2 * (F.col("most") + 1)).over(W.orderBy(*file).rowsBetween(W.unboundedPreceding, 0)) - 2 * (F.col("most") + 1)
    starts = sizes.select(F.col("source").alias("_source"), F.col("file").alias("_file"), "most", number.alias("start"))
    joined = rows.join(starts, (F.col("source") == F.col("_source")) & (F.col("file") == F.col("_file")))
    return joined.select((F.col("start") + F.col("kind") * (F.col("most") + 1) + F.col("pos")).cast("long").alias("seq"), "old", "new")


def change_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change-log files as a stream, one row a file as :func:`batch_records` takes them; new files are read as they appear."""
    rows = spark.readStream.schema(LOGS).option("multiLine", True).json(folder)
    return rows.select("cambios", "quitadas", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def batch_records(files: DataFrame) -> DataFrame:
    """(seq, old, new): the records of one batch of change-log files, by name, as :func:`change_logs` orders them."""
    return _numbered(files.withColumns({"source": F.lit(1), "changed": F.lit(None).cast("timestamp")}))


def _logs(spark: SparkSession, path: str, source: Column, changed: Column) -> DataFrame:
    return spark.read.schema(LOGS).option("multiLine", True).json(path).select("cambios", "quitadas", source.alias("source"), changed.alias("changed"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


#: Tables of a player's database and the columns that are used of each.
PLAYER = {
    "media_file": "id string, path string, missing boolean, created_at timestamp, artist string, title string, tags string, album_id string, mbz_recording_id string",
    "scrobbles": "media_file_id string, submission_time double",
    "annotation": "item_type string, item_id string, user_id string, play_count long, play_date timestamp, starred boolean, starred_at timestamp, rating int",
    "playlist": "id string, name string, owner_id string, path string, public boolean, song_count int",
    "playlist_tracks": "playlist_id string, id long, media_file_id string",
    "album": "id string, name string",
    "user": "id string, user_name string",
}


def player_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a player's database, exported as Parquet ``folder/table.parquet``, with the columns of :data:`PLAYER`; absent ones are null."""
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return rows.select(*((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in (c.split() for c in PLAYER[table].split(", "))))


def library_scan(spark: SparkSession, path: str, facts: str) -> DataFrame:
    """Facts about audio files from JSON lines with the schema ``facts``; a line that can't be read stays as a row with its text in ``error``."""
    text = spark.read.text(path)
    parsed = F.from_json("value", f"{facts}, error string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    return text.where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title, lang, n_links and n_entities scraped from the markup."""
    page = F.coalesce(F.col(html), F.lit(""))
    return pages.withColumns(
        {
            "title": F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)),
            "lang": F.regexp_extract(page, r'(?i)<html[^>]*\slang="([^"]*)"', 1),
            "n_links": F.regexp_count(page, F.lit(r"(?i)<a\s[^>]*href=")).cast("long"),
            "n_entities": F.regexp_count(page, F.lit("&(apos|amp|quot|lt|gt|#[0-9]+);")).cast("long"),
        }
    )


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with what a song's page says of itself: ``meta`` (property or name to content, the last of a repeated name), ``data`` (the JSON of a __NEXT_DATA__ script, else null), and its ``duration_ms`` and ``preview`` link."""
    page = F.coalesce(F.col(html), F.lit(""))
    tag = r"""(?is)<meta\s+(?:property|name)=["']([^"']+)["']\s+content=["']([^"']*)["']"""
    names = F.transform(F.regexp_extract_all(page, F.lit(tag), F.lit(1)), F.lower)
    # what leaves the JVM is a column of its own: lambdas can't hold it
    pages = pages.withColumn("_values", keys.unescaped_each(F.regexp_extract_all(page, F.lit(tag), F.lit(2))))
    values = F.col("_values")
    last = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("key"), F.get(values, F.size(names) - F.array_position(F.reverse(names), n).cast("int")).alias("value")))
    data = F.nullif(F.regexp_extract(page, r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(page, r'"duration(?:_ms|Ms)?":\s*(?:\{"totalMilliseconds":\s*)?([0-9]+)', 1), F.lit("")).cast("long")
    preview = F.nullif(F.regexp_extract(page, r'"audioPreview":\s*\{\s*"url":\s*"([^"]+)"', 1), F.lit(""))
    return pages.withColumns({"meta": F.map_from_entries(last), "data": data, "duration_ms": number, "preview": preview}).drop("_values")


def song_records(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, title, artists, album, album_id, year, seconds, error) of songs' pages.

    The description lists artists, album, kind and year between middle dots. A page
    without a title or without a link to its album has no record: ``error`` says so and the
    rest is null.
    """
    m = lambda name: F.coalesce(F.try_element_at("meta", F.lit(name)), F.lit(""))
    rows = page_metadata(pages, html).select(id_col, m("og:title").alias("title"), F.split(m("og:description"), " · ", -1).alias("parts"), F.regexp_extract(m("music:album"), r"/album/([A-Za-z0-9]+)", 1).alias("album_id"), F.coalesce(m("music:duration").try_cast("long"), F.lit(0)).alias("seconds"))
    good = (F.col("title") != "") & (F.col("album_id") != "")
    part = lambda i: F.coalesce(F.get("parts", F.lit(i)), F.lit(""))
    record = {"title": F.col("title"), "artists": F.transform(F.split(part(0), ",", -1), lambda a: F.trim(a)), "album": part(1), "album_id": F.col("album_id"), "year": part(3), "seconds": F.col("seconds")}
    return rows.select(id_col, *(F.when(good, c).alias(name) for name, c in record.items()), F.when(~good, "no record").alias("error"))


def album_records(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, album, album_artist, place, song, title, artist, seconds, error): the track lists that albums' pages hold as data.

    ``place`` counts all entries from 1, songs of other kinds aren't returned; the first of
    a song's artists counts. A page without data, or whose data isn't JSON or lacks an
    album, gives one row with an ``error``; an album without songs gives none.
    """
    data = page_metadata(pages, html).select(id_col, "data", F.try_parse_json("data").alias("_all"))
    rows = data.withColumn("_album", F.try_variant_get("_all", "$.props.pageProps.state.data.entity", "variant"))
    why = F.when(F.col("data").isNull(), "no data").when(F.col("_all").isNull(), "not JSON").when(F.col("_album").isNull() | F.is_variant_null("_album"), "no album")
    text = lambda v, path: keys.unescaped(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    # a page is read once: names are resolved before its tracks are rows, and pages with an error stay as one row
    pages = rows.select(id_col, text("_album", "$.name").alias("_name"), text("_album", "$.subtitle").alias("_by"), F.try_variant_get("_album", "$.trackList", "variant").alias("_list"), why.alias("error"))
    each = pages.lateralJoin(pages.sparkSession.tvf.variant_explode_outer(F.when(F.col("error").isNull(), F.col("_list")).outer()))
    uri = F.try_variant_get("value", "$.uri", "string")
    tracks = each.where(F.col("error").isNotNull() | F.col("key").isNull() & F.col("pos").isNotNull() & uri.startswith("spotify:track:"))
    artist = F.trim(F.split(F.replace(text("value", "$.subtitle"), F.lit("\u00a0"), F.lit(" ")), ",")[0])
    seconds = F.bround(F.coalesce(F.try_variant_get("value", "$.duration", "double"), F.lit(0.0)) / 1000).cast("long")
    song = {"album": F.col("_name"), "album_artist": F.col("_by"), "place": F.col("pos") + 1, "song": F.element_at(F.split(uri, ":"), -1), "title": text("value", "$.title"), "artist": artist, "seconds": seconds}
    return tracks.select(id_col, *(F.when(F.col("error").isNull(), c).alias(name) for name, c in song.items()), "error")


def player_tags(media: DataFrame, id_col: str = "id", tags: str = "tags") -> DataFrame:
    """(id, tag, pos, value, error): the tags that a player keeps as JSON, ``{tag: [{"value": ...}, ...]}``, one row a value.

    Text that isn't a JSON object gives one row with it in ``error``; null, and tags that
    are no list or whose entries have no value, give none.
    """
    rows = media.select(F.col(id_col).alias("id"), F.col(tags).alias("_text"), F.try_parse_json(tags).alias("_all"))
    rows = rows.withColumn("error", F.when(F.col("_text").isNotNull() & ~F.coalesce(F.schema_of_variant("_all").startswith("OBJECT"), F.lit(False)), F.col("_text")))
    tvf = media.sparkSession.tvf
    each = rows.where("error is null").lateralJoin(tvf.variant_explode(F.col("_all").outer())).select("id", F.col("key").alias("tag"), F.col("value").alias("_list"))
    values = each.lateralJoin(tvf.variant_explode(F.col("_list").outer())).where("key is null and pos is not null")
    values = values.select("id", "tag", "pos", F.try_variant_get("value", "$.value", "string").alias("value"), F.lit(None).cast("string").alias("error")).where("value is not null")
    return values.unionByName(rows.where("error is not null").select("id", "error"), allowMissingColumns=True)


def library_ids(media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(isrc) and (recording) of the songs that aren't missing: what is owned under whatever name."""
    here = media.where("coalesce(missing, false) = false")
    isrcs = player_tags(here).where("tag = 'isrc'").select(F.upper("value").alias("isrc")).where("isrc <> ''").distinct()
    return isrcs, here.select(F.col("mbz_recording_id").alias("recording")).where("coalesce(recording, '') <> ''").distinct()


def lookup_status(lookups: DataFrame, body: str = "body") -> DataFrame:
    """``status`` of cached lookups: found, absent ({} or not found) or unknown (no answer); unknown is never absent."""
    value = F.col(body)
    return lookups.withColumn("status", F.when(value.isNull(), "unknown").when(F.trim(value) == "{}", "absent").otherwise("found"))


def unprocessed(tracks: DataFrame, path: str = "path", gain: str = "replaygain_track_gain") -> DataFrame:
    """Files at the wrong depth, with a name outside the pattern, or without a gain tag."""
    depth = F.size(F.split(path, "/"))
    name = F.element_at(F.split(path, "/"), -1)
    why = F.when(depth != 3, "depth").when(~name.rlike(r"^[0-9]{2,3} - .+\.[A-Za-z0-9]+$"), "name").when(F.coalesce(F.col(gain), F.lit("")) == "", "gain")
    return tracks.withColumn("why", why).where("why is not null")
