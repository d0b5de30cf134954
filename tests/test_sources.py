"""Readers, writers and the streaming funnel."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sieveworks.operators import changes, funnel
from sieveworks.sources import readers, writers
from sieveworks.streaming import funnel as stream


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_history(spark, tmp_path):
    event = lambda **x: {"ts": "2024-01-01T00:00:00Z", "ms_played": 31000, "reason_start": "clickrow", "reason_end": "trackdone", "spotify_track_uri": "spotify:track:a", "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "X & Y", "master_metadata_album_album_name": "L"} | x
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps([event(), event(spotify_track_uri=None), event(ms_played=None, master_metadata_album_artist_name="Zed")]))
    got = readers.history_events(readers.history(spark, str(tmp_path)))
    assert rows(got, "artist_key", "sid", "listen", "done", "deliberate") == [("", "a", True, True, True), ("zed", "a", False, True, True)]


def test_playlists(spark, tmp_path):
    (tmp_path / "one.m3u").write_text("#EXTM3U\n#PLAYLIST: Mine\nA/b.flac\n\n#x\nC/d.flac\nA/b.flac\n")
    got = readers.m3u(spark, str(tmp_path / "one.m3u"))
    assert rows(got) == [("one.m3u", "Mine", 0, "A/b.flac"), ("one.m3u", "Mine", 1, "C/d.flac"), ("one.m3u", "Mine", 2, "A/b.flac")]
    assert rows(writers.playlists(got), "body") == [("A/b.flac\nC/d.flac",)]
    (tmp_path / "account.json").write_text(json.dumps({"playlists": [{"name": "P", "items": [{"track": {"trackName": "t", "artistName": "a", "trackUri": "u"}}]}]}))
    assert rows(readers.account_playlists(spark, str(tmp_path / "account.json"))) == [("P", 0, "u", "a", "t")]


def test_decisions_and_state(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# comment\nid1\t path/one \tnote\n\n\tx\ty\nid2\tp2\t\n")
    assert rows(readers.decisions(spark, str(tmp_path / "d.tsv"), ("sid", "path", "note")), "sid", "path") == [("id1", "path/one"), ("id2", "p2")]
    (tmp_path / "s.json").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    good, bad = readers.json_state(spark, str(tmp_path / "s.json"), "a int")
    assert rows(good) == [(1,), (2,)] and rows(bad) == [("{broken",)]


def test_change_logs(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"cambios": [{"old_path": "a", "new_path": "b"}, {"old_path": "", "new_path": "q"}, {"old_path": "r", "new_path": None}], "quitadas": ["z", ""]}))
    (tmp_path / "2.json").write_text(json.dumps({"cambios": [{"old_path": "b", "new_path": "c"}], "quitadas": []}))
    log = readers.change_logs(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in log.orderBy("seq").collect()] == [("a", "b"), ("z", None), ("b", "c")]
    assert sorted(map(tuple, changes.compact(log).collect()), key=repr) == [("a", "c"), ("b", "c"), ("z", None)]


def test_explicit_change_logs_come_first(spark, tmp_path):
    import os

    for folder, name, old, new, when in (("pending", "1.json", "b", "c", 50), ("given", "z.json", "a", "b", 10), ("given", "a.json", "x", "a", 20)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"cambios": [{"old_path": old, "new_path": new}], "quitadas": []}))
        os.utime(tmp_path / folder / name, (1_700_000_000 + when,) * 2)
    log = readers.change_logs(spark, str(tmp_path / "pending"), str(tmp_path / "given"))
    assert [tuple(r)[1:] for r in log.orderBy("seq").collect()] == [("a", "b"), ("x", "a"), ("b", "c")]


def test_player_tables_scans_and_page_metadata(spark, tmp_path):
    spark.createDataFrame([("1", "P", "x")], "id string, name string, other string").write.parquet(str(tmp_path / "album.parquet"))
    assert rows(readers.player_table(spark, str(tmp_path), "album")) == [("1", "P")]
    (tmp_path / "scan.json").write_text('{"path": "a", "length_s": 3.5}\n{broken\n\n')
    got = readers.library_scan(spark, str(tmp_path / "scan.json"), "path string, length_s double")
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", 3.5, None), (None, None, "{broken")]
    page = """<meta property="og:title" content="A &amp; B"><meta name="music:duration" content="200"><meta property="og:title" content="again"><script id="__NEXT_DATA__" type="application/json">{"a": {"duration":{"totalMilliseconds":201000},"audioPreview":{"url":"http://p"}}}</script>"""
    one, two = readers.page_metadata(spark.createDataFrame([(1, page), (2, None)], "i int, html string")).orderBy("i").collect()
    assert one["meta"] == {"og:title": "again", "music:duration": "200"} and one["duration_ms"] == 201000 and one["preview"] == "http://p" and json.loads(one["data"])["a"]
    assert two["meta"] == {} and two["data"] is None and two["preview"] is None


def test_records_of_pages(spark):
    song = """<meta property="og:title" content="old"><meta property="og:title" content="Pa&amp;apos; l&eacute;"><meta property="og:description" content="A, B · Disc · Song · 2001"><meta property="music:album" content="https://open.spotify.com/album/x9"><meta name="music:duration" content="77">"""
    pages = spark.createDataFrame([(1, song), (2, "<p>"), (3, None), (4, song.replace("album/x9", ""))], "i int, html string")
    got = {r["i"]: tuple(r)[1:] for r in readers.song_records(pages, "i").collect()}
    none = (None,) * 6 + ("no record",)
    assert got == {1: ("Pa' lé", ["A", "B"], "Disc", "x9", "2001", 77, None), 2: none, 3: none, 4: none}
    album = lambda entity: f'<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"state":{{"data":{{"entity":{entity}}}}}}}}}}}</script>'
    tracks = '{"name":"D &amp; E","subtitle":"A","trackList":[{"uri":"spotify:track:t1","title":"One","subtitle":"X,\u00a0Y","duration":1500},{"uri":"spotify:episode:e","title":"no"},{"uri":"spotify:track:t2","duration":2500},{"title":"no uri"}]}'
    pages = spark.createDataFrame([(1, album(tracks)), (2, album("null")), (3, album("{bad")), (4, "<p>"), (5, album('{"name":"N"}')), (6, None)], "i int, html string")
    got = sorted((tuple(r) for r in readers.album_records(pages, "i").collect()), key=repr)
    assert got == [(1, "D & E", "A", 1, "t1", "One", "X", 2, None), (1, "D & E", "A", 3, "t2", "", "", 2, None), *((i, *[None] * 7, e) for i, e in ((2, "no album"), (3, "not JSON"), (4, "no data"), (6, "no data")))]


def test_player_tags(spark):
    texts = ['{"isrc":[{"value":"a1"},{"value":"B2"},{"x":1}],"genre":[{"value":"Rock"}],"n":3,"m":{"value":"q"}}', "{bad", None, "[1]", "{}", '{"isrc":[{"value":"A1"},{"value":""}]}']
    media = spark.createDataFrame([(str(i), t, i == 5 and None, "m" if i else "") for i, t in enumerate(texts)], "id string, tags string, missing boolean, mbz_recording_id string")
    got = sorted((tuple(r) for r in readers.player_tags(media).collect()), key=repr)
    assert got == sorted([("0", "isrc", 0, "a1", None), ("0", "isrc", 1, "B2", None), ("0", "genre", 0, "Rock", None), ("1", None, None, None, "{bad"), ("3", None, None, None, "[1]"), ("5", "isrc", 0, "A1", None), ("5", "isrc", 1, "", None)], key=repr)
    isrcs, recordings = readers.library_ids(media)
    assert rows(isrcs) == [("A1",), ("B2",)] and rows(recordings) == [("m",)]


def test_lossy(spark):
    df = spark.createDataFrame([("flac", None), ("mp3", None), ("m4a", "alac"), ("m4a", None), ("wav", None)], "e string, c string")
    assert [r[0] for r in df.select(readers.lossy(F.col("e"), F.col("c"))).collect()] == [False, True, False, True, False]


def test_files_and_reports(spark, tmp_path):
    for name in ("a.FLAC", ".b.mp3", "c.txt", "d.opus"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.audio_files(spark, str(tmp_path)).orderBy("path").collect()] == ["a.FLAC", "d.opus"]
    violations = spark.createDataFrame([("s", "fix", str(i), None) for i in range(5)], "section string, severity string, key string, detail string")
    assert writers.markdown(violations, 2) == "## s (fix, 5)\n\n- 0\n- 1\n"
    work = spark.createDataFrame([("a", "x"), ("b", "Deleted")], "sid string, why string")
    new = spark.createDataFrame([("a", "Deleted"), ("b", "y"), ("c", "z")], "sid string, why string")
    assert rows(writers.append_unique(work, new, ["sid"], F.col("why") == "Deleted")) == [("a", "Deleted"), ("b", "Deleted"), ("c", "z")]
    secret = spark.createDataFrame([("api_key", "k"), ("user", "u")], "k string, v string")
    assert rows(writers.redacted(secret, "k", "v")) == [("api_key", "***"), ("user", "u")]


def test_lookup_status_keeps_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"a":1}')], "i int, body string")
    assert rows(readers.lookup_status(df), "i", "status") == [(1, "unknown"), (2, "absent"), (3, "found")]


def test_stream_promotes_what_the_batch_does(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    listens = [("a", start + dt.timedelta(days=d)) for d in (0, 3, 5)] + [("b", start + dt.timedelta(days=d)) for d in (0, 30, 59)] + [("c", start)]
    df = spark.createDataFrame(listens, "item string, ts timestamp")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.promotions(stream.timed(source, "ts"), "item", "ts").writeStream.format("memory").queryName("promoted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.processAllAvailable()
    query.stop()
    streamed = {r["item"] for r in spark.table("promoted").collect()}
    ever = set()
    for item, when in listens:
        now = F.lit(when)
        ever |= {r["item"] for r in funnel.promotions(df.where(F.col("ts") <= now), "item", "ts", now).collect()}
    assert streamed == ever == {"a"}


def test_album_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, "<html></html>")], "i long, html string")
    plan = readers.album_records(pages, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__NEXT_DATA__") == 1 and plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1
