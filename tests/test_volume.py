"""How many rows move: hot keys and copies make no pairs, with the same results as counting."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import changes, match, releases
from sieveworks.sources import storage


def moved(spark, job):
    """What ``job`` gives, and how many rows it wrote to shuffles."""

    def records():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = records()
    out = job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, records() - before


def joined(spark, job):
    """What ``job`` gives, and how many rows came out of its joins."""
    store = spark._jsparkSession.sharedState().statusStore()

    def rows(seen):
        total, runs = 0, store.executionsList()
        for i in range(runs.size()):
            run = runs.apply(i).executionId()
            if run in seen:
                continue
            seen.add(run)
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for k in range(nodes.size()):
                node = nodes.apply(k)
                if "Join" in node.name():
                    metrics = node.metrics()
                    names = [metrics.apply(j) for j in range(metrics.size())]
                    found = [values.get(m.accumulatorId()) for m in names if m.name() == "number of output rows"]
                    total += sum(int(f.get().replace(",", "")) for f in found if f.isDefined())
        return total

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = set()
    rows(seen)
    out = job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, rows(seen)


def test_editions_of_common_songs(spark):
    """Song 0 is in every edition and folder, and half of the folders hold nothing else."""
    draw = random.Random(5)
    held = {e: {0, *draw.sample(range(1, 60), 4)} for e in range(300)}
    asked = {f: {0} if f % 2 else {0, *draw.sample(sorted(held[draw.randrange(300)]), 2), draw.randrange(1, 60)} for f in range(400)}
    editions = spark.createDataFrame([(e, s, (e * s) % 3 + 1, str(e % 7)) for e, songs in held.items() for s in songs], "edition int, song int, place int, day string")
    folders = spark.createDataFrame([(f, s) for f, songs in asked.items() for s in songs], "folder int, song int")
    got, n = moved(spark, lambda: sorted(map(tuple, releases.choose_edition(folders, editions, "folder", "song", "edition", "place", ["day"]).collect())))
    want = []
    for f, songs in asked.items():
        fits = [e for e, there in held.items() if songs <= there]
        if fits:
            want.append((f, min(fits, key=lambda e: (str(e % 7), e)), len(fits), len({tuple((e * s) % 3 for s in sorted(songs)) for e in fits}) > 1))
    assert got == sorted(want)
    assert n < 30_000  # 300 x 400 pairs of folders and editions share song 0


def test_nearest_of_one_large_group(spark):
    """Bases and values asked for, all in one album, against looking through all."""
    draw = random.Random(6)
    base = [("a", "x", i, draw.randrange(40_000) / 8) for i in range(800)] + [("a", None, 900, 1.0), ("b", "x", 901, None)]
    other = [("a", "x", 2000 + i, draw.choice((draw.randrange(40_000) / 8, draw.choice(base[:800])[3], 90_000.0 + i))) for i in range(600)] + [("a", None, 3000, 1.0), ("b", "x", 3001, 2.0), ("a", "x", 3002, None)]
    kind = "album string, key string, id int, len double"
    frames = [spark.createDataFrame(x, kind) for x in (base, other)]
    for near in (3.0, 0.0, 40.0):
        got, n = joined(spark, lambda: {r["id"]: r["copy_of"] for r in releases.merge_editions(*frames, ["key"], "album", "id", "len", near).collect()})
        want = {}
        for album, key, i, length in other:
            fits = [(abs(length - x), j) for a, k, j, x in base if (a, k) == (album, key) and key and None not in (x, length) and abs(length - x) <= near]
            want[i] = min(fits)[1] if fits else None
        assert got == want
        assert n < 5_000  # 800 x 600 pairs of one album
    plan = releases.merge_editions(*frames, ["key"], "album", "id", "len", 40.0)
    assert plan.count() == len(other)
    reached, n = moved(spark, lambda: match.nearest_by(*frames, ["album", "key"], "len", "id", 1e9).count())
    assert reached == len({x[3] for x in other[:600]}) and n < 10_000


def test_songs_and_offers_that_repeat(spark):
    """Many songs and offers under one artist and title, of few durations."""
    songs = spark.createDataFrame([(i, "Art", "Song", None if i % 6 == 0 else 100.0 + i % 9) for i in range(900)], "song int, artist string, title string, seconds double")
    offers = spark.createDataFrame([(i, i % 3, ["Art"], "Song" if i % 4 else "Song More", 104.0 + i % 12) for i in range(900)], "offer int, store int, artists array<string>, title string, seconds double")
    got, n = joined(spark, lambda: {r["song"]: tuple(r)[1:] for r in match.shop_matches(songs, offers, [1, 2]).collect()})
    listed = [(i % 3, 104.0 + i % 12, i) for i in range(900) if i % 4]
    whole = [(i % 3, 104.0 + i % 12, i) for i in range(900)]
    want = {}
    for i in range(900):
        length = 100.0 + i % 9
        if i % 6 == 0:
            store, _, offer = min((s, 0.0, o) for s, _, o in listed)
            want[i] = (offer, store, "review", 0.0)
            continue
        fits = [(0, s, abs(x - length), o) for s, x, o in listed if abs(x - length) <= 3]
        fits += [(1, s, abs(x - length), o) for s, x, o in whole if s in (1, 2) and abs(x - length) <= 1]
        late, store, off, offer = min(fits) if fits else (None,) * 4
        want[i] = (offer, store, ("ok", "review title")[late] if fits else "none", off)
    assert got == want
    assert n < 60_000  # 900 x 900 pairs share artist and title


def test_looks_that_meet_by_chance(spark):
    """Looks without any likeness, and some near ones: meetings by chance stay rare."""
    draw = random.Random(7)
    looks = [draw.getrandbits(64) for _ in range(12_000)]
    near = [x ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(1, 6))) for x in looks[:300]]
    df = spark.createDataFrame([(i, [x & 0xFFFFFFFF, x >> 32]) for i, x in enumerate(looks + near)], "id int, w array<long>")
    got, n = joined(spark, lambda: {(r["a"], r["b"]): r["bits"] for r in match.look_alikes(df, "id", "w", 5, 64)[1].collect()})
    want = {(i, 12_000 + i): (x ^ near[i]).bit_count() for i, x in enumerate(looks[:300])}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v <= 5 and (looks + near)[a] ^ (looks + near)[b] for (a, b), v in got.items())
    assert n < 100_000  # about 300,000 pairs share one of six parts


def test_shared_parts():
    assert [match._shared_parts(n, 5, 64) for n in (1, 1000, 10**6, 10**8)] == [1, 1, 2, 3]
    assert match._shared_parts(10**5, 5, 6) == 1 and match._shared_parts(10**9, 0, 8) >= 1


def test_editions_by_tolerance_move_little(spark):
    """Both passes over songs and tracks are one choice in order: rows to shuffles for each row of the query's input."""
    from sieveworks.plans import releasing

    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out, n = moved(spark, lambda: releasing.edition_by_tolerance(spark, folder).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert n < 36 * items  # 40.2 with a choice for each pass


def test_records_that_lead_nowhere(spark):
    """One chain among many records without a pointer: the rounds join the chain alone."""
    records = spark.range(6000).select(F.col("id").alias("seq"))
    step = spark.createDataFrame([(i, i + 1) for i in range(5000, 5100)], "seq long, next long")
    got, n = joined(spark, lambda: {r["seq"]: r["end"] for r in changes._followed(records, step).collect()})
    assert got == {i: 5100 if 5000 <= i < 5100 else i for i in range(6000)}
    assert n < 10_000  # 54,000 when all records went through the rounds


@pytest.mark.parametrize("name", ["edition_numbers", "edition_by_tolerance"])
def test_folder_moves_once_for_each_candidate(spark, name):
    """A folder's songs are one row, which meets the tracks of a candidate: rows to shuffles for each row of the query's input."""
    from sieveworks.plans import releasing

    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out, n = moved(spark, lambda: releasing.QUERIES[name](spark, folder).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out and n < 10 * items
    assert spark.conf.get(storage.CLEANUP, "false") == "false"


def test_settled_tables_leave_no_shuffle_files(spark):
    """The files of a session's shuffles, before and after a step that shuffles is written."""
    kept = lambda: set(re.findall(r"shuffle_\w+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = kept()
    step = spark.range(10_000).repartition("id")
    out = storage.settled(step.groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before and out.count() == 7
    assert spark.conf.get(storage.CLEANUP, "false") == "false"
