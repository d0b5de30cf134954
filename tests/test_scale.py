"""Hot groups: numbers by ranges, trailing counts by slices, looks by parts, pairs in order or in rounds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import similarity
from sieveworks.operators import funnel, match, numbering, releases


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_numbers_of_a_hot_group(spark):
    """Half of the rows in one group: the same numbers as by counting, and no task has more than its share."""
    draw = random.Random(1)
    values = [(draw.choice(["hot"] * 3 + ["a", "b", None]), draw.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(values, "g string, v int, id int")
    got = numbering.numbered(df, ["g"], ["v", "id"], "n", parts=8)
    want, seen = [], {}
    for g, v, i in sorted(values, key=lambda r: (r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, v, i, seen[g]))
    assert rows(got) == sorted(want, key=repr)
    ranged = df.repartitionByRange(8, "g", "v", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranged.collect()) < 3000 / 3
    assert numbering.numbered(df.limit(0), ["g"], ["v"], "n").count() == 0
    assert rows(numbering.numbered(df, ["g"], [F.desc("v"), F.desc("id")], "n", parts=5).where("n = 1"), "g", "v") == sorted(((g, max(v for a, v, _ in values if a == g)) for g in ("hot", "a", "b", None)), key=repr)


def test_trailing_counts_of_a_hot_item(spark):
    draw = random.Random(2)
    start = dt.datetime(2023, 12, 28)
    events = [(draw.choice(["hot", "hot", "x"]), start + dt.timedelta(minutes=draw.randrange(40_000) // 7 * 7)) for _ in range(900)] + [(None, start), ("x", None)]
    df = spark.createDataFrame(events, "item string, ts timestamp").withColumn("id", F.monotonically_increasing_id())
    got = sorted((r["item"], r["ts"], r["recent"]) for r in funnel.trailing_counts(df, "item", "ts", days=3).collect())
    real = [(i, t) for i, t in events if i and t]
    assert got == sorted((i, t, sum(j == i and t - dt.timedelta(days=3) <= u <= t for j, u in real)) for i, t in real)
    first = {r["item"]: r["ts"] for r in funnel.first_promotions(df, "item", "ts", 3, 20).collect()}
    assert first == {i: min(t for j, t, n in got if j == i and n >= 20) for i in {j for j, _, n in got if n >= 20}}


@pytest.mark.parametrize(("bits", "most"), [(256, 20), (64, 5), (100, 7)])
def test_looks_against_all_pairs(spark, bits, most):
    draw = random.Random(bits)
    base = [[draw.random() < 0.5 for _ in range(bits)] for _ in range(12)]
    flags = []
    for i in range(150):
        f = list(draw.choice(base))
        for k in draw.sample(range(bits), draw.choice((0, 1, most // 2, most // 2 + 1, most))):
            f[k] = not f[k]
        flags.append((i, f))
    flags += [(900, flags[0][1]), (901, None)]
    df = spark.createDataFrame(flags, "id int, f array<boolean>").withColumn("w", similarity.packed_words(F.col("f")))
    looks, pairs = match.look_alikes(df, "id", "w", most, bits)
    look = {}
    for i, f in sorted(flags[:-1]):
        look.setdefault(tuple(f), i)
    assert dict(rows(looks)) == {i: look[tuple(f)] for i, f in flags[:-1]}
    off = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert rows(pairs) == sorted(((a, b, off(x, y)) for x, a in look.items() for y, b in look.items() if a < b and off(x, y) <= most), key=repr)
    assert match.look_alikes(df.limit(0), "id", "w", most, bits)[1].count() == 0


@pytest.mark.parametrize("task_pairs", [10**6, 25, 1])
def test_pairs_in_order_or_in_rounds(spark, task_pairs):
    """A hot group, a chain of rising weights and repeated pairs, whichever way groups are gone through."""
    draw = random.Random(4)
    pairs = [("hot", draw.randrange(40), 100 + draw.randrange(40), draw.randrange(30)) for _ in range(300)] + [("chain", i // 2, 100 + (i + 1) // 2, i) for i in range(60)] + [(f"g{i % 7}", i % 3, 100 + i % 4, i % 2) for i in range(40)] + [(None, 1, 2, 3), ("g1", None, 2, 3)]
    got = match.greedy_pairs(spark.createDataFrame(pairs, "g string, a int, b int, far int"), ["g"], "a", "b", ["far"], task_pairs=task_pairs)
    want, used = set(), set()
    for g, a, b, far in sorted((p for p in pairs if None not in p), key=lambda p: (p[0], p[3], p[1], p[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, far))
    assert rows(got) == sorted(want, key=repr)


def test_edition_choice(spark):
    """Fixture of two discs mixed up, and one where only tolerance and the second pass fit."""
    songs = [
        ("dark", 0, ["I1"], "breathe", 169.0, "1973"), ("dark", 1, ["I2"], "money", 383.0, "1973"),
        ("torches", 0, ["", "T1"], "helena", 200.0, "2011"), ("torches", 1, [], "kicks", 240.0, "2011"), ("torches", 2, ["T9"], "call", 226.0, "2011"),
        ("two", 0, ["X1"], "x", 100.0, "2000"), ("none", 0, ["N"], "n", 100.0, None),
    ]
    tracks = [
        ("e1", 1, "I1", "breathe", 163.0, 1, 2), ("e1", 2, "I2", "money", 382.0, 1, 6), ("e2", 1, "I1", "breathe", 180.0, 1, 2), ("e2", 2, "I2", "money", 382.0, 1, 6),
        ("e3", 1, "T1", "helena", 206.9, 1, 1), ("e3", 2, "", "kicks", 237.5, 1, 2), ("e3", 3, "T0", "call", 228.0, 1, 3), ("e4", 1, "T1", "helena", 208.0, 1, 1), ("e4", 2, "", "kicks", 240.0, 1, 2), ("e4", 3, "T9", "call", 226.0, 1, 3),
        ("e5", 1, "X1", "x", 100.0, 1, 1), ("e6", 1, "X1", "x", 100.0, 1, 2), ("e7", 1, "N", "n", 0.0, 1, 1), ("e8", 1, "I1", "breathe", 169.0, 1, 9), ("e8", 2, "I2", "money", 383.0, 1, 9),
    ]
    editions = [(f"e{i}", "1973-03-01" if i == 1 else "2011", 3 if i == 8 else None) for i in range(1, 9)]
    s = spark.createDataFrame(songs, "folder string, song int, isrcs array<string>, title_key string, seconds double, date string")
    t = spark.createDataFrame(tracks, "edition string, track int, isrc string, title_key string, seconds double, disc int, pos int")
    e = spark.createDataFrame(editions, "edition string, date string, nb_tracks int")
    candidates = s.select("folder").distinct().crossJoin(e.select("edition"))
    choice, numbers = releases.number_by_edition(s, e, t, candidates)
    assert rows(choice) == [("dark", "e1", 1, "numbered"), ("none", None, 0, "none"), ("torches", "e3", 1, "numbered"), ("two", None, 2, "ambiguous")]
    assert rows(numbers) == [("dark", 0, 1, 2), ("dark", 1, 1, 6), ("torches", 0, 1, 1), ("torches", 1, 1, 2), ("torches", 2, 1, 3)]
    named = s.withColumns({"album_key": F.col("folder"), "artist_key": F.when(F.col("song") == 0, "z").otherwise("art")})
    shown = e.withColumns({"album_key": F.when(F.col("edition") == "e8", "other").otherwise("torches"), "artist_key": F.when(F.col("edition") == "e7", "art").otherwise("b")})
    assert rows(releases.edition_candidates(named, shown, t, "folder", "edition")) == [("torches", "e3"), ("torches", "e4"), ("torches", "e7")]


def test_siblings_without_a_release_group(spark):
    tracks = [("p1", "f", "g", "r", "k", "A"), ("p2", "f", "g", "r", "k", "B"), ("p3", "f", "g", "q", "k", "B"), ("p4", "f", None, None, "k", "C"), ("p5", "f", "", None, "other", "C"), ("p6", "x", None, None, "k", "C"), ("p7", "h", "g2", "s", "k", "A"), ("p8", "h", "g2", "s", "k", "D"), ("p9", "h", "g3", "r", "k", "A"), ("p0", "n", "g4", None, "k", "E"), ("pa", "n", "g4", "", "k", "F"), ("pb", "n", None, None, "k", None)]
    df = spark.createDataFrame(tracks, "path string, folder string, release_group string, release string, album_key string, album_artist string")
    official = spark.createDataFrame([("r", "Official"), ("q", "No")], "release string, artist string")
    names = spark.createDataFrame([("Official", "B")], "source_name string, library_name string")
    assert rows(releases.sibling_artists(df, official, names), "path", "old", "new") == [("p1", "A", "B"), ("p4", "C", "B"), ("pa", "F", "E"), ("pb", "", "E")]


def test_paths_titles_and_times(spark):
    from sieveworks.functions import keys

    df = spark.createDataFrame([("/m/lists", "../A/b.flac"), ("/m/lists", "./x/../y"), ("/m", "../../../z"), ("m/l", "../../../z"), ("/m", "/abs//q/."), ("m", "a/..")], "d string, p string")
    assert [r[0] for r in df.select(keys.resolved_path(F.col("d"), F.col("p"))).collect()] == ["/m/A/b.flac", "/m/lists/y", "/z", "../z", "/abs/q", "m"]
    df = spark.createDataFrame([("One - Live (x)",), (" Two (feat. A) [b] ",), (None,), (" a\tb　",)], "t string")
    assert [r[0] for r in df.select(keys.clean_title(F.col("t"))).collect()] == ["One", "Two", "", "a\tb"]
    assert [r[0] for r in df.select(keys.clean_dir(F.col("t"))).collect()][3] == "a\tb"
    assert spark.range(1).select(keys.player_time(F.lit("2025-08-20T12:00:00Z"))).first()[0] == "2025-08-20 12:00:00.000000000+00:00"


def test_merged_numbers_and_dates_and_store_covers(spark):
    from sieveworks.operators import consensus

    base = spark.createDataFrame([("al", "k1", 1, 100.0, 1, "2001-05"), ("al", "k9", 2, 50.0, 903, ""), ("b", "k", 3, 1.0, 2, None)], "album string, key string, id int, len double, n int, date string")
    other = spark.createDataFrame([("al", "k1", 10, 101.0, 0, "1999"), ("al", "k2", 11, 9.0, 0, "2000"), ("b", "z", 12, 9.0, 0, None)], base.schema)
    got = releases.merge_editions(base, other, ["key"], "album", "id", "len", number="n")
    assert rows(got) == [("al", 10, 1, None), ("al", 11, None, 904), ("b", 12, None, 901)]
    assert rows(releases.merged_dates(base, other, "album", "date")) == [("al", "1999", "1999"), ("b", None, None)]
    pairs = spark.createDataFrame([("d", 3), ("e", 99), ("f", 99)], "by string, bits int")
    covers = spark.createDataFrame([(d, i, a, look) for d in "def" for i, a, look in ((1, 10, "x"), (2, 30, "y"), (3, 20, "x"))], "by string, id int, area int, look string")
    store = spark.createDataFrame([("d", 77), ("e", 78)], "by string, cover int")
    assert rows(consensus.best_cover(pairs, covers, "by", "id", "area", store=store)) == [("d", 2), ("e", 78), ("f", 3)]
