"""Operators on small tables, and properties of plans."""

import datetime as dt
import difflib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.functions import tolerance
from sieveworks.operators import audit, changes, consensus, funnel, genres, history, match, verdicts
from sieveworks.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def replay(log):
    """The change-log rule, step by step."""
    where, gone = {}, set()
    for _, old, new in log:
        if new is None:
            for k in [k for k, v in where.items() if v == old]:
                gone.add(k)
                del where[k]
            where.pop(old, None)
            gone.add(old)
        elif old != new:
            for k in [k for k, v in where.items() if v == old]:
                where[k] = new
            where.setdefault(old, new)
    return sorted([*where.items(), *((k, None) for k in gone - set(where))], key=repr)


NAMES = st.sampled_from("abcdef")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NAMES, st.one_of(st.none(), NAMES)), min_size=1, max_size=10))
def test_compaction_equals_replay(spark, moves):
    log = [(i, a, b) for i, (a, b) in enumerate(moves)]
    got = changes.compact(spark.createDataFrame(log, "seq long, old string, new string"))
    assert sorted([(r["old"], r["new"]) for r in got.collect()], key=repr) == replay(log)


def test_empty_change_log(spark):
    assert changes.compact(spark.createDataFrame([], "seq long, old string, new string")).count() == 0


def test_remap_and_put_back(spark):
    entries = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c"), ("p", 4, "d")], "playlist string, pos int, path string")
    log = spark.createDataFrame([("a", "b"), ("c", None)], "old string, new string")
    assert rows(changes.remap(entries, "path", log, ["playlist", "path"], "pos"), "pos", "path") == [(1, "b"), (4, "d")]
    back = changes.put_back(entries.where("pos <> 3"), entries.where("pos = 3"), "playlist", "pos", "path")
    assert rows(back, "path", "after", "ahead_of") == [("c", 2, None)]


def test_upsert_diff_and_gates(spark):
    old = spark.createDataFrame([("u", "x", 1, 5)], "user string, item string, plays int, last int")
    new = spark.createDataFrame([("u", "x", 2, 3), ("u", "y", 1, 1)], "user string, item string, plays int, last int")
    assert rows(changes.upsert(old, new, ["user", "item"], {"plays": "sum", "last": "max"})) == [("u", "x", 3, 5), ("u", "y", 1, 1)]
    a = spark.createDataFrame([(1, "t", "x"), (2, "t", "y"), (3, "t", "z")], "row int, tag string, value string")
    b = spark.createDataFrame([(1, "t", "x"), (2, "t", "q"), (4, "t", "z")], "row int, tag string, value string")
    assert rows(changes.snapshot_diff(a, b, "row", "tag", "value")) == [("+", "t", 1), ("-", "t", 1), ("~", "t", 1)]
    assert changes.snapshot_diff(a, a, "row", "tag", "value").count() == 0
    assert changes.sane(10, 19) and not changes.sane(9, 20) and not changes.sane(0, 0)


def test_purging_waits_for_explanations(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    missing = changes.missing_rows(ids(1, 2, 3), "id", ids(1), ids(2), ids(3))
    assert changes.purge_plan(missing, 50, 60).count() == 0
    missing = missing.where("id < 3")
    assert rows(changes.purge_plan(missing, 50, 60), "id", "reason") == [(1, "removed")]
    assert changes.purge_plan(missing, 29, 60).count() == 0 == changes.purge_plan(missing, 0, 0).count()
    assert changes.purge_plan(changes.missing_rows(ids(1, 9), "id", ids(1), ids(2), ids(3)), 50, 60).count() == 0


def test_folded_annotations_keep_the_items_own_date(spark):
    log = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", None)], "old string, new string")
    plays = spark.createDataFrame([("u", "a", 2, 9, 5), ("u", "b", 3, 1, 4), ("u", "c", 1, 7, 6), ("u", "d", 1, None, None), ("u", "x", 1, 1, 1), ("v", "a", 1, 3, None)], "user string, item string, plays int, starred_at int, rating int")
    out = changes.fold_into(plays, log, "item", ["user"], {"plays": "sum", "starred_at": "own", "rating": "max"})
    assert sorted((tuple(r[c] for c in ("user", "item", "plays", "starred_at", "rating")) for r in out.collect()), key=repr) == [("u", "b", 5, 1, 5), ("u", "d", 2, 7, 6), ("v", "b", 1, 3, None)]


def test_all_tables_with_paths_follow_a_change(spark):
    log = spark.createDataFrame([("a", "b"), ("c", None)], "old string, new string")
    entries = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")], "playlist string, pos int, path string")
    state = spark.createDataFrame([("s1", "a"), ("s2", "c"), ("s3", "d")], "key string, file string")
    out = changes.remap_all({"playlists": (entries, "path", ["playlist", "path"], "pos"), "state": (state, "file", None, None)}, log)
    assert rows(out["playlists"], "pos", "path") == [(1, "b")] and rows(out["state"], "key", "file") == [("s1", "b"), ("s3", "d")]


def test_lookup_order(spark):
    left = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "id int, key string")
    decided = spark.createDataFrame([(1, "human")], "id int, v string")
    keyed = spark.createDataFrame([("k", "key")], "key string, v string")
    out = match.coalesced_lookup(left, [(decided, ["id"], "v"), (keyed, ["key"], "v")])
    assert rows(out, "id", "found", "level") == [(1, "human", 1), (2, "key", 2), (3, None, None)]


def test_title_levels(spark):
    pairs = [
        ("Best Friends - Remix", "Best Friends", 1), ("Song Part 4", "Song Part 5", 0), ("حبايبنا = Habayebna", "Habayebna", 2), ("Thriller", "Thriller (Remastered 2015)", 3), ("Spirited Away - One Summer's Day", "One Summer's Day", 2),
        ("Tune (Tanzen Remix)", "Tune (Tecno Fez Club Edit)", 0), ("夜に駆ける", "Racing Into The Night", None), ("Abc", "Xyz", 0), ("", None, 3),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = dict(rows(match.title_level(df, "a", "b").fillna(-1, ["level"]), "i", "level"))
    assert [got[i] for i in range(len(pairs))] == [-1 if x is None else x for _, _, x in pairs]


def test_same_recording(spark):
    df = spark.createDataFrame([(3, 200.0, 203.0, ["A"], ["B"]), (2, 200.0, 300.0, ["A"], ["A"]), (0, 200.0, 201.0, ["A"], ["A"]), (2, 200.0, None, [], []), (0, 200.0, 300.0, [], [])], "level int, d double, r double, i array<string>, j array<string>")
    out = match.same_recording(df, "level", "d", "r", "i", "j")
    assert [r["same"] for r in out.collect()] == [True, True, True, True, False]


def test_greedy_and_unique(spark):
    pairs = spark.createDataFrame([("f", 1, 10, 0.1), ("f", 1, 11, 0.2), ("f", 2, 10, 0.05), ("f", 3, 10, 0.01)], "folder string, song int, track int, far double")
    assert rows(match.greedy_pairs(pairs, ["folder"], "song", "track", ["far"]), "song", "track") == [(1, 11), (3, 10)]
    assert rows(match.only_candidate(pairs, "song"), "song") == [(2,), (3,)]


def test_votes(spark):
    df = spark.createDataFrame([("g", v) for v in "aabbbcc"] + [("h", None), ("t", "y"), ("t", "x")], "k string, v string")
    assert rows(consensus.majority(df, ["k"], "v")) == [("g", "b", 3, 7), ("t", "x", 1, 2)]
    assert rows(consensus.two_votes(df, ["k"], "v", least_votes=2)) == [("g", "b", "a", 7, True), ("t", "x", None, 2, False)]


def test_second_votes_pass_over_ignored_values(spark):
    def vote(text, **rules):
        df = spark.createDataFrame([("g", v) for v in text.split()], "k string, v string")
        return tuple(consensus.two_votes(df, ["k"], "v", **rules).first())[1:3]

    ignored = {"R": ("H", "L"), "T": ("L",)}
    assert vote("R R R R R H H H H L L L P P P", ignored=ignored) == ("R", "P")
    assert vote("R R R R R H H H H L L L P P", ignored=ignored) == ("R", None)
    assert vote("P P P P H H H", ignored=ignored) == ("P", "H")
    prevails = {"R": ("H", "L"), "T": ("L", "P")}
    assert vote("H H H H R P P P", ignored=ignored, prevails=prevails) == ("R", "P")
    assert vote("L L L L T R", prevails=prevails) == ("R", "L")
    assert vote("P P P P R T", prevails=prevails) == ("T", "P")
    assert vote("K K K K R T L", prevails=prevails) == ("K", None)


def test_dates_and_combinations(spark):
    df = spark.createDataFrame([("a", d, "2001") for d in ("2001", "2001-05-01", "2001-05-01", "1999", "1999", "1999")] + [("b", "1999", "2002"), ("c", None, ""), ("d", "1990", ""), ("d", None, "")], "album string, date string, year string")
    assert rows(consensus.agreed_date(df, ["album"], "date", "year")) == [("a", "2001-05-01"), ("b", "2002"), ("d", "1990")]
    songs = spark.createDataFrame([("x", ["R", "P"]), ("x", ["R", "Soundtrack", "P"]), ("x", ["R"]), ("y", ["Soundtrack"]), ("y", None)], "artist string, genres array<string>")
    assert rows(consensus.usual_combination(songs, ["artist"], "genres", ["Soundtrack"])) == [("x", ["R", "P"], 2)]


def test_survivor_spread_blocks_the_group(spark):
    df = spark.createDataFrame([("i", 1, 10.0), ("i", 2, 12.0), ("j", 3, 10.0), ("j", 4, 14.0), ("j", 5, 11.0)], "isrc string, id int, d double")
    assert rows(consensus.survivors(df, ["isrc"], [-F.col("d")], "id", F.col("d"), 3.0), "isrc", "keeper", "dropped") == [("i", 2, 1)]


def test_selection_is_independent_of_order(spark):
    day = dt.datetime(2024, 1, 1)
    events = [("a", "s", "x", day + dt.timedelta(days=i % 4, hours=i), True, True, False) for i in range(12)] + [("a", "t", "y", day, False, False, False)]
    schema = "artist_key string, title_key string, sid string, ts timestamp, listen boolean, done boolean, deliberate boolean"
    plans = []
    for order in (events, events[::-1]):
        df = spark.createDataFrame(order, schema)
        plans.append(rows(history.select_songs(history.song_history(df), df.agg(F.max("ts")).scalar()), "title_key", "rules", "excluded"))
    assert plans[0] == plans[1] == [("s", "1,2,5", False)]


def test_funnel(spark):
    now = dt.datetime(2024, 6, 1)
    ago = lambda d: now - dt.timedelta(days=d)
    files = [
        ("replace", True, False, None, None, ago(1), ago(9), 5), ("adopt", False, False, ago(14), None, ago(1), ago(50), 0), ("promote", False, False, None, None, ago(1), ago(9), 3),
        ("delete", False, False, None, ago(7), ago(42), ago(90), 0), ("keep", False, False, None, ago(6), ago(42), ago(90), 0), ("warn", False, False, None, None, ago(35), ago(90), 0),
        ("cancel", False, False, None, ago(3), ago(5), ago(90), 1), ("keep", False, True, None, None, ago(80), ago(90), 0), ("warn", False, False, None, None, None, ago(36), 0),
        ("keep", False, True, None, ago(3), ago(5), ago(90), 1), ("keep", False, False, ago(2), ago(3), ago(5), ago(90), 1),
    ]
    df = spark.createDataFrame(files, "want string, replaced boolean, starred boolean, promoted timestamp, warned timestamp, last_listen timestamp, downloaded timestamp, recent int")
    assert all(r["want"] == r["action"] for r in funnel.classify(df, F.lit(now)).collect())


def test_replacements_settling_and_dates(spark):
    files = spark.createDataFrame([("same", "I1", 200.0, "a", "t"), ("shorter", "I1", 190.0, "x", "x"), ("by key", None, 100.0, "b", "u"), ("two", "", 100.0, "c", "v"), ("none", "I9", 1.0, "d", "w")], "file string, isrc string, s double, artist string, title string")
    library = spark.createDataFrame([("p1", "I1", 201.0, "a", "t"), ("p2", "I1", 150.0, "a", "t"), ("p3", None, 102.9, "b", "u"), ("p4", None, 110.0, "b", "u"), ("p5", "", 100.0, "c", "v"), ("p6", "", 101.0, "c", "v")], "path string, isrc string, s double, artist string, title string")
    assert rows(funnel.replacements(files, library, "file", "path", "isrc", "s", ["artist", "title"])) == [("by key", "p3"), ("same", "p1")]
    now = dt.datetime(2024, 6, 1)
    times = spark.createDataFrame([("new", now - dt.timedelta(seconds=59), None), ("old", now - dt.timedelta(seconds=60), now)], "file string, changed timestamp, recorded timestamp")
    assert rows(funnel.settled(times, "changed", F.lit(now)), "file") == [("old",)]
    assert [r["downloaded"] == (r["recorded"] or r["changed"]) for r in funnel.downloaded(times, ["recorded", "changed"]).collect()] == [True, True]


def test_verdicts(spark):
    df = spark.createDataFrame([(0.7, 100.0, 100.0, "WRONG"), (0.9, 100.0, 101.0, "WRONG"), (0.9, 100.0, 120.0, "WRONG"), (None, 100.0, None, "WRONG"), (None, 100.0, 100.0, "REVIEW"), (0.1, 1.0, 1.0, "OK")], "s double, d double, r double, v string")
    out = verdicts.audio_verdict(df.withColumn("off", F.lit(11)), "s", "d", "r", "v", "off")
    assert [r["verdict"] for r in out.collect()] == ["wrong", "ok", "doubtful", "wrong", "doubtful", "ok"]
    found = spark.createDataFrame([("a", 0.9, True, True, True, True, True), ("b", 0.5, True, True, True, True, True), ("c", 0.8, False, True, False, True, False), ("d", 0.8, False, False, False, True, False), ("e", 0.8, False, False, False, False, False)], "f string, s double, i boolean, g boolean, v boolean, t boolean, k boolean")
    assert rows(verdicts.print_verdict(found, "f", "s", "i", "g", "v", "t", "k")) == [("a", "OK"), ("b", "UNKNOWN"), ("c", "OTHER VERSION"), ("d", "REVIEW"), ("e", "WRONG")]


def test_audit_sections(spark):
    songs = spark.createDataFrame([(1, "[00:10.00] a", 20.0), (2, "[00:30.00] a", 24.0), (3, "[01:00.00] a", 20.0), (4, "no marks", 20.0), (5, None, 20.0)], "id int, lyrics string, seconds double")
    assert rows(audit.lyrics(songs, "id", "lyrics", "seconds"), "key", "section") == [("2", "lyrics slightly long"), ("3", "lyrics too long"), ("4", "lyrics without marks"), ("5", "lyrics missing")]
    assert audit.lyrics(songs.where("id = 5").withColumn("silent", F.lit(True)), "id", "lyrics", "seconds", "silent").count() == 0
    names = [("A", "2001 - Hits", ["g"]), ("A", "2001 - Hits (Deluxe)", []), ("A", "2001 - Other", ["h"]), ("B", "2001 - Hits", ["g"]), ("A", "2005 - Something", ["g", "h"]), ("C", "2002 - Donde Jugaran Las", None), ("C", "2002 - Donde Jurgaran Las", []), ("C", "2003 - Donde Jugaran Laz", []), ("C", "2002 - Donde_Jugaran Las", []), ("D", "1990 - Part 12345", []), ("D", "1990 - Part 12346", []), ("D", "1990 - (1990)", [])]
    albums = spark.createDataFrame(names, "artist string, album string, groups array<string>")
    none = spark.createDataFrame([], "folder_1 string, folder_2 string")
    found = [("2001 - Hits | 2001 - Hits (Deluxe)", "editions"), ("2001 - Hits | 2005 - Something", "same release group"), ("2001 - Other | 2005 - Something", "same release group"), ("2002 - Donde Jugaran Las | 2002 - Donde Jurgaran Las", "misspelled"), ("2002 - Donde Jugaran Las | 2002 - Donde_Jugaran Las", "editions"), ("2002 - Donde Jurgaran Las | 2002 - Donde_Jugaran Las", "misspelled")]
    got = rows(audit.albums_alike(albums, "artist", "album", none, "groups"), "key", "detail")
    assert {k for k, _ in got} == {k for k, _ in found} and dict(got)["2001 - Hits | 2001 - Hits (Deluxe)"] == "editions" and dict(got)["2001 - Hits | 2005 - Something"] == "same release group"
    assert all(v == "misspelled" for k, v in got if k.startswith("2002"))
    apart = spark.createDataFrame([("2001 - Hits (Deluxe)", "2001 - Hits")], "folder_1 string, folder_2 string")
    assert len(got) - 1 == audit.albums_alike(albums, "artist", "album", apart, "groups").count()
    covers = spark.createDataFrame([(1, []), (2, [(3, 600, 600)]), (3, [(3, 200, 300), (4, 1, 1)]), (4, [(4, 600, 600)]), (5, [(2, 600, 600), (3, 295, 295)]), (6, [(3, 0, 5)])], "id int, pictures array<struct<type: int, w: int, h: int>>")
    assert rows(audit.covers(covers, "id", "pictures"), "key", "section") == [("1", "cover missing"), ("3", "cover not square"), ("3", "cover too small"), ("3", "several covers"), ("4", "cover not a front"), ("5", "cover small"), ("5", "several covers"), ("6", "cover not readable")]


def test_put_back_meets_neighbours_across_bands(spark):
    entries = spark.createDataFrame([("p", i, f"s{i}") for i in (1, 9, 21, 40)], "playlist string, pos int, path string")
    gone = spark.createDataFrame([("p", 10, "a"), ("p", 30, "b"), ("p", 55, "c"), ("q", 1, "d"), ("p", None, "e")], "playlist string, pos int, path string")
    out = {r["path"]: (r["after"], r["ahead_of"]) for r in changes.put_back(entries, gone, "playlist", "pos", "path").collect()}
    assert out == {"a": (9, None), "b": (21, None), "c": (None, None), "d": (None, None), "e": (None, None)}
    ahead = changes.put_back(entries.where("pos > 9"), gone.where("path = 'b'").withColumn("pos", F.lit(15)), "playlist", "pos", "path")
    assert rows(ahead, "after", "ahead_of") == [(None, 21)]


def test_first_resolved_and_totals(spark):
    candidates = spark.createDataFrame([("u", "a", 3), ("u", "b", 9), ("u", "c", 5), ("u", None, 99), ("v", "z", 1)], "user string, song string, score int")
    known = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "song string")
    assert rows(match.first_resolved(candidates, known, ["song"], ["user"], [F.desc("score")], 1)) == [("u", "c", 5, 1)]
    assert rows(audit.totals(candidates, {"high": F.col("score") > 4})) == [(5, 3)]
    assert rows(audit.totals(candidates.limit(0), {"high": F.col("score") > 4})) == [(0, 0)]


def test_equal_scores_give_one_verdict(spark):
    found = spark.createDataFrame([("a", 0.8, False, False, False, t, False) for t in (True, False)], "f string, s double, i boolean, g boolean, v boolean, t boolean, k boolean")
    for order in (found, found.orderBy("t")):
        assert rows(verdicts.print_verdict(order, "f", "s", "i", "g", "v", "t", "k")) == [("a", "REVIEW")]


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 40))) for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaaab", "the beatles", "the beatless", "abcabcabcabc", "abcabcabcabd"]
    names = []
    for x in base:
        names.append(x)
        for _ in range(rng.randrange(0, 4)):
            y = list(x)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(y))
                y[k : k + 1] = rng.choice([[], ["z"], [y[k], "y"]])
            names.append("".join(y) or "q")
    blocks = [rng.choice("xy") for _ in names]
    df = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(zip(names, blocks))], "id int, name string, block string")
    for block in (None, "block"):
        wanted = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if names[i] != names[j] and min(len(names[i]), len(names[j])) >= 5 and (block is None or blocks[i] == blocks[j]) and difflib.SequenceMatcher(None, *sorted((names[i], names[j]))).ratio() >= 0.9}
        assert {(r["a"], r["b"]) for r in match.similar_names(df, "id", "name", block).collect()} == wanted and len(wanted) > 20


def test_similar_titles_differ_little_in_duration(spark):
    songs = spark.createDataFrame([(1, "a", "Strange Days", 100.0), (2, "a", "Strange Dayz", 105.0), (3, "a", "Strange Dayz", 106.0), (4, "b", "Strange Dayz", 100.0), (5, "", "Strange Dayz", 100.0)], "id int, artist string, title string, s double")
    assert rows(match.similar_titles(songs, "id", "artist", "title", "s"), "a", "b") == [(1, 2)]


def test_greedy_rounds_equal_one_pass(spark):
    rng = random.Random(3)
    pairs = [(g, a, b, rng.choice([0.1, 0.2, 0.3])) for g in "xy" for a in range(8) for b in range(8) if rng.random() < 0.6]
    wanted = []
    for g in "xy":
        used_a, used_b = set(), set()
        for _, a, b, far in sorted((p for p in pairs if p[0] == g), key=lambda p: (p[3], p[1], p[2])):
            if a not in used_a and b not in used_b:
                wanted.append((g, a, b))
                used_a.add(a)
                used_b.add(b)
    df = spark.createDataFrame(pairs, "folder string, a int, b int, far double")
    assert rows(match.greedy_pairs(df, ["folder"], "a", "b", ["far"]), "folder", "a", "b") == sorted(wanted)


def test_nearest_other_equals_all_pairs(spark):
    rng = random.Random(8)
    data = [(rng.choice("pqr"), i, rng.randrange(12)) for i in range(40)] + [("single", 99, 1)]
    wanted = sorted((i, min((abs(v - w), j) for h, j, w in data if h == g and j != i)[1]) for g, i, v in data if g != "single")
    assert rows(match.nearest_other(spark.createDataFrame(data, "g string, i int, v int"), ["g"], "i", "v")) == wanted


def test_banded_join_equals_plain_one(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.uniform(-20, 900)) for i in range(150)], "i int, x double").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(j, rng.uniform(-20, 900)) for j in range(150)], "j int, y double").withColumn("k", F.lit(1))
    near = ~tolerance.other_version(F.col("x"), F.col("y"))
    plain, banded = (rows(match.band_join(a, b, ["k"], near, bands), "i", "j") for bands in (None, (tolerance.band(F.col("x")), tolerance.band(F.col("y")))))
    assert plain == banded and len(plain) > 100


def test_candidates_are_ranked_by_what_speaks_for_them(spark):
    found = spark.createDataFrame([("f", c) for c in "abcdefg"], "file string, rid string")
    facts = [("f", "a", False, True, True, 3, 0.0), ("f", "b", True, False, False, 0, 9.0), ("f", "c", True, True, False, 1, 5.0), ("f", "d", True, True, False, 1, 2.0), ("f", "e", True, True, False, 2, 9.0), ("f", "f", None, None, None, None, None)]
    evidence = spark.createDataFrame(facts, "file string, rid string, record boolean, isrc boolean, print boolean, level int, seconds_off double")
    out = match.ranked_candidates([("one", found), ("two", found.where("rid = 'g'"))], ["file"], "rid", evidence)
    assert [r["rid"] for r in out.orderBy("place").collect()] == ["e", "d", "c", "b", "a", "g", "f"]


def test_offers_of_shops(spark):
    songs = [
        (1, "Daft Punk", "One More Time", 320.0), (2, "Pharrell Williams & Daft Punk", "Get Lucky (feat. Nile)", 248.0), (3, "Shakira", "Ojos Asi", 200.0), (4, "Juan Luis Guerra", "La Bilirrubina", 240.0),
        (5, "Nobody", "No Time", None), (6, "Ab", "Y", 100.0), (7, "Daft Punk", "Harder", 224.0), (8, None, None, 1.0), (9, "Q", "Short", 0.0),
    ]
    offers = [
        (10, 0, ["Daft Punk"], "One More Time (Radio Edit)", 235.0), (11, 1, ["Daft Punk", "Romanthony"], "One more time", 321.0), (12, 0, ["Someone"], "One More Time", 320.0), (16, 1, ["Daft Punk"], "One More Time", 320.5), (13, 2, ["Daft Punk"], "Get Lucky Mix", 248.5),
        (30, 0, ["Shakira"], "Ojos Asi - Remix", 200.0), (40, 1, ["Juan Luis Guerra 4.40"], "La Bilirrubina", 242.0), (50, 1, ["Nobody"], "No Time", 99.0), (51, 2, ["Nobody"], "No Time", None), (60, 0, ["Cabo"], "Y", 100.0), (61, 0, ["Z"], "Y", 100.0),
        (70, 2, ["Daft Punk"], "Harder, Better", 225.0), (71, 3, ["Daft Punk"], "Harder Live", 225.5), (72, 3, ["Daft Punk"], "Harder (Remastered)", 226.0), (80, 0, [None], None, 1.0), (90, 3, ["q"], "Short", 77.0),
    ]
    got = match.shop_matches(spark.createDataFrame(songs, "song int, artist string, title string, seconds double"), spark.createDataFrame(offers, "offer int, store int, artists array<string>, title string, seconds double"), looser=[2])
    assert rows(got, "song", "offer", "store", "state", "seconds_off") == [
        (1, 16, 1, "ok", 0.5), (2, 13, 2, "review title", 0.5), (3, None, None, "none", None), (4, 40, 1, "ok", 2.0), (5, 50, 1, "review", 0.0), (6, 60, 0, "ok", 0.0), (7, 72, 3, "ok", 2.0), (8, None, None, "none", None), (9, 90, 3, "review", 0.0),
    ]


def test_names_that_hold_others(spark):
    names = ["guerra440", "guerra", "art1", "art10", "x", "xy", "zzz", "", None, "aaaa"]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "n string")
    needles = ["guerra", "art1", "x", "xy", "zz", "none", "", None, "aaa", "guerra440long"]
    got = match.names_containing(frame(needles), frame([*names, *names]))
    assert rows(got) == sorted((a, b) for a in needles for b in names if a and b and a in b)


def test_more_audit_sections(spark):
    songs = [("A", "t", ["R", "P"]), ("A", "t", ["J"]), ("Various Artists", "t", ["R", "P", "J"]), ("Soundtracks", "X", ["R", "Soundtrack", "P"]), ("Soundtracks", "Y", ["R", "J", "P", "Soundtrack"]), ("B", "t", None)]
    df = spark.createDataFrame(songs, "artist string, track_artist string, genres array<string>")
    assert rows(audit.artists_of_many_genres(df, "artist", "track_artist", "genres"), "key", "detail") == [("A", "J ; P ; R"), ("Soundtracks: Y", "J ; P ; R")]
    covers = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", None)], "album string, cover string")
    assert rows(audit.mixed_covers(covers, "album", "cover"), "key", "detail") == [("a", "x×2 / y×1")]
    lyrics = spark.createDataFrame([(1, "words", True), (2, "", True), (3, "words", None)], "id int, text string, silent boolean")
    assert rows(audit.lyrics_of_instrumentals(lyrics, "id", "text", "silent"), "key") == [("1",)]
    folders = spark.createDataFrame([("A",), ("A/one",), ("A/two",), ("B",)], "folder string")
    files = spark.createDataFrame([("A/one/x.flac",), ("A/one/cover.jpg",), ("top.txt",)], "path string")
    assert rows(audit.empty_folders(folders, files), "key") == [("A/two",), ("B",)]
    assert rows(audit.other_files(files, "path", readers.is_audio(F.element_at(F.split("path", "/"), -1))), "key") == [("A/one/cover.jpg",), ("top.txt",)]
    state = spark.createDataFrame([("a", 0, "", True, None, ""), ("b", 1, "bad frame", False, "x", "MP3")], "id string, code int, said string, md5 boolean, error string, lossy string")
    for part in (audit.damaged(state, "id", "code", "said"), audit.unreadable(state, "id", "error"), audit.unsigned(state, "id", "md5"), audit.lossy_files(state, "id", "lossy")):
        assert rows(part, "key") == [("b",)]
    artists = spark.createDataFrame([(x,) for x in ("The Beatles", "Beatles", "Buckethead", "The Bucketheads", "Abba", "Abbas")], "artist string")
    known = spark.createDataFrame([("The Bucketheads", "Buckethead")], "artist_1 string, artist_2 string")
    assert rows(audit.artists_alike(artists, "artist", known), "key") == [("Beatles | The Beatles",)]
    releases = spark.createDataFrame([(1, "Thriller (Deluxe)", "Thriller"), (2, "Thriller", "Summer Hits"), (3, "", "x")], "id int, album string, release string")
    assert rows(audit.foreign_releases(releases, "id", "album", "release"), "key") == [("2",)]
    recordings = spark.createDataFrame([(1, "Song", "Song", 200.0, 201.0, ["A"], ["B"]), (2, "Song", "Other", 200.0, 300.0, ["A"], ["B"])], "id int, t string, rt string, s double, rs double, i array<string>, ri array<string>")
    assert rows(audit.foreign_recordings(recordings, "id", "t", "rt", "s", "rs", "i", "ri"), "key") == [("2",)]
    media = spark.createDataFrame([("A/one/1.flac", "x"), ("A/one/2.flac", "y"), ("A/two/1.flac", "x"), ("B/f/1.flac", "z"), ("C/g/1.flac", "z")], "path string, album_id string")
    names = spark.createDataFrame([("x", "X"), ("z", "Z")], "id string, name string")
    assert rows(audit.player_albums(media, names), "section", "key", "detail") == [("album of several artists", "Z", "B/f | C/g"), ("joined folders", "X", "A/one | A/two"), ("split folder", "A/one", "X / y")]


def test_verdicts_on_pairs(spark):
    cases = [
        (0.95, True, False, 200.0, 200.0, None, None, True, "copies"), (0.95, False, False, 200.0, 200.0, 0.7, 0.9, True, "wrong audio"), (0.95, False, False, 200.0, 200.0, None, 0.9, True, "same audio, unconfirmed"),
        (0.95, False, False, 200.0, 200.0, 0.82, 0.9, True, "same audio, unconfirmed"), (0.99, False, False, 200.0, 200.0, 0.9, 0.9, True, "copies"), (0.99, False, False, 200.0, 200.0, 0.9, 0.9, False, "same audio, two names"),
        (0.99, False, False, 200.0, 250.0, 0.9, 0.9, False, "shared audio"), (0.97, False, False, 200.0, 200.0, 0.9, 0.9, False, "shared audio"), (0.6, False, True, 200.0, 200.0, None, None, False, "wrong id"),
        (0.6, True, True, 200.0, 200.0, None, None, True, "versions"), (0.8, False, True, 200.0, 200.0, None, None, True, "versions"), (None, False, True, 200.0, 200.0, None, None, True, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, score double, song boolean, id boolean, a double, b double, pa double, pb double, title boolean, want string")
    got = audit.audio_pairs(df, "score", "song", "id", "a", "b", "pa", "pb", "title").orderBy("i").collect()
    assert [r["verdict"] for r in got] == [r["want"] for r in got]


def test_links_files_and_first_of_each(spark, tmp_path):
    df = spark.createDataFrame([("i", None, 3, "u1"), ("i", "k", 1, "u2"), ("", "k", 2, "u3"), (None, "k", 4, "u3"), (None, None, 5, "u5"), (None, "", 6, None)], "sid string, key string, n int, link string")
    assert rows(match.first_of_each(df, ["sid", "key"], [F.col("n")]), "n") == [(1,), (2,), (5,), (6,)]
    writers.write_links(df.where("link is not null"), str(tmp_path / "links"), "link", [F.desc("n")])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "links")).collect()] == ["u5", "u3", "u1", "u2"]
    writers.write_tsv(df.select("n", "link"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 6
    writers.write_plan(df.withColumn("section", F.lit("x")), str(tmp_path / "plan"), "section")
    assert spark.read.parquet(str(tmp_path / "plan")).where("section = 'x'").count() == 6
    tracks = spark.createDataFrame([("A/2001 - B/01 - T.flac", "g"), ("A/T.flac", "g"), ("A/B/T.flac", "g"), ("A/B/01 - T.flac", "")], "path string, replaygain_track_gain string")
    assert rows(readers.unprocessed(tracks), "path", "why") == [("A/B/01 - T.flac", "gain"), ("A/B/T.flac", "name"), ("A/T.flac", "depth")]
    inodes = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "path string, ino int")
    assert rows(audit.hardlinks(inodes, "path", "ino"), "key", "detail") == [("a", "2")]
    tags = spark.createDataFrame([(1, ["x", "y"], ["z"])], "id int, title array<string>, album array<string>")
    assert rows(audit.several_values(tags, "id", ["title", "album"]), "key", "detail") == [("1", "title: x ; y")]
    state = spark.createDataFrame([("a",), ("gone",)], "item string")
    assert rows(funnel.live_state(state, spark.createDataFrame([("a",), ("a",)], "item string"), "item")) == [("a",)]
    dated = spark.createDataFrame([(1, "2001-13-x"), (2, "1850"), (3, "2001"), (4, None)], "id int, date string")
    assert rows(audit.dates(dated, "id", "date", 2026), "key", "detail") == [("1", "odd format"), ("2", "year out of range")]


def test_genres_of_voters(spark):
    songs = [("Ann", "Ann", "x", "Rap/Hip Hop")] * 4 + [("Ann", "Ann", "x", "Urbano latino")] + [("Ann", "Ann", "x", "Jazz")] * 3 + [("Various Artists", "Q", "one", "House")] * 3 + [("Varios Artistas", "Q", "two", "nonsense")] + [("Soundtracks", "Ann", "f", None), ("Soundtracks", "Film", "f", "Original Score"), ("Soundtracks", "None", "f", None), ("Fix", "Fix", "x", "Metal"), (None, None, None, "Metal")]
    df = spark.createDataFrame(songs, "albumartist string, artist string, album string, source string").withColumn("genre", genres.genre_of(F.col("source")))
    fixed = spark.createDataFrame([("Fix", "Jazz"), ("Unheard", "Kids")], "name string, fixed string")
    got = genres.choose(genres.voters(df, "albumartist", "artist", "album"), fixed)
    assert {(r["kind"], r["name"]): (",".join(r["genres"]), r["doubtful"]) for r in got.collect()} == {
        ("artist", "Ann"): ("Reggaeton,Jazz", True), ("album", "one"): ("Electronic", False), ("soundtrack", "Ann"): ("Reggaeton,Jazz,Soundtrack", False), ("soundtrack", "Film"): ("Soundtrack", False),
        ("artist", "Fix"): ("Jazz", False), ("artist", "Unheard"): ("Kids", False), ("artist", "?"): ("Metal", False),
    }
