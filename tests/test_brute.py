"""Queries and operators that SQL can't express, against all pairs compared one by one."""

import difflib
import itertools
import json
import random
import re
import unicodedata
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import keys
from sieveworks.operators import audit, releases
from sieveworks.plans import registry
from sieveworks.sources import readers, zipped

FOLDER = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_exact_ratio_pairs(spark):
    """The query over its whole table."""
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", keys.artist_key(F.col("p_brand")).alias("brand"), "p_brand", keys.base_title(F.col("p_name")).alias("base"), "p_size").collect()
    want = []
    for x, y in itertools.combinations(sorted(parts, key=lambda r: r["p_partkey"]), 2):
        one, two = sorted((x["base"], y["base"]))
        if x["p_brand"] == y["p_brand"] and one != two and len(one) >= 5 and len(two) >= 5 and abs(x["p_size"] - y["p_size"]) <= 5 and (r := ratio(one, two)) >= 0.9:
            want.append((x["p_partkey"], y["p_partkey"], round(r, 6)))
    assert rows(registry.QUERIES["exact_ratio_pairs"](spark, FOLDER)) == sorted(want, key=repr)


EDITION = re.compile(r"\b(deluxe|edition|remastered)\b")


def core(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"\W", "", EDITION.sub(" ", plain))


def test_albums_alike_equal_all_pairs(spark):
    """Random names of one artist with many albums, a letter off here and there, against every pair."""
    draw = random.Random(6)
    words = ["silver", "harbour", "lantern", "meadow", "winter"]
    folders = set()
    for _ in range(160):
        name = " ".join(draw.sample(words, 2))
        if draw.random() < 0.5:
            i = draw.randrange(len(name))
            name = name[:i] + draw.choice("xyz1") + name[i + 1 :]
        folders.add((draw.choice("ab"), f"{draw.choice((1999, 2000))} - {name}{draw.choice(['', ' deluxe', ' (edition)', '!', ' 2'])}", draw.choice(["g1", "g2", "g3", None])))
    df = spark.createDataFrame([(a, f, [g] if g else []) for a, f, g in folders], "artist string, folder string, groups array<string>")
    known = [draw.sample([f for _, f, _ in folders], 2) for _ in range(30)]
    got = audit.albums_alike(df, "artist", "folder", spark.createDataFrame(known, "folder_1 string, folder_2 string"), "groups")
    groups = {}
    for a, f, g in folders:
        groups.setdefault((a, f), set()).update({g} - {None})
    want = []
    for (p, a), (q, b) in itertools.combinations(sorted(groups), 2):
        if p != q or a == b or any({a, b} == set(k) for k in known):
            continue
        x, y = core(a[7:]), core(b[7:])
        flat = lambda t: re.sub(r"[\s_()\[\].,:;'’!?¿¡-]", "", t.lower())
        letters = lambda t: re.sub("[0-9]", "", t)
        if x == y:
            kind = "misspelled" if flat(a) == flat(b) else "editions"
        elif letters(x) != letters(y) and min(len(x), len(y)) >= 6 and a[:4] == b[:4] and ratio(x, y) >= 0.9:
            kind = "misspelled"
        elif groups[p, a] & groups[q, b]:
            kind = "same release group"
        else:
            continue
        want.append((f"{a} | {b}", kind))
    assert rows(got, "key", "detail") == sorted(want, key=repr) and {"misspelled", "editions", "same release group"} == {k for _, k in want}
    assert any(core(k.split(" | ")[0][7:]) != core(k.split(" | ")[1][7:]) for k, d in want if d == "misspelled")


def test_artists_alike_equal_all_pairs(spark):
    draw = random.Random(7)
    names = set()
    for _ in range(150):
        name = draw.choice(["northern lights", "southern cross", "abcde", "queens"])
        i = draw.randrange(len(name))
        names.add(draw.choice(["", "The "]) + name[:i] + draw.choice(["", "q", name[i]]) + name[i:])
    key = lambda n: re.sub("^the", "", re.sub(r"\W", "", n.lower()))
    df = spark.createDataFrame([(n,) for n in names], "artist string")
    got = audit.artists_alike(df, "artist", spark.createDataFrame([], "artist_1 string, artist_2 string"))
    want = [f"{a} | {b}" for a, b in itertools.combinations(sorted(names), 2) if key(a) == key(b) or len(key(a)) >= 5 and len(key(b)) >= 5 and ratio(*sorted((key(a), key(b)))) >= 0.9]
    assert rows(got, "key") == sorted(((k,) for k in want), key=repr)


def test_folder_of_a_singing_artist(spark):
    songs = [("Yandel/2010 - X", "Bad Bunny", ["Bad Bunny", "Yandel"]), ("Yandel/2010 - X", "Bad Bunny", ["Bad Bunny"]), ("Yandel/2010 - X", "yandel", ["Yandel"]), ("A/2001 - Y", None, ["B"]), ("A/2001 - Y", "", None), ("C/2002 - Z", "C", ["D"])]
    df = spark.createDataFrame(songs, "folder string, aa string, artists array<string>")
    assert rows(audit.folder_artists(df, "folder", "aa", "artists")) == [("folder of a singing artist", "info", "Yandel/2010 - X", "Bad Bunny×2; 2 of 3"), ("folder of another artist", "decide", "A/2001 - Y", "B×1; 1 of 2")]


def test_zip_equals_the_unpacked_folder(spark, tmp_path):
    entry = lambda i: {"ts": f"2024-01-0{i}T00:00:00Z", "ms_played": 1000 * i, "spotify_track_uri": f"spotify:track:{i}", "master_metadata_track_name": f"n{i}", "other": 1}
    files = {"Streaming_History_Audio_1.json": [entry(1), entry(2), {"ts": "x"}], "deep/Streaming_History_Audio_2.json": [entry(3)], "Streaming_History_Video_1.json": [entry(9)], "Streaming_History_Audio_3.json": []}
    with zipfile.ZipFile(tmp_path / "my.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, json.dumps(body))
            (tmp_path / "open" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "open" / name).write_text(json.dumps(body))
        z.writestr("Streaming_History_Audio_4.json", "{broken")
        z.writestr("Streaming_History_Audio_5.json", '{"a": 1}')
    got, broken = zipped.zipped_history(spark, str(tmp_path / "my.zip"))
    want = readers.history(spark, str(tmp_path / "open"))
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 3
    assert [m for m, _ in rows(broken)] == ["Streaming_History_Audio_4.json", "Streaming_History_Audio_5.json"]
    assert got.rdd.getNumPartitions() == 5
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    assert zipped.zipped_history(spark, str(tmp_path / "empty.zip"))[0].count() == 0
    assert readers.history_events(got).where(F.col("listen")).count() == 0


def test_numbers_of_odd_editions(spark):
    """Songs and tracks that repeat, lack their name, keys or length, or have keys with the marks that divide lines, against going through all candidates."""
    draw = random.Random(11)
    names = ["a", "b", "", None, "a\tb", "a\\tb", "\\0", "+c", "x\ny"]
    seconds = [100.0, 102.5, 104.0, 109.0, 300.0, 306.0, None, float("nan"), 0.0]
    some = lambda values, n: draw.choice(values[: n if draw.random() < 0.6 else None])
    songs = [(f, some([1, 2, 3, None], 3), draw.choice([None, [], [some(names, 2)], [some(names, 3), some(names, 5)]]), some(names, 2), some(seconds, 4), draw.choice(["1990", "1991-02-03", None])) for f in range(60) for _ in range(draw.randint(1, 3))]
    tracks = [(e, some([1, 2, 3, 4, 5, None], 5), some(names, 4), some(names, 3), some(seconds, 4), some([1, 2, None], 1), draw.randint(1, 2)) for e in "pqrstu" for _ in range(draw.randint(3, 9))]
    editions = [(e, draw.choice([None, "1990", "1991-02-03", "1991"]), draw.choice([None, None, 4])) for e in "pqrstuv"]
    wanted = [(draw.randrange(62), draw.choice("pqrstuvw")) for _ in range(400)]

    near = lambda a, b, least, share: b != b or abs(a - b) <= max(least, share * b)
    fits, places = {}, {}
    for f, e in set(wanted):
        listed, rows_ = [t for t in tracks if t[0] == e], [s for s in songs if s[0] == f and s[1] is not None]
        pairs = set()
        for (_, song, isrcs, title, a, _), (_, track, isrc, name, b, _, _) in itertools.product(rows_, listed):
            if track is None or a is None or b is None or b <= 0:
                continue
            pairs |= {(1, song, track)} if isrc and isrc in (isrcs or ()) and near(a, b, 7, 0.03) else set()
            pairs |= {(2, song, track)} if title is not None and title == name and near(a, b, 3, 0.01) else set()
        taken = {}
        for by, song, track in sorted(pairs):
            if song not in taken and track not in [t for _, t in taken.values()]:
                taken[song] = by, track
        fact = next((x for x in editions if x[0] == e), None)
        if rows_ and listed and fact and (fact[2] is None or len(listed) >= fact[2]) and len(taken) == len({s[1] for s in rows_}):
            days = [s[5] or "" for s in songs if s[0] == f]
            day, date = min(set(days), key=lambda d: (-days.count(d), d)), fact[1] or ""
            places[f, e] = sorted(((song, t[5], t[6]) for song, (_, track) in taken.items() for t in listed if t[1] == track), key=repr)
            order = (-sum(by == 1 for by, _ in taken.values()), date != day, date[:4] != day[:4], len(listed), e)
            fits.setdefault(f, []).append((order, e, repr(places[f, e]), max((t[5] for t in listed if t[5]), default=None)))
    choice, numbers = [], []
    for f in {s[0] for s in songs}:
        found = fits.get(f, [])
        state = ["none", "numbered", "ambiguous"][min(2, len({(p, d and d > 1) for _, _, p, d in found}))]
        best = min(found)[1] if state == "numbered" else None
        choice.append((f, best, len(found), state))
        numbers += [(f, *place) for place in places[f, best]] if best else []

    kinds = ["folder int, song int, isrcs array<string>, title_key string, seconds double, date string", "edition string, date string, nb_tracks int", "edition string, track int, isrc string, title_key string, seconds double, disc int, pos int", "folder int, edition string"]
    for most in (releases.TASK_BYTES, 500):  # parts of some editions' folders
        got = releases.number_by_edition(*(spark.createDataFrame(x, kind) for x, kind in zip((songs, editions, tracks, wanted), kinds)), task_bytes=most)
        assert rows(got[0]) == sorted(choice, key=repr) and {c[3] for c in choice} == {"none", "numbered", "ambiguous"}
        assert rows(got[1]) == sorted(numbers, key=repr)
