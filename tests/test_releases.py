"""Editions, numbering, shared ids and prints on hand-made rows."""

import random

from sieveworks.functions import similarity
from sieveworks.operators import audit, prints, releases


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edition_holds_all_songs(spark):
    songs = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b"), ("f", None), ("g", "z")], "folder string, song string")
    editions = spark.createDataFrame([("e1", "a", 1), ("e1", "b", 2), ("e2", "a", 2), ("e2", "b", 1), ("e3", "a", 1)], "edition string, song string, place int")
    assert rows(releases.choose_edition(songs, editions, "folder", "song", "edition", "place")) == [("f", "e1", 2, True)]
    assert rows(releases.choose_edition(songs, editions.where("edition <> 'e2'"), "folder", "song", "edition", "place")) == [("f", "e1", 1, False)]
    assert rows(releases.choose_edition(songs.limit(0), editions, "folder", "song", "edition", "place")) == []


def test_merged_edition_has_copies_and_newcomers(spark):
    schema = "album string, title string, id int, seconds double"
    base = spark.createDataFrame([("x", "a", 1, 100.0), ("x", "a", 2, 101.0)], schema)
    other = spark.createDataFrame([("x", "a", 10, 101.4), ("x", "a", 11, 200.0), ("x", "b", 12, None)], schema)
    assert rows(releases.merge_editions(base, other, ["title"], "album", "id", "seconds")) == [("x", 10, 2, None), ("x", 11, None, 901), ("x", 12, None, 902)]


def test_collected_album_is_numbered(spark):
    tracks = spark.createDataFrame([("p", "2001", 1), ("p", "1999", 2), ("q", "2000", 3), ("r", "1990", 4)], "folder string, day string, id int")
    works = spark.createDataFrame([("p", "w"), ("q", "w"), ("r", "v")], "folder string, work string")
    out = releases.collected_album(tracks, works, "folder", "work", ["day", "id"], "day")
    assert rows(out.select("id", "number", "album_date")) == [(1, 3, "1999"), (2, 1, "1999"), (3, 2, "1999")]


def test_shared_id_stays_with_the_best(spark):
    df = spark.createDataFrame([("i", 1, 0.9, 0.9), ("i", 2, 0.8, 0.5), ("i", 3, 0.8, None), ("j", 4, 0.1, 0.1), (None, 5, 1.0, 0.0)], "shared string, id int, score double, evidence double")
    assert rows(releases.shared_ids(df, "shared", "id", "score", "evidence")) == [("i", 1, 1, False), ("i", 2, 1, True), ("i", 3, 1, False)]


def test_list_of_the_same_size(spark):
    lists = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 2), ("c", 3)], "list string, id int")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert rows(releases.choose_list(lists, ids, "list", "id")) == [("a", 2)]
    assert rows(releases.choose_list(lists.where("list <> 'a'"), ids, "list", "id")) == []


def test_path_audit_of_a_clean_and_an_odd_file(spark):
    schema = "path string, tracknumber string, date string, album string, albumartist string"
    df = spark.createDataFrame([("A/2001 - B/01 - C.flac", "1", "2001-01-01", "B", "A"), ("A/2001 - B/02 - D.flac", "3", "1999", "Else", None), ("x.flac", None, None, None, None), (None, "1", None, None, None)], schema)
    found = rows(audit.paths(df).select("key", "section"))
    assert [s for k, s in found if k and k.startswith("A/2001 - B/01")] == []
    assert {s for k, s in found if k and k.startswith("A/2001 - B/02")} == {"number unlike file", "year unlike folder", "album unlike folder"}
    assert ("x.flac", "outside pattern") in found


def test_find_needs_every_word(spark):
    df = spark.createDataFrame([(1, "Canción de amor"), (2, "Amor"), (3, None)], "id int, t string")
    assert [r["id"] for r in releases.find(df, df["t"], "CANCION amor", order=["id"]).collect()] == [1]


def test_two_stage_similarity_finds_a_moved_print(spark):
    rng = random.Random(1)
    one = [rng.randrange(1 << 31) for _ in range(60)]
    other = [rng.randrange(1 << 31) for _ in range(60)]
    pairs = spark.createDataFrame([("moved", one, [7, 8, 9, *one[:50]]), ("other", one, other), ("short", one[:5], one[:5]), ("none", [], one)], "pair string, a array<long>, b array<long>")
    got = {r["pair"]: r for r in prints.pair_similarity(pairs, "pair", "a", "b").collect()}
    assert got["moved"]["similarity"] == 1.0 and not got["moved"]["exhaustive"]
    assert got["short"]["similarity"] == 1.0
    assert got["none"]["similarity"] is None
    whole = pairs.where("pair = 'other'").select(similarity.sliding_similarity("a", "b")).first()[0]
    assert got["other"]["exhaustive"] and got["other"]["similarity"] >= whole
    offset = prints.likely_offsets(pairs.where("pair = 'moved'"), "pair", "a", "b").orderBy("votes", ascending=False).first()
    assert (offset["offset"], offset["votes"]) == (-3, 50)
