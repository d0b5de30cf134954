"""Approximate search for test items against a full edit-distance table."""

import random
import re

from sieveworks.llm import decontamination as D


def norm(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).strip()


def distance(item, text):
    """The least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def case():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (8, 12, 20, 30)] + [None, "", "tiny", "a", "É!", "two words", "!!", "is 4 more than 3 of it", "tiny", "what is the capital oft", "twelve chars"]
    docs = [None, "", "tiny", items[0], items[1].upper() + "!", "x" * 50, "ant a", "a tiny-winy", "xtiny tinyx étiny", "Two\n words", "two wordss", "é", "it is 4 more than 3, of it", "is 4 more than 3 of its", "b a", "x what is the capitol oft y", "xwhat is the capital oft", "xwhat is the capital ofty", "twelve charz", "so twelve, chars", "is44 more than 3 of it"]
    for item in items[:4]:
        for edits in (0, 1, 3, 6, 12):
            t = list(item)
            for _ in range(edits):
                k, how = rng.randrange(len(t)), rng.randrange(3)
                t[k : k + 1] = [] if how == 0 else ["q", t[k]] if how == 1 else ["z"]
            docs.append(" ".join(word() for _ in range(30)) + "  " + "".join(t) + "\n\t" + " ".join(word() for _ in range(200)))
    return items, docs


def test_search_equals_brute_force(spark):
    items, docs = case()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(docs)], "doc_id long, text string, item_id int, distance string")
    wanted = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            most = int(len(norm(item)) * 0.08)
            if norm(item) and norm(text) and (n := distance(f" {norm(item)} ", f" {norm(text)} ")) <= most:
                wanted.add((d, i, n, most))
    assert {tuple(r) for r in D.find_items(table, benchmark).collect()} == wanted
    assert {(15, 13, 1, 1), (16, 13, 1, 1), (19, 14, 0, 0)} <= wanted and not any(d in (17, 18) for d, *_ in wanted)
    assert any(n for _, _, n, _ in wanted) and {(2, 6, 0, 0), (6, 7, 0, 0), (11, 8, 0, 0)} <= wanted
    kept = D.without_items(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(len(docs))} - {d for d, *_ in wanted}


def test_items_without_an_id(spark):
    benchmark = spark.createDataFrame([(None, "what is the capital of it"), (None, "another one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is the capital of it"), (2, "another two"), (None, "and another one")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in D.find_items(docs, benchmark).collect()) == [("1", None, 0), ("None", None, 0)]
    assert [r["doc_id"] for r in D.without_items(docs, benchmark).collect()] == [2]


def test_many_passes_and_none(spark, monkeypatch):
    items, docs = case()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    once = {tuple(r) for r in D.find_items(table, benchmark).collect()}
    monkeypatch.setattr(D, "PASS_CHARS", 100)
    assert {tuple(r) for r in D.find_items(table, benchmark).collect()} == once
    assert D.find_items(table, benchmark.limit(0)).count() == 0
    assert D.find_items(table.limit(0), benchmark).count() == 0
    assert D.without_items(table, benchmark.limit(0)).count() == len(docs)
