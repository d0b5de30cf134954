"""Fill-in-the-middle: chunk sums and cuts against counting units one by one, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import fill_middle as M

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
LONG = "".join(f"word{i} ünd{'x' * (i % 40)} " for i in range(3000))
TEXTS = ["", " ", "a", "é", "one two", "a" * 9000, "é" * 5000, "1" * 9000, "has <P> inside", "<M>", "日本語 text\n\n", LONG, LONG[500:] + LONG[:700], "\x00z", "🎉ab🎉", "<<S", "S>P><"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z1é\n"), st.characters(exclude_categories=["Cs"])), max_size=300).map(lambda t: t * 7), max_size=6))
def test_chunk_sums_and_cuts(texts):
    memo = M.Memo(most_bytes=500)
    for got, text in zip(M.summed([t.encode() for t in texts], memo), texts):
        units = UNIT.findall(text)
        assert got.units[-1] == len(units) and got.points[-1] == len(text)
        for k in {0, len(units) // 3, len(units) // 2, max(len(units) - 1, 0), len(units)}:
            before = "".join(units[:k])
            assert got.cut(k) == (len(before.encode()), len(before))


def test_chunks_of_a_shared_passage_are_equal():
    """A passage is cut alike wherever it stands, and its summaries are found in the memo."""
    texts = [b"x" * 10 + LONG.encode(), b"another beginning, " * 20 + LONG.encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    one, two = M.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), offsets)
    chunks = [{t[a:b] for a, b in zip([0, *x[:-1]], x)} for t, x in ((texts[0], one), (texts[1], [e - len(texts[0]) for e in two]))]
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0]) and len(chunks[0]) > 100


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, TEXTS[11]) for i in range(100, 160)] + [(None, None), (None, "no id"), (3, "é"), (3, "é"), (-5, "minus five")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, output string").repartition(3)
    got = M.fill_middle(docs)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert M.fill_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<<S", "S>P><", "a<", ">b"])
def test_marks_that_parts_complete_are_not_mistaken(spark, text):
    rows = [(i, text * 3) for i in range(40)]
    got = M.fill_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["t"] == text * 3 for r in got.select(M.restored(F.col("output"), F.col("form")).alias("t")).collect())
