"""Aligned tokens against both tokenizers run over whole texts, and perfect hashes of any key set."""

import functools
import os
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveworks.llm import token_align as T
from sieveworks.llm.perfect_hash import PerfectHash

pytestmark = pytest.mark.skipif(not os.path.exists(T.FIRST_MODEL), reason="no models")
FOLDER = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  two  spaces \n\n", "Héllo wörld, it's 3.14", "▁mark▁", "a ▁ b", "日本語 テキスト", "\x00\ttab\r\n  x;\r\n }", "🎉🎉 <|endoftext|> <s> </s>", "a" * 700, "x\n" * 50, " end ", "\n \n  x    y\x1c z", "ﬁne ½"]


@functools.cache
def _models():
    first = Tokenizer.from_file(T.FIRST_MODEL)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=T.SECOND_MODEL)


def brute(texts):
    """Rows by whole texts, without units, hashes or Spark."""
    first, second = _models()
    letters = T._byte_letters()
    rows, counts = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        one = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        two = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(one) != whole or b"".join(two) != whole:
            rows.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (one, two)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = bisect_left(ends[0], end) + 1, bisect_left(ends[1], end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            links.append((a[m - 1], b[n - 1]))
            i, j = m, n
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g)) for n_a, n_b, g, x in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("pairs_at_once", [T.PAIRS_AT_ONCE, 20])
def test_table(spark, pairs_at_once):
    texts = [*TEXTS, "Héllo wörld, it's 3.14", "it's Héllo"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_tokens(docs, pairs_at_once=pairs_at_once).collect()}
    for i, row in enumerate(brute(texts)):
        assert got[i] == row, texts[i]
    assert T.align_tokens(docs.limit(0)).count() == 0
    assert T.align_tokens(docs.where("text = ''")).first()["n_a"] == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one"), (7, None)], "doc_id long, text string")
    rows = T.align_tokens(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in rows) == [("7", 0), ("7", 1), ("None", 2), ("None", 2)]
    assert sorted(r["count_sum"] for r in rows) == [0, 3, 5, 5]


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_tokens(docs.repartition(5)).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()))))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta1'▁\r"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_units_of_any_text(text):
    aligner = _aligner()
    assert "".join(T._UNIT.findall(" " + text)) == " " + text
    units, _ = aligner.units([text])
    facts = aligner.facts[units].sum(0)
    n_a, n_b, n = brute([text])[0][:3]
    assert (facts[:3].tolist() if len(units) else [0, 0, 0]) == [n_a, n_b, n]
    assert ";".join(aligner.groups[u] for u in units) == brute([text])[0][6]


@functools.cache
def _aligner():
    return T.Aligner(T.load_tokenizers())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 63) - 1), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    found = PerfectHash.of(keys)
    assert sorted(found.numbers(keys).tolist()) == list(range(len(keys)))
    others = keys ^ 1
    assert found.numbers(others).max(initial=-1) < max(len(keys), 1)


def test_vectors_of_many_tasks_are_summed_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN", 2)
    docs = spark.createDataFrame([(i, f"the end {i % 3}") for i in range(40)], "doc_id long, text string").repartition(5)
    texts = ["the end 0", "the end 1", "the end 2"]
    want = brute([texts[i % 3] for i in range(40)])
    got = {r["doc_id"]: tuple(r)[1:] for r in T.align_tokens(docs).collect()}
    assert [got[i] for i in range(40)] == [tuple(w) for w in want]
