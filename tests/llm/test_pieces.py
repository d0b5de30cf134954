"""Piece codec: exact round trips, and the search against brute force."""

import functools
import os
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.DEFAULT_MODEL), reason="no model")
TEXTS = [None, "", " ", "  two  spaces \n\n", "Héllo wörld", "▁mark▁", "日本語 テキスト", "\x00\ttab\r\n", "🎉🎉", "a" * 700, "x\n" * 50, " end "]


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.load_vocabulary())


def spelled(encoder, ids):
    return b"".join(encoder.vocabulary.decoded[i] for i in ids).decode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_round_trip_of_any_text(encoder, text):
    ids, lengths = encoder.encode([text])
    assert lengths.tolist() == [len(ids)]
    assert spelled(encoder, ids).removeprefix(" ") == text


@pytest.mark.parametrize("word", [" the", " information", "naïveté", " zzqx", "ß日x", " éauxtion"])
def test_search_equals_brute_force(encoder, word):
    scores = {t: s for t, s in zip(encoder.vocabulary.texts, encoder.scores) if t}

    @functools.cache
    def best(i):
        if i == len(word):
            return 0.0
        return max(scores.get(word[i:j], encoder.unknown if j == i + 1 else float("-inf")) + best(j) for j in range(i + 1, len(word) + 1))

    ids, _ = encoder.search([word], len(word))
    bytes_ = set(encoder.vocabulary.byte_ids)
    got, run = 0.0, b""
    for i in ids.tolist():
        if i in bytes_:
            run += encoder.vocabulary.decoded[i]
            try:
                run.decode()
                got, run = got + encoder.unknown, b""
            except UnicodeDecodeError:
                pass
        else:
            got += encoder.scores[i]
    assert got == pytest.approx(best(0))
    assert spelled(encoder, ids) == word


def test_tables(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 0)], "doc_id long, text string, ids int")
    got = P.round_trip(df).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["same"] for r in got)
    assert [r["ids"] for r in got if r["doc_id"] in (0, 1)] == [None, []]
    both = P.decode(P.encode(df.drop("ids")))
    assert all(r["text"] == r["decoded"] for r in both.collect())
    assert P.round_trip(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_agreement_with_replayed_merges(spark, encoder):
    """Ids that both ways of segmenting give; the README states the share at sf0.01."""
    reader = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null").collect()]
    ids, lengths = encoder.encode(texts)
    ends = lengths.cumsum()
    replayed = reader.encode(texts)
    common = sum((Counter(ids[e - n : e].tolist()) & Counter(other)).total() for e, n, other in zip(ends.tolist(), lengths.tolist(), replayed))
    assert common >= 0.85 * sum(map(len, replayed)) and len(ids) <= 1.01 * sum(map(len, replayed))
