"""Language ID and language-model scoring: held-out accuracy, and the exact parts against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sieveworks.llm import hmm_score as H
from sieveworks.llm import language_id as L

SYLLABLES = {"xx": "ka to mi ru se na".split(), "yy": "éch oul ien aux tré pon".split(), "zz": "ßen lich ung der sch tze".split()}


def text(rng, lang, words=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def docs(spark, n=150):
    rng = random.Random(5)
    rows = [(i, lang := rng.choice(list(SYLLABLES)), text(rng, lang, rng.choice([5, 40, 300])), "z") for i in range(n)]
    rows += [(n, "xx", None, ""), (n + 1, "xx", "", ""), (n + 2, None, "12 !! 3", ""), (n + 3, None, rows[0][2], ""), (n + 3, None, rows[0][2], ""), (n + 4, "xx", "日本語" * 2000, "")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, score string"), rows


def test_language_id(spark):
    df, rows = docs(spark)
    df = df.withColumn("held_out", L.held_out())
    assert {r["doc_id"]: r["held_out"] for r in df.collect()} == {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    profiles = L.learn(df.where("not held_out").where("doc_id < 150"))
    assert list(profiles) == ["xx", "yy", "zz"]
    got = L.identify(df.select("doc_id", "lang", "text", "held_out"), profiles).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 150]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0
    nothing = [r for r in got if r["doc_id"] in (150, 151, 152)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in nothing)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert L.learn(df.limit(0)) == {} and {r["lang_pred"] for r in L.identify(df.select("text"), {}).collect()} == {"und"}


def test_grams_equal_plain_counting():
    texts = ["ab  c", "", "12", "É a", "x"]
    data = "".join(t.lower() for t in texts).encode()
    offsets = np.cumsum([0, *(len(t.lower().encode()) for t in texts)])
    grams = L.Grams(np.frombuffer(data, np.uint8), offsets)
    size = len(grams.alphabet)
    seen = Counter((int(t), "".join(chr(grams.alphabet[x]) for x in (c // size**2, c // size % size, c % size))) for t, c in zip(grams.text, grams.codes[grams.gram]))
    wanted = Counter()
    for i, t in enumerate(texts):
        spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        if spaced.strip():
            wanted.update((i, spaced[k : k + 3]) for k in range(len(spaced) - 2))
    assert seen == wanted
    assert grams.lettered.tolist() == [True, False, False, True, True]


def test_bundles_and_cosines_equal_plain_sums(spark):
    """Vectors bound letter by letter, added gram by gram, against the operator."""
    size = 256
    letter = lambda c: np.random.default_rng(ord(c)).integers(0, 2, size).astype(int) * 2 - 1

    def bundle(text):
        spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        out = np.zeros(size)
        for a, b, c in zip(spaced, spaced[1:], spaced[2:]) if spaced.strip() else ():
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    df, rows = docs(spark, 40)
    profiles = L.learn(df, dimensions=size)
    for lang in SYLLABLES:
        assert np.allclose(profiles[lang], sum(bundle(t) for _, x, t, _ in rows if x == lang))
    for r in L.identify(df.select("doc_id", "text"), profiles).collect():
        mine = bundle(r["text"])
        cosines = {k: float(mine @ v / np.linalg.norm(mine) / np.linalg.norm(v)) if mine.any() else 0.0 for k, v in profiles.items()}
        if mine.any():
            assert math.isclose(r["score"], max(0.0, max(cosines.values())), abs_tol=1e-6)
            assert cosines[r["lang_pred"]] >= max(cosines.values()) - 1e-6
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def brute_likelihood(model, symbols):
    """The sum over all state paths."""
    import itertools

    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[path[0], symbols[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    return math.log10(total)


def brute_counts(model, symbols):
    """Expected counts of one sequence, from unscaled forward and backward vectors; extended floats hold 1e-4000."""
    exact = lambda x: np.atleast_2d(x).astype(np.longdouble)
    (start,), move, emit, k = exact(model.start), exact(model.move), exact(model.emit), len(model.start)
    forward = [[start[i] * emit[i][symbols[0]] for i in range(k)]]
    for s in symbols[1:]:
        forward.append([sum(forward[-1][i] * move[i][j] for i in range(k)) * emit[j][s] for j in range(k)])
    backward = [[np.longdouble(1)] * k]
    for s in symbols[:0:-1]:
        backward.insert(0, [sum(move[i][j] * emit[j][s] * backward[0][j] for j in range(k)) for i in range(k)])
    whole = sum(forward[-1])
    out = np.zeros((k, 1 + k + model.emit.shape[1]))
    for t, s in enumerate(symbols):
        for i in range(k):
            out[i, 1 + k + s] += float(forward[t][i] * backward[t][i] / whole)
            out[i, 0] += float(forward[t][i] * backward[t][i] / whole) if t == 0 else 0
            for j in range(k if t else 0):
                out[j, 1 + i] += float(forward[t - 1][j] * move[j][i] * emit[i][s] * backward[t][i] / whole)
    return out


def test_forward_recursion_and_baum_welch():
    rng = np.random.default_rng(1)
    model = H.Model.random(3, 5)
    lists = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    flat, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
    starts = np.cumsum(lengths) - lengths
    sequences = H.Sequences(flat, starts, lengths)
    assert np.allclose(H.log_likelihoods(model, sequences), [brute_likelihood(model, x) for x in lists])
    counts = H.expected_counts(model, flat, starts, lengths)
    assert np.allclose(counts, sum(brute_counts(model, x.tolist()) for x in lists))
    assert np.isclose(counts[:, 0].sum(), 4) and np.isclose(counts[:, 1:4].sum(), lengths.sum() - 4) and np.isclose(counts[:, 4:].sum(), lengths.sum())
    better = H.Model.from_counts(counts - 0.01 + 1e-9, 3)
    assert H.log_likelihoods(better, sequences).sum() > H.log_likelihoods(model, sequences).sum()


def test_counts_of_long_texts_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    model = H.Model.random(3, 5)
    lists = [rng.integers(0, 5, n) for n in (601, 1, 37, 64, 65, 128, 600)]
    flat, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
    starts = np.cumsum(lengths) - lengths
    wanted = sum(brute_counts(model, x.tolist()) for x in lists)
    for size in (1, 2, 64, 599, 600, 10**6):
        assert np.allclose(H.expected_counts(model, flat, starts, lengths, size), wanted), size
    assert H.expected_counts(model, flat, starts[:0], lengths[:0]).sum() == 0


def test_score_equals_brute_force(spark, monkeypatch):
    """Forward part, class part and the join of rare words, against one model of all words."""
    monkeypatch.setattr(H, "NEAR_WORDS", 6)
    monkeypatch.setattr(H, "SYMBOL_WORDS", 3)
    rng = random.Random(7)
    vocabulary = [f"w{i}x{i % 3}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 1 + i % 30]) for _ in range(rng.randrange(0, 4)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.col("doc_id") % 10 == 0)
    kept = {}
    monkeypatch.setattr(H, "train", lambda encoded, symbols, states, rounds, train=H.train: kept.setdefault("model", train(encoded, symbols, states, rounds)))
    monkeypatch.setattr(H, "count_words", lambda docs, count=H.count_words: kept.setdefault("words", count(docs)))
    got = {r["doc_id"]: r["score"] for r in H.score_texts(df, F.col("held"), states=3, rounds=2).collect()}
    model, lexicon = kept["model"], kept["words"][1]
    count = Counter(w for i, t in rows if i % 10 for w in [*t.encode().split(), b""])
    ranked = sorted((w for w in count if w), key=lambda w: (-count[w], w))
    symbol = {b"": 0} | {w: i for i, w in enumerate(ranked[: lexicon.symbols - 1], 1)}
    in_class = Counter()
    kinds = Counter()
    for w in ranked[lexicon.symbols - 1 :]:
        in_class[H._class_of(w)] += count[w]
        kinds[H._class_of(w)] += 1
    assert lexicon.symbols > 1 and len(ranked) > lexicon.symbols
    for i, t in rows:
        symbols, extra = [], 0.0
        for w in [*t.encode().split(), b""]:
            c = H._class_of(w)
            symbols.append(symbol.get(w, lexicon.symbols + c))
            if w not in symbol:
                extra += math.log10((count[w] + 0.1) / (in_class[c] + 0.1 * (kinds[c] + 1)))
        assert math.isclose(got[i], brute_likelihood(model, symbols) + extra, rel_tol=1e-9), t


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(H, "NEAR_WORDS", 30)
    monkeypatch.setattr(H, "SYMBOL_WORDS", 10)
    rng = random.Random(2)
    rows = [(i, text(rng, "xx", rng.randrange(0, 50)), "k") for i in range(60)] + [(60, None, "k"), (61, " \t\r", "k"), (62, "Ünknown wörd KATO", "k"), (5, "ka ka", "k"), (5, "ka ka", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    got = H.score_texts(df, L.held_out(parts=10, part=0), rounds=1).collect()
    wanted = sorted((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((*r[:5], round(r[5], 6)) for r in map(tuple, got)) == wanted
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert H.score_texts(df.limit(0), F.lit(False)).count() == 0
