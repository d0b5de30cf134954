"""The two similarity joins against brute force, and connected components."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import jaccard_join as J
from sieveworks.llm.components import connected_components
from sieveworks.llm.jaccard_join import ngram_jaccard_join, runs_needed
from sieveworks.llm.vector_dedup import tables_needed, vector_dedup


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (5, 6)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    shared = " ".join(word() for _ in range(60))
    out = [None, "", "!!", "one two", "One  two!", "one two three", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(40, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
        out.append(" ".join(word() for _ in range(50)) + " " + shared)
    hot = [word() for _ in range(150)]
    for i in range(90):
        copy = list(hot)
        copy[i] = word()
        out.append(" ".join(copy))
    out += [out[20]] * 70
    return out


def test_jaccard_join_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    classes = closure(sets, links)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, id int, path string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (classes[i], sum(i in pair for pair in links)) for i in sets}


def test_large_groups_of_one_base_and_own_tails(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bases = [" ".join(word() for _ in range(60)) for _ in range(15)]
    rows = [(100 * g + i, base + " " + " ".join(word() for _ in range(6))) for g, base in enumerate(bases) for i in range(100)]
    sets = {i: shingles(t) for i, t in rows}
    near = {i: [j for j in sets if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    classes = closure(sets, [(i, j) for i in near for j in near[i]])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (classes[i], len(near[i])) for i in sets}
    assert {len(x) for x in near.values()} == {99}


def test_jaccard_join_of_little(spark):
    schema = "doc_id long, text string"
    assert ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    got = ngram_jaccard_join(spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "a b"), (4, "a b")], schema)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 1, 0), (2, 2, 0), (None, 4, 1), (4, 4, 0), (4, 4, 0)], key=repr)
    assert runs_needed(0.9995, 0.8, 2.0) > runs_needed(0.9, 0.8, 2.0) >= 1


def expected(rows, near):
    """(class, links) of each row (id, content) by brute force: rows with the same id and content are one."""
    kinds = sorted(set(rows), key=repr)
    links = [(i, j) for i in range(len(kinds)) for j in range(i) if near(kinds[i][1], kinds[j][1])]
    component = closure(range(len(kinds)), links)
    out = {}
    for i, (id_, content) in enumerate(kinds):
        reached = [kinds[j][0] for j in component if component[j] == component[i] and kinds[j][0] is not None]
        out[id_, content] = min(reached, default=None), sum(kinds[a + b - i][0] is not None for a, b in links if i in (a, b))
    return out


def test_jaccard_join_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows = []
    for g in range(30):
        base = [word() for _ in range(60)]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            copy[rng.randrange(60)] = word()
            rows.append((rng.choice([None, 1, 2, g, 100 + g]), " ".join(rng.choice([base, copy, copy]))))
    rows += rows[:20] + [(None, None), (None, ""), (1, None)]

    def near(a, b):
        a, b = shingles(a), shingles(b)
        return bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)

    wanted = expected(rows, near)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *wanted[i, t]) for i, t in rows), key=repr)


def test_vector_dedup_of_repeated_and_null_ids(spark):
    rows = [(3, (1.0, 0.0)), (3, (0.0, 1.0)), (4, (0.0, 1.001)), (2, (5.0, 1.0)), (1, (1.0, 2.0)), (1, (1.0, 2.0)), (None, (1.0, 2.0)), (None, (-1.0, 0.0)), (9, (-1.0, 0.0001)), (None, (-3.0, -3.0)), (None, (-3.0, -3.0)), (None, None)]
    near = lambda a, b: bool(a) and bool(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    wanted = expected(rows, near)
    df = spark.createDataFrame([(i, list(v) if v else None, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = [(r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in vector_dedup(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *wanted[i, v], None if i is None or wanted[i, v][0] is None else i == wanted[i, v][0]) for i, v in rows), key=repr)
    assert (4, 3, 1, False) in got and (1, 1, 0, True) in got and (None, 1, 1, None) in got


def test_vector_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 5)):
            rows.append(((centre + 0.05 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 2))))
    rows += [(rows[0][0], rows[0][1])] * 30 + [([2 * x for x in rows[1][0]], rows[1][1])]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None], 1), (rows[0][0], None), ([float("inf")] * 16, 0), ([1e300, 1e300], 0), ([1e300, 1e300 * 1.0001], 0), ([1.0, 0.0], 0)]
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    ids = range(len(rows))
    links = [(i, j) for i in ids for j in ids if i < j and rows[i][1] is not None and rows[i][1] == rows[j][1] and good(rows[i][0]) and good(rows[j][0]) and len(rows[i][0]) == len(rows[j][0]) and cosine(rows[i][0], rows[j][0]) >= 0.98]
    component = closure(ids, links)
    df = spark.createDataFrame([(i, v, x, "z") for i, (v, x) in enumerate(rows)], "vec_id long, embedding array<double>, label int, vector string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup(df).collect()}
    assert got == {i: (sum(i in p for p in links), component[i], component[i] == i) for i in ids}
    assert vector_dedup(df.limit(0)).count() == 0
    assert tables_needed(0.98, 16, 0.99999) > tables_needed(0.98, 8, 0.99999)


def test_vectors_of_floats(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert vector_dedup(df).where(F.col("kept")).count() == 1


def near_copies(sets):
    """For every twentieth id the ids of all sets with a Jaccard similarity of 0.8 or more, by an inverted index."""
    at = {}
    for i, x in sets.items():
        for shingle in x:
            at.setdefault(shingle, []).append(i)
    out = {}
    for i in sets:
        if i % 20 == 0:
            common = Counter(j for shingle in sets[i] for j in at[shingle])
            out[i] = {j for j, n in common.items() if j != i and 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)}
    return out


@pytest.mark.skipif(not os.path.exists(SF_DIR), reason="no test tables")
def test_recall_on_the_test_tables(spark):
    """Links of every twentieth row against all rows, by brute force."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    near = near_copies({r["doc_id"]: shingles(r["text"]) for r in docs.collect()})
    got = {r["doc_id"]: r["n_links"] for r in ngram_jaccard_join(docs).collect()}
    assert sum(map(len, near.values())) > 0
    assert all(got[i] <= len(near[i]) for i in near) and sum(got[i] for i in near) >= 0.99 * sum(map(len, near.values()))

    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], np.array(r["embedding"], float)) for r in vectors.collect() if r["label"] is not None]
    unit = np.stack([v / np.linalg.norm(v) for _, _, v in rows])
    label = np.array([x for _, x, _ in rows])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup(vectors).collect()}
    wanted = {i: int(n) - 1 for (i, _, _), n in zip(rows, linked.sum(1))}
    assert all(got[i] <= wanted[i] for i in wanted) and sum(got[i] for i in wanted) >= 0.99 * sum(wanted.values())


def test_texts_that_share_a_header_are_split_on(spark, monkeypatch):
    """5,000 texts of 60 words with the same 16 at the beginning, and 200 near copies of one: under a hundredth of all pairs meet, and the copies are linked."""
    rng = random.Random(8)
    header = [f"licence{i}" for i in range(16)]
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [" ".join(header + [word() for _ in range(44)]) for _ in range(5000)]
    base = texts[0].split()
    texts += [" ".join([*base[:-1], word()]) for _ in range(200)]
    met = []

    def counted(found, members, placed=J.placed):
        met.append(found.groupBy("path").count().agg(F.sum(F.col("count") * F.col("count") / 2)).first()[0])
        return placed(found, members)

    monkeypatch.setattr(J, "placed", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.ngram_jaccard_join(docs).collect()}
    copies = {0, *range(5000, 5200)}
    assert all(got[i] == (0, 200) for i in copies) and all(got[i] == (i, 0) for i in range(1, 5000))
    # near copies among themselves aside, which have to meet
    assert met[0] - 30 * 201**2 / 2 < 0.01 * 5200**2 / 2


def test_a_path_is_counted_in_one_row_a_task_and_sizes_rule_out_members(spark):
    texts = [(i, [7, 8], [*range(i, i + 50)]) for i in range(300)]
    rows = spark.createDataFrame(texts, "id long, paths array<long>, shingles array<long>").coalesce(1)
    split = rows.mapInArrow(J._children(2.0), "id long, parent long, size long, path long, bins array<int>")
    told = [(r["parent"], sum(r["bins"])) for r in split.where("bins is not null").collect()]
    assert sorted(told) == [(7, 300 * J.PROBES), (8, 300 * J.PROBES)]
    members = spark.createDataFrame([(1, 1, 10), (1, 2, 100), (1, 3, 80), (1, 4, 40), (2, 1, 10), (2, 5, 8), (3, 6, 79), (3, 2, 100)], "path long, id long, size long")
    assert sorted((r["path"], r["id"]) for r in J._near_sizes(members, 0.8).collect()) == [(1, 2), (1, 3), (2, 1), (2, 5)]


def test_texts_that_share_half_come_apart_at_once(spark, monkeypatch):
    """1,500 texts of 70 to 120 words with the same 40, and 400 pairs just over the threshold among them: such a path split into paths of the same texts over and over."""
    rng = random.Random(5)
    header = [f"licence{i}" for i in range(40)]
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [[*header, *(word() for _ in range(rng.randrange(30, 80)))] for _ in range(1500)]
    for i in range(400):
        # the last words differ, as many as the threshold allows
        own = (len(texts[i]) - 4) // 9
        texts.append([*texts[i][:-own], *(word() for _ in range(own))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, 1500 + i) for i in range(400)]
    assert all(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.83 for a, b in pairs)
    made = []

    def counted(df, written=J.written):
        out = written(df)
        if "parent" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "written", counted)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] in ((i, 0), (i - 1500 if i >= 1500 else i, 1)) for i in got)
    assert sum(got[b] == (a, 1) for a, b in pairs) >= 398 and all(got[i] == (i, 0) for i in range(400, 1500))
    # two steps a round
    assert 1 <= len(made) <= 4


def test_the_rest_of_a_path_is_followed_as_often_as_without_a_common_part(spark):
    header = [*range(1, 101)]
    texts = [(i, [7], [*header, *range(1000 * i, 1000 * i + 150)]) for i in range(1, 200)] + [(900, [7], [*header, 5_000_001, 5_000_002])]
    df = spark.createDataFrame(texts, "id long, at array<long>, shingles array<long>")
    common = df.select(F.lit(7).cast("long").alias("path"), "shingles").groupBy("path").applyInArrow(J._common, "path long, common binary")
    rows = df.crossJoin(common).select("id", F.array(F.struct("path", "common")).alias("at"), "shingles")
    out = rows.mapInArrow(J._rests(0.8, 2.0), "id long, parent long, size long, path long").collect()
    assert {r["id"] for r in out if r["path"] is None} == {900}
    # nothing common is followed, so no path is reached twice; each text expects 1.6 of the least shared rest of about 0.8 * 250 - 100 out of 150
    to = [r["path"] for r in out if r["path"] is not None]
    assert len(set(to)) == len(to) and 2.0 < len(to) / 199 < 3.2
    plain = df.select("id", F.array(F.struct(F.lit(7).cast("long").alias("path"), F.lit(None).cast("binary").alias("common"))).alias("at"), "shingles").mapInArrow(J._rests(0.8, 2.0), "id long, parent long, size long, path long").collect()
    assert all(r["path"] is not None for r in plain) and 1.5 < len(plain) / 200 < 2.5
