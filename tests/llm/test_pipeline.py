"""The pipeline's stages, and nothing lost on the way that shouldn't be."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from sieveworks.llm import registry


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    item = " ".join(word() for _ in range(25))
    clean = [" ".join(word() for _ in range(60)) for _ in range(10)]
    near = clean[0].split()
    near[30] = "zzzz"
    texts = [*clean, clean[1], " ".join(near), "intro " + item + " outro", None, "123 456"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, id int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append(sorted(r["doc_id"] for r in now.collect()))
        if i < 3:
            assert now.columns == docs.columns
    assert kept == [list(range(13)), [*range(10), 12], list(range(10)), list(range(10))]
    assert now.where("not same").count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(10))


def test_group_stage_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    a, b, c, d, e = ([word() for _ in range(60)] for _ in range(5))
    near = lambda x: " ".join([*x[:30], "zzzz", *x[31:]])
    a, b, c, d, e, a2, d2, e2 = *map(" ".join, (a, b, c, d, e)), near(a), near(d), near(e)
    rows = [(None, a), (7, b), (7, c), (None, d), (3, d2), (None, e), (None, e2), (None, None), (None, None), (7, b), (9, ""), (9, "!!"), (1, a2), (1, a2)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    kept = sorted((tuple(r)[:2] for r in got.collect()), key=repr)
    # of the two texts without an id either may stay
    assert [x for x in kept if x[1] not in (e, e2)] == sorted([(7, b), (7, c), (3, d2), (None, None), (9, ""), (9, "!!"), (1, a2)], key=repr)
    assert sum(x in ((None, e), (None, e2)) for x in kept) == 1
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_language_stage_rejects_what_is_in_no_language(spark):
    rng = random.Random(4)
    syllables = {"xx": "ka to mi ru se na li po".split(), "yy": "éch oul ien aux tré pon".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    good = [(i, lang := rng.choice(["xx", "yy"]), text(lang, rng.choice([1, 3, 30, 300]))) for i in range(300)]
    odd = [(1000, None, "bdfg hjkl " * 30), (1001, None, "bdfg hjkl wxyz " * 30), (1002, "yy", "日本語 " * 50), (1003, "xx", None), (1004, "xx", "12 3")]
    docs = spark.createDataFrame(good + odd, "doc_id long, lang string, text string")
    got = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert got == {i for i, _, _ in good}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.known_language(spark, nothing, "").count() == 0 == corpus_pipeline.known_language(spark, docs.limit(0), "").count()


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in registry.QUERIES
