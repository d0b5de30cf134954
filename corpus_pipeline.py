"""A corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import decontamination, language_id, pieces
from sieveworks.llm.jaccard_join import near_classes
from sieveworks.sources.storage import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts stay that are in one of the languages of the table.

    Null texts and those without letters go, and those whose best cosine lies six
    deviations under what texts of their length have with their own language: other
    languages, noise, a few words repeated over and over. Rows stay as they are.
    """
    found = language_id.identify(docs, language_id.learn(docs), lang_pred_col="__lang", score_col="__cosine")
    least = language_id.usual_scores(found, lang_pred_col="__lang", score_col="__cosine")
    return found.where((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__cosine") >= least)).select(*_columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near-duplicates one document stays, that with the smallest id.

    A document without an id stays if its class has none with one. Of different texts of a
    class that share the smallest id, or have none, the one with the smallest hash stays.
    Rows with one id but unlike texts all stay; rows that repeat in id and text are one.
    """
    rows = near_classes(docs)
    first = rows.where("near is not null and doc_id <=> class_id").groupBy("near", "doc_id").agg(F.min("mark").alias("mark")).select("doc_id", "mark")
    alone = rows.where("near is null").select("doc_id", "mark").distinct()
    key = lambda mark: {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__mark": mark}
    kept = first.unionByName(alone).withColumns(key(F.col("mark"))).select("__none", "__id", "__mark")
    keyed = docs.withColumns(key(F.xxhash64("text")))
    return keyed.join(kept, ["__none", "__id", "__mark"], "left_semi").dropDuplicates(["__none", "__id", "__mark"]).select(*_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents in which an item stands, up to its edit budget, go."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: ids of every document, and whether they decode to its text."""
    return pieces.round_trip(docs)


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", tokens),
]

#: Profiles, a randomised join and a piece search: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
