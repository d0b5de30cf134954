"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sieveworks.llm import chat_format, decontamination, fill_middle, html_text, language_id, pieces, secret_scan, token_align
from sieveworks.llm.hmm_score import score_texts
from sieveworks.llm.jaccard_join import ngram_jaccard_join
from sieveworks.llm.license_scan import license_scan
from sieveworks.sources.storage import written
from sieveworks.llm.url_filter import url_filter
from sieveworks.llm.vector_dedup import vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return vector_dedup(_table(spark, sf_dir, "embeddings"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter(_table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of every conversation, from a raw transcript with markers of several kinds or none; learned from conversations that aren't held out."""
    held_out = language_id.held_out("conv_id").alias("held_out")
    raw = written(chat_format.transcripts(_table(spark, sf_dir, "conversations"), marker=chat_format.varied_marker))
    model = chat_format.train(raw.where(~held_out))
    return chat_format.format_turns(raw, model).select("conv_id", held_out, "turn", "role", "rendered", "n_lines", "n_right")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    profiles = language_id.learn(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; a tenth of them is held out of training."""
    return score_texts(_table(spark, sf_dir, "documents"), language_id.held_out(parts=10, part=0))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that stand in each document."""
    return decontamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to it."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of every document under two tokenizers, with the counts of its links in all documents."""
    rows = token_align.align_tokens(_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return rows.withColumn("groups_sha256", digest).drop("groups")


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials in every document, with a digest of those that are secrets by themselves."""
    rows = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "n_linked", F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document is cut and in what order its parts stand, with digests of the output and of the text rebuilt from it."""
    rows = fill_middle.fill_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_secret_scans": op12_secret_scans,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

#: Queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op12_secret_scans": secret_scan.ORACLE_SQL,
    "op13_fill_in_middle": """
        with drawn as (
          select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units from documents
        ), cut as (
          select doc_id, t, units, len(units) as n, ('0x' || h[1:8])::ubigint % (len(units) + 1) as one, ('0x' || h[9:16])::ubigint % (len(units) + 1) as two,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::ubigint % 100 >= 90 then 'plain'
                 when ('0x' || h[25:32])::ubigint % 100 < 20 then 'spm' else 'psm' end as form
          from drawn
        ), parts as (
          select doc_id, t, n, form, array_to_string(units[1:least(one, two)], '') as p, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') as m, array_to_string(units[greatest(one, two) + 1:], '') as s from cut
        )
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
          sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
        from parts""",
}
