"""URL filters: host and path rules, and boosted trees over lexical features for the rest.

Only DataFrame functions and Spark's own tree learner are used; no Python runs on the
executors. The trees learn from the URLs that a rule judges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.sources.storage import written

# The rules of the contract, as verdict, host and path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Labelled URLs that the trees learn from: those with the smallest hashes.
SAMPLE_URLS = 20_000
TREES, DEPTH = 20, 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fits(rule: tuple[str, str, str]) -> Column:
    of_host = (F.col("host") == rule[1]) | F.col("host").endswith(f".{rule[1]}")
    return of_host & F.col("path").startswith(rule[2])


def _entropy(text: Column) -> Column:
    """Bits a character of the text's own character distribution."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(F.transform(F.filter(kinds, lambda c: c != ""), share), F.lit(0.0), lambda sum_, p: sum_ - p * F.log2(p))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """``urls`` (url, host, path) with numbers about the URL's form, and their names; a null URL counts as an empty one."""
    url, size = F.coalesce("url", F.lit("")), F.greatest(F.length("url"), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    features = {
        "url_chars": F.length(url).cast("double"),
        "host_chars": F.length("host").cast("double"),
        "path_chars": F.length("path").cast("double"),
        "path_depth": _count(F.col("path"), "/"),
        "host_labels": _count(F.col("host"), r"\."),
        "digit_share": _count(url, "[0-9]") / F.coalesce(size, F.lit(1.0)),
        "path_digits": _count(F.col("path"), "[0-9]"),
        "hyphens": _count(F.col("host"), "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0.0),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "path_suffix_chars": F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
    }
    out = urls.withColumns(features | {"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "section": F.regexp_extract("path", "^/([^/]*)/", 1)})
    return out, [*features]


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE_URLS, limit: float = 0.5, learn_from: Column | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains where the path starts with the rule's path; of
    those that fit the longest decides, and verdict is its own. Elsewhere (rule null) the
    verdict is block when score, the trees' probability of block, is at least ``limit``.

    Suffix statistics are the share of blocked URLs among all labelled rows with the same
    host suffix and with the same first path section, smoothed. Only the trees learn from a
    sample: the ``sample`` distinct labelled URLs with the smallest hashes. ``learn_from``,
    a condition on url, keeps some of the labelled rows out of both, to measure what was
    learned.

    Null URLs and those without ``://`` have an empty host and path and are judged like
    all others. Without sampled URLs of both kinds nothing can be learned: score is 0 and
    everything without a rule is allowed. Repeated rows give repeated results; other
    columns aren't read; an empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, judged = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        # the longest is looked at first
        rule, judged = F.when(_fits(r), r[1] + r[2]).otherwise(rule), F.when(_fits(r), r[0]).otherwise(judged)
    rows = rows.withColumns({"rule": rule, "judged": judged})

    labelled = rows.where("judged is not null").select("url", "host", "path", (F.col("judged") == "block").cast("double").alias("label"))
    if learn_from is not None:
        labelled = labelled.where(learn_from)
    chosen = written(with_features(labelled.distinct().orderBy(F.xxhash64("url"), "url").limit(sample))[0])
    labelled, rows, names = with_features(labelled)[0], *with_features(rows)
    kinds = chosen.agg(F.countDistinct("label")).first()[0]
    if kinds < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("judged", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))

    # written, so that Spark knows their size and broadcasts only small ones
    shares = {key: written(labelled.groupBy(key).agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias(f"{key}_share"))) for key in ("suffix", "section")}

    def with_shares(df: DataFrame) -> DataFrame:
        for key, share in shares.items():
            df = df.join(share, key, "left").fillna(0.5, [f"{key}_share"])
        return df

    inputs = [*names, "suffix_share", "section_share"]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
    trees = learner.fit(assembler.transform(with_shares(chosen)).select("features", "label"))
    scored = trees.transform(assembler.transform(with_shares(rows)))
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("judged", F.when(score >= limit, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
