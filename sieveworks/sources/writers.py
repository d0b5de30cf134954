"""Plans, reports, lists and playlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Settings whose values are never written.
SECRET = "(?i)pass(word)?|token|secret|api_?key|cookie"


def write_plan(plan: DataFrame, path: str, section: str | None = None) -> None:
    """A plan as Parquet, by section where there is one; the output committer makes it whole or absent."""
    writer = plan.write.mode("overwrite")
    (writer.partitionBy(section) if section else writer).parquet(path)


def write_tsv(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def report_rows(violations: DataFrame, most: int = 40) -> DataFrame:
    """(section, severity, total, key, detail): the first ``most`` rows of each section by key, and its total. The cap is the report's."""
    totals = violations.groupBy("section", "severity").agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy("section").orderBy("key", "detail"))
    top = violations.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    return top.join(totals, ["section", "severity"])


def markdown(violations: DataFrame, most: int = 40) -> str:
    """The report as Markdown; what reaches the driver is bounded by ``most`` rows a section."""
    lines: list[str] = []
    last = None
    for r in report_rows(violations, most).orderBy("severity", "section", "key", "detail").toLocalIterator():
        if r["section"] != last:
            last = r["section"]
            lines += ["", f"## {r['section']} ({r['severity']}, {r['total']})", ""]
        lines.append(f"- {r['key']}" + (f": {r['detail']}" if r["detail"] else ""))
    return "\n".join(lines).strip() + "\n"


def write_links(links: DataFrame, path: str, link: str, order: Sequence[Column]) -> None:
    """A list of links in order of priority, one a line; of repeated links the first."""
    first = links.withColumn("_n", F.row_number().over(W.partitionBy(link).orderBy(*order))).where("_n = 1")
    first.orderBy(*order, link).select(F.col(link).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_unique(work: DataFrame, new: DataFrame, on: Sequence[str], replaces: Column | None = None) -> DataFrame:
    """A work list with the new rows whose key it lacks; rows for which ``replaces`` holds take the place of what stands there."""
    strong = new.where(replaces) if replaces is not None else new.limit(0)
    weak = new.where(~replaces) if replaces is not None else new
    kept = work.join(strong.select(*on), [*on], "left_anti").unionByName(strong.dropDuplicates([*on]))
    return kept.unionByName(weak.dropDuplicates([*on]).join(kept.select(*on), [*on], "left_anti"))


def playlists(entries: DataFrame, playlist: str = "playlist", position: str = "pos", path: str = "path") -> DataFrame:
    """(playlist, body): every playlist's paths in order, repeated ones once, where they first stood."""
    first = entries.groupBy(playlist, path).agg(F.min(position).alias(position))
    rows = first.groupBy(playlist).agg(F.array_sort(F.collect_list(F.struct(position, path))).alias("rows"))
    return rows.select(playlist, F.array_join(F.transform("rows", lambda r: r[path]), "\n").alias("body"))


def redacted(settings: DataFrame, key: str, value: str) -> DataFrame:
    """Settings with secret values hidden."""
    return settings.withColumn(value, F.when(F.col(key).rlike(SECRET), "***").otherwise(F.col(value)))
