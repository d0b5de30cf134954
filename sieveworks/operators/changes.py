"""Ordered change logs, path propagation, counter merges, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.sources.storage import forget, written


def _next_after(points: DataFrame, marks: DataFrame) -> DataFrame:
    """(seq, next): for points (key, at, seq) the smallest ``mark`` above ``at`` among marks (key, mark) of the same key; points without one are left out. One sort for each key, no pairs."""
    rows = points.select("key", "at", F.lit(0).alias("kind"), "seq").unionByName(marks.select("key", F.col("mark").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq")))
    # from above; at equal places the point comes first, so that only larger marks lie before it
    order = W.partitionBy("key").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(order)
    return rows.withColumn("next", last).where("kind = 0 and next is not null").select("seq", "next")


def _followed(records: DataFrame, step: DataFrame) -> DataFrame:
    """(seq, end): where the pointers ``step`` (seq, next) lead from each record. Every round doubles the steps taken and is written, so that a chain of n takes log2(n) joins. Records without a pointer end where they are and take no part."""
    ends = written(step.select("seq", F.col("next").alias("end")))
    while True:
        jump = ends.select(F.col("seq").alias("end"), F.col("end").alias("further"))
        after = written(ends.join(jump, "end", "left").select("seq", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")))
        forget(ends)
        ends = after.select("seq", "end")
        ends._written_path = after._written_path
        if after.where("moved").isEmpty():
            return records.select("seq").join(ends, "seq", "left").select("seq", F.coalesce("end", "seq").alias("end"))


def compact(log: DataFrame, begun: DataFrame | None = None) -> DataFrame:
    """(old, new): where each path of an ordered log (seq, old, new) ends; new is null for a removed one.

    A path's first record after its own last removal counts, and from there each record's
    target is followed to the target's next later record. Once that chain ends in a removal, the path's next record
    after it counts in turn. Records that move a path to itself say nothing.

    ``begun`` (old, new) tells where paths already were before the log, whose seq then is
    0 at least: they go on from there, but nothing that the log moves meets them.
    """
    records = log.select("seq", "old", "new").where("new is null or old <> new")
    if begun is not None:
        # numbers below the log's own; written at once, so they stay what they are
        records = records.unionByName(begun.where("new is not null").select((-1 - F.monotonically_increasing_id()).alias("seq"), "old", "new"))
    records = written(records)
    starts = records.where("seq >= 0").select(F.col("old").alias("key"), F.col("seq").alias("mark")) if begun is not None else records.select(F.col("old").alias("key"), F.col("seq").alias("mark"))
    step = _next_after(records.where("new is not null").select(F.col("new").alias("key"), F.col("seq").alias("at"), "seq"), starts)
    target = records.select(F.col("seq").alias("end"), F.col("new").alias("target"))
    chains = written(_followed(records, step).join(target, "end").join(records.select("seq", "old"), "seq"))
    again = _next_after(chains.where("target is null").select(F.col("old").alias("key"), F.col("end").alias("at"), "seq"), starts)
    last = _followed(records, again)
    # a path's own removal ends whatever was before it
    removed = records.where("new is null").groupBy("old").agg(F.max("seq").alias("removed"))
    counting = records.join(removed, "old", "left").groupBy("old").agg(F.min(F.when(F.col("removed").isNull() | (F.col("seq") > F.col("removed")), F.col("seq"))).alias("seq"))
    final = chains.select(F.col("seq").alias("end"), F.col("target").alias("new"))
    return counting.join(last.join(final, "end"), "seq", "left").select("old", "new")


def compact_further(known: DataFrame, log: DataFrame) -> DataFrame:
    """A compacted log (old, new) with later records (seq from 0 on, old, new) compacted into it, as if the whole log had been.

    Only paths that the new records move, or at which a path stands that they move, are
    followed; all others stay as they are.
    """
    log = written(log.select("seq", "old", "new").where("new is null or old <> new"))
    moved = log.select(F.col("old").alias("_moved")).distinct()
    standing = known.join(moved, F.col("new") == F.col("_moved"), "left_semi").unionByName(known.join(moved, F.col("old") == F.col("_moved"), "left_semi")).distinct()
    now = written(compact(log, standing))
    forget(log)
    return known.join(now.select("old"), "old", "left_anti").unionByName(now)


def remap(df: DataFrame, path: str, changes: DataFrame, unique: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
    """``df`` with the paths of a compacted log replaced and removed ones dropped; with ``unique``, of rows that now are equal in these columns the one with the smallest ``position`` stays."""
    table = changes.select(F.col("old").alias(path), F.col("new").alias("_new"), F.lit(True).alias("_changed"))
    out = df.join(table, path, "left").where("_changed is null or _new is not null")
    out = out.withColumn(path, F.coalesce("_new", path)).drop("_new", "_changed")
    if unique:
        kept = out.groupBy(*unique).agg(F.min(position).alias(position))
        out = out.join(kept, [*unique, position], "left_semi").dropDuplicates([*unique])
    return out


def upsert(old: DataFrame, new: DataFrame, on: Sequence[str], merged: dict[str, str]) -> DataFrame:
    """Both tables as one with a row for each key; ``merged`` says how a column folds: sum, max, min."""
    both = old.select(*on, *merged).unionByName(new.select(*on, *merged))
    return both.groupBy(*on).agg(*(getattr(F, how)(c).alias(c) for c, how in merged.items()))


def fold_into(annotations: DataFrame, changes: DataFrame, item: str, on: Sequence[str], merged: dict[str, str]) -> DataFrame:
    """Annotations of moved items added to those of where they went; of removed ones dropped.

    ``merged`` says how a column folds: sum, max, min, or own: that of the item itself, and
    only where it has none the largest of what moved to it.
    """
    own = [c for c, how in merged.items() if how == "own"]
    moved = changes.select(F.col("old").alias(item), F.lit(True).alias("_moved")).distinct()
    rows = annotations.join(moved, item, "left").withColumns({f"_own_{c}": F.when(F.col("_moved").isNull(), F.col(c)) for c in own}) if own else annotations
    folds = {c: "max" if how == "own" else how for c, how in merged.items()} | {f"_own_{c}": "max" for c in own}
    rows = remap(rows, item, changes)
    out = upsert(rows, rows.limit(0), [*on, item], folds)
    return out.withColumns({c: F.coalesce(f"_own_{c}", c) for c in own}).drop(*(f"_own_{c}" for c in own)) if own else out


def snapshot_diff(old: DataFrame, new: DataFrame, row: str, tag: str, value: str) -> DataFrame:
    """(change, tag, n): tags added (+), removed (-) or changed (~) between two snapshots in long form (row, tag, value)."""
    a, b = old.select(row, tag, F.col(value).alias("_a")), new.select(row, tag, F.col(value).alias("_b"))
    both = a.join(b, [row, tag], "full_outer")
    change = F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), "+").when(F.col("_b").isNull() & F.col("_a").isNotNull(), "-").when(F.col("_a") != F.col("_b"), "~")
    return both.withColumn("change", change).where("change is not null").groupBy("change", tag).agg(F.count("*").alias("n"))


def restore_plan(saved: DataFrame, now: DataFrame, row: str, tag: str, values: str) -> DataFrame:
    """The tags to write back so that ``now`` has the saved values, compared as multisets; ``old`` and ``new`` are the values before and after."""
    a = saved.select(row, tag, F.array_sort(values).alias("new"))
    b = now.select(row, tag, F.array_sort(values).alias("old"))
    return a.join(b, [row, tag], "left").where(~F.col("old").eqNullSafe(F.col("new")))


def put_back(entries: DataFrame, gone: DataFrame, playlist: str, position: str, path: str, reach: int = 10) -> DataFrame:
    """Where a returned path goes in its playlist: after its nearest surviving predecessor within ``reach``, else before its nearest survivor behind, else at the end (null)."""
    lost = gone.select(playlist, F.col(position).alias("_at"), F.col(path).alias("_path"))
    # an entry meets a lost one through its band of positions, so a long playlist is no single key
    banded = lost.withColumn("_low", F.floor(F.col("_at") / reach)).withColumn("_band", F.explode(F.sequence(F.col("_low") - 1, F.col("_low") + 1)))
    near = banded.join(entries.select(playlist, position, F.floor(F.col(position) / reach).alias("_band")), [playlist, "_band"]).where(F.abs(F.col(position) - F.col("_at")) <= reach)
    before = F.max(F.when(F.col(position) < F.col("_at"), F.col(position))).alias("after")
    behind = F.min(F.when(F.col(position) > F.col("_at"), F.col(position))).alias("ahead_of")
    found = near.groupBy(playlist, "_path", "_at").agg(before, behind)
    out = lost.join(found, [playlist, "_path", "_at"], "left")
    return out.select(playlist, F.col("_path").alias(path), "after", F.when(F.col("after").isNull(), F.col("ahead_of")).alias("ahead_of"))


def missing_rows(rows: DataFrame, id_col: str, removed: DataFrame, awaited: DataFrame, moved: DataFrame) -> DataFrame:
    """Why each missing row is missing: removed, awaited, moved or unexplained, the first that holds."""
    out = rows
    for name, table in (("removed", removed), ("awaited", awaited), ("moved", moved)):
        out = out.join(table.select(id_col).distinct().withColumn(f"_{name}", F.lit(True)), id_col, "left")
    reason = F.when(F.col("_removed"), "removed").when(F.col("_awaited"), "awaited").when(F.col("_moved"), "moved").otherwise("unexplained")
    return out.withColumn("reason", reason).drop("_removed", "_awaited", "_moved")


def purge_plan(missing: DataFrame, disk: int, database: int) -> DataFrame:
    """The rows of :func:`missing_rows` to purge: those removed on purpose. None while any is unexplained, or moved to where nothing was found, nor when :func:`sane` says no; rows that are awaited stay."""
    if not sane(disk, database) or not missing.where("reason in ('unexplained', 'moved')").isEmpty():
        return missing.limit(0)
    return missing.where("reason = 'removed'")


def remap_all(tables: Mapping[str, tuple[DataFrame, str, Sequence[str] | None, str | None]], changes: DataFrame) -> dict[str, DataFrame]:
    """:func:`remap` of every table that holds paths: name -> (table, path column, unique columns, position column)."""
    return {name: remap(df, path, changes, unique, position) for name, (df, path, unique, position) in tables.items()}


def sane(disk: int, database: int, least: int = 20, share: float = 0.5) -> bool:
    """Whether a merge may run: not when the disk is empty or has under half of a database of 20 rows or more."""
    return disk > 0 and not (database >= least and disk < share * database)


def new_loads(load: DataFrame, manifest: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a load that no earlier one had, by each of the keys on its own."""
    for key in on:
        load = load.join(manifest.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return load


def retry_due(lookups: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Lookups to make again: unknown ones, and those that found nothing ``days`` ago or longer. Unknown is not absent."""
    return lookups.where((F.col("status") == "unknown") | ((F.col("status") == "absent") & (F.datediff(today, F.col("looked_up")) >= days)))


def reverted(plan: DataFrame) -> DataFrame:
    """A plan that undoes a plan with ``old`` and ``new`` columns."""
    return plan.withColumnsRenamed({"old": "_old", "new": "old"}).withColumnRenamed("_old", "new").select(*plan.columns)
