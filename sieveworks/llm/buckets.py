"""Buckets of a similarity join: which to compare, how to place their members, and what a comparison needs.

A bucket is a ``path`` that several members reached. Its members are compared in one
task, or in blocks when there are many; pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_buckets(members: DataFrame, most_texts: int | None = None) -> DataFrame:
    """(path, texts, weight) of the paths that at least two members (id, size, path) reached; of paths with the same members, the smallest.

    Paths of more than ``most_texts`` members all stay, also those with the same members.
    """
    most = members.groupBy("path").agg(F.count("*").alias("texts"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("id")).alias("mark1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mark2"))
    same = ["texts", "weight", "mark1", "mark2"]
    if most_texts is not None:
        most = most.withColumn("own", F.when(F.col("texts") > most_texts, F.col("path")))
        same = [*same, "own"]
    return most.where("texts > 1").groupBy(*same).agg(F.min("path").alias("path")).select("path", "texts", "weight")


def placed(found: DataFrame, members: DataFrame) -> DataFrame:
    """A row of ``members`` (id, ...) for every block pair of the buckets (path, id, blocks) that it is in, sorted by them.

    Adds ``leaves``, all paths of the member, ``block``, its own block, and the pair
    ``one`` <= ``two``. A bucket of b blocks sends each member to b of its block pairs.
    Members may have their buckets in a column ``at`` (path, blocks); those without them there get them from ``found``.
    """
    per_member = found.groupBy("id").agg(F.collect_list(F.struct("path", "blocks")).alias("at"))
    columns = [F.col(c) for c in members.columns if c != "at"]
    if "at" in members.columns:
        out = members.where("at is not null").unionByName(members.where("at is null").drop("at").join(per_member, "id"))
    else:
        out = members.join(per_member, "id")
    out = out.select(*columns, F.col("at.path").alias("leaves"), F.explode("at").alias("at"))
    block = F.pmod(F.xxhash64("id"), F.col("at.blocks")).cast("int")
    out = out.select(*columns, "leaves", F.col("at.path").alias("path"), F.col("at.blocks").alias("blocks"), block.alias("block"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    out = out.select(*columns, "leaves", "path", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return out.repartition("path", "one", "two").sortWithinPartitions("path", "one", "two")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if rest and (key[0] != np.array([rest[-1][k][-1].as_py() for k in keys])).any():
            yield pa.Table.from_batches(rest)
            rest = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def shared(members: int, values: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each two members have in common, by products of 0/1 matrices over ``width`` values at a time."""
    lengths = [len(v) for v in values]
    flat, owner = np.concatenate(values), np.repeat(np.arange(members), lengths)
    kinds, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    rank = np.cumsum(count > 1) - 1
    code, owner = rank[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((members, members), np.float32)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(code, (low, low + width))
        if b > a:
            has = np.zeros((members, min(width, int(rank[-1]) + 1 - low)), np.float32)
            has[owner[a:b], code[a:b] - low] = 1
            out += has @ has.T
    return out


def strips(members: int, height: int = 256) -> list[slice]:
    """Rows of a matrix of all members, some at a time, so that what is made of them stays small."""
    return [slice(a, a + height) for a in range(0, members, height)]


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each member the first member of its component in a symmetric link matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.concatenate([np.where(linked[s], root[None, :], len(linked)).min(1) for s in strips(len(linked))])
        after = np.minimum(root, near)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def lists(table: pa.Table, column: str, rows: np.ndarray) -> list[np.ndarray]:
    """The lists of some rows as arrays."""
    values = table[column].combine_chunks() if isinstance(table[column], pa.ChunkedArray) else table[column]
    return [values[i].values.to_numpy(zero_copy_only=False) for i in rows.tolist()]


def link_rows(linked: np.ndarray, table: pa.Table, rows: np.ndarray, ids: np.ndarray, path: int, cross: bool) -> pa.RecordBatch | None:
    """(id, n_links, root) of the members that have links in a block pair.

    n_links counts copies; root is the smallest id of the member's component here. A pair
    that also shares a bucket of a smaller path is left to that one, and across two blocks
    only pairs of one member of each count.
    """
    np.fill_diagonal(linked, False)
    if cross:
        side = table["block"].to_numpy()[rows]
        linked &= side[:, None] != side[None, :]
    if linked.any():
        met = shared(len(ids), [x[x < path] for x in lists(table, "leaves", rows)])
        linked &= met == 0
        del met
    has = np.flatnonzero(linked.any(1))
    if not len(has):
        return None
    copies = table["copies"].to_numpy()[rows].astype(np.float64)
    n_links = np.concatenate([linked[has[s]] @ copies for s in strips(len(has))])
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n_links.astype(np.int64)), pa.array(ids[local_roots(linked)[has]])], ["id", "n_links", "root"])
