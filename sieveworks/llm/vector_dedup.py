"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components.

The signs of a vector's products with random hyperplanes make one key for each of several
tables; vectors of one label that share a key in some table are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.buckets import distinct_buckets, groups, link_rows, lists, placed
from sieveworks.llm.bytetext import list_array, mixed
from sieveworks.llm.components import connected_components, smallest_labels
from sieveworks.sources.storage import forget, written

#: Vectors of a block of a large bucket.
BLOCK_VECTORS = 1024


def tables_needed(threshold: float, bits: int, target_recall: float) -> int:
    """Tables after which two vectors at the threshold share a key with the target probability."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - target_recall) / math.log(1 - same))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _keys(bits: int, tables: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            for rows, vectors in _matrix(batch["vector"]):
                planes = np.random.default_rng([20240229, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
                signs = ((vectors @ planes) > 0).reshape(len(rows), tables, bits)
                keys[rows] = (signs * weights).sum(2) + np.uint64(vectors.shape[1]) * np.uint64(1 << bits)
            # label and table go into the key, which stays one number
            labels = batch["label"].to_numpy().astype(np.uint64)
            keys = mixed(mixed(keys + np.uint64(1)) ^ mixed(labels[:, None] * np.uint64(tables) + np.arange(tables, dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([batch["id"], list_array(keys.view(np.int64).ravel(), [tables] * batch.num_rows, pa.int64())], ["id", "paths"])

    return make


def _compare(threshold: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["path", "one", "two"]):
            table = table.combine_chunks()
            ids, rows = np.unique(table["id"].to_numpy(), return_index=True)
            labels = table["label"].to_numpy()[rows]
            vectors = lists(table, "vector", rows)
            sizes = np.array([len(v) for v in vectors])
            width = sizes.max()
            padded = np.zeros((len(ids), width))
            for row, v in zip(padded, vectors):
                row[: len(v)] = v
            # the largest component becomes 1 first, so that no square overflows or vanishes
            padded /= np.abs(padded).max(1)[:, None]
            norms = np.sqrt((padded * padded).sum(1))
            linked = padded @ padded.T / norms[:, None] / norms[None, :] >= threshold
            linked &= (labels[:, None] == labels[None, :]) & (sizes[:, None] == sizes[None, :])
            out = link_rows(linked, table, rows, ids, table["path"][0].as_py(), table["one"][0].as_py() != table["two"][0].as_py())
            if out is not None:
                yield out

    return make


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, bits: int = 16, target_recall: float = 0.99999) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of the same label are linked when their cosine, in double precision, is at
    least ``threshold``. n_links counts the other vectors linked to this one, component_id
    is the smallest id that links reach, kept says whether that is the own id.

    Equal vectors of a label stand together from the start as copies of one
    representative. Vectors that are null, empty, zero or hold a null or a non-finite
    number, and those without a label, link with nothing; vectors of different length
    don't either. Repeated rows are one vector: it counts once and doesn't link with
    itself. Rows with one id but other contents are vectors of their own that share the
    id. A vector without an id takes part like all others, but counts for no n_links and
    its id is none to be reached; its component_id is null where no other has one. Other
    columns aren't read; an empty table gives an empty one. No link below the threshold is
    reported; one at the threshold is found with probability ``target_recall`` or more.
    """
    tables = tables_needed(threshold, bits, target_recall)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("vector", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # of vectors that aren't usable, none has a print
    print_ = [F.when(usable, F.xxhash64(F.lit(i), "label", "vector")).alias(f"print{i}") for i in (1, 2)]
    rows = rows.select("*", *print_)
    one = rows.where("print1 is not null")
    # ids are counted once before the vectors' copies are
    ids = one.groupBy("print1", "print2", "vec_id").agg(F.first("vector").alias("vector"), F.first("label").alias("label"))
    same = ids.groupBy("print1", "print2").agg(F.min("vec_id").alias("low"), F.count("vec_id").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    # a number of its own for each representative: an id may have several
    reps = written(same.withColumn("id", F.monotonically_increasing_id()))

    members = reps.select("id", "vector", "label").mapInArrow(_keys(bits, tables), "id long, paths array<long>")
    members = written(members.select("id", F.lit(1).cast("long").alias("size"), F.explode("paths").alias("path")))
    found = members.select("id", "path").join(distinct_buckets(members), "path").select("id", "path", F.ceil(F.col("texts") / BLOCK_VECTORS).cast("int").alias("blocks"))
    links = written(placed(found, reps.select("id", "copies", "label", "vector")).mapInArrow(_compare(threshold), "id long, n_links long, root long"))
    forget(members)

    components = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    reached = smallest_labels(components, reps.select("id", F.col("low").alias("label"))).drop("component")
    totals = links.groupBy("id").agg(F.sum("n_links").alias("far"))
    known = reps.select("print1", "print2", "id", "low", "copies").join(totals, "id", "left").join(reached, "id", "left")
    known = known.select("print1", "print2", F.least("label", "low").alias("component"), (F.coalesce("far", F.lit(0)) + F.col("copies")).alias("all"))
    # rows without a print go past the join
    out = rows.select("vec_id", "print1", "print2").where("print1 is not null").join(known, ["print1", "print2"])
    out = out.select("vec_id", (F.col("all") - F.col("vec_id").isNotNull().cast("long")).alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(rows.where("print1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))
