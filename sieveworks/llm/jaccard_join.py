"""Near-duplicate texts: a Jaccard self-join on word shingles by chosen paths.

Every run starts from one path. A path splits the texts that reached it: each text
follows the shingles whose hash, seeded by the path, falls below ``branching / size``,
so that two texts with most shingles in common follow a common one with high
probability. A path that few texts reach is a bucket and is compared by brute force; a
path that many reach splits again. How much the texts of a path share is estimated by how
many have the same smallest shingle under other seeds, counted by bins of their hashes. Where they
share much, such as a header or nearly all, some of the paths that they split into would hold nearly all of them
again, so such a path splits by the rest of its texts alone: shingles that most of a few of its
texts hold are not followed by any, and the others by so much more that two texts over the
threshold follow a common one as often as before. Texts that have nearly nothing else are
a bucket at once, and are compared in blocks; they split too, to meet those that have more.
As many runs are made as the target recall needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.buckets import distinct_buckets, groups, link_rows, lists, placed, shared, strips
from sieveworks.llm.bytetext import byte_slices, list_array, mixed, shingle_sets, word_hashes
from sieveworks.llm.components import connected_components, smallest_labels
from sieveworks.sources.storage import forget, written

#: Texts in a bucket that is compared at once, and the shingles and texts of a block of a larger one.
BUCKET_TEXTS, BLOCK_SHINGLES, BLOCK_TEXTS = 256, 400_000, 2048
#: Paths stop splitting at this depth; what is still large then is compared in blocks.
MOST_DEPTH = 12
#: Other seeds by which a large path is judged, and the share from which it splits by the rest of its texts.
PROBES, MUCH = 16, 0.25
#: About as many texts of a path tell which shingles are common there; most bits of the map of them.
TELLING, _MAP_BITS = 32, 15
#: Smallest shingles are counted by bins; the paths that a task counts before it gives their counts away.
_BINS, _COUNTED = 64, 2000


def runs_needed(target_recall: float, threshold: float, branching: float) -> int:
    """Runs after which a pair at the threshold shares a bucket with the target probability.

    A shared path goes on with probability 1 - exp(-m p), with m the expected number of
    shared shingles followed and p the chance that one of them goes on in turn; the
    limit of p over any depth holds for the deepest bucket.
    """
    p = 1.0
    for _ in range(MOST_DEPTH):
        p = 1 - math.exp(-branching * threshold * p)
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - p)))


def _below(size: np.ndarray, branching: float) -> np.ndarray:
    """The hash value below which a shingle is followed."""
    return np.minimum(branching / np.maximum(size, 1e-3) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def _chosen(shingles: np.ndarray, below: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the shingles that are followed, and the paths that they lead to."""
    h = mixed(shingles ^ path)
    at = np.flatnonzero(h < below)
    return at, mixed(h[at] + np.uint64(0x9E3779B97F4A7C15))


def _prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of the words of each text, in order."""
    return np.array([np.frombuffer(hashlib.blake2b(hashes[x:y].tobytes(), digest_size=16).digest(), np.int64) for x, y in zip(first[:-1], first[1:])]).reshape(-1, 2)


def _sketches(n: int, seeds: np.ndarray, branching: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch["text"]):
                hashes, first = word_hashes(data, offsets)
                sets = shingle_sets(hashes, first, n)
                sizes = np.array([len(x) for x in sets], np.int64)
                shingles, row = np.concatenate(sets), np.repeat(np.arange(b - a), sizes)
                below = _below(sizes, branching)[row]
                rows, paths = zip(*((row[at], path) for at, path in (_chosen(shingles, below, seed) for seed in seeds)))
                rows, paths = np.concatenate(rows), np.concatenate(paths)
                order = np.argsort(rows, kind="stable")
                prints, empty = _prints(hashes, first), sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in ("doc_id", "mark")), pa.array(prints[:, 0], mask=empty), pa.array(prints[:, 1], mask=empty), pa.array(sizes), list_array(paths[order].view(np.int64), np.bincount(rows, minlength=b - a), pa.int64())],
                    ["doc_id", "mark", "print1", "print2", "size", "paths"],
                )

    return make


def _sets(n: int):
    """Rows (id, copies, at, paths, told, print1, print2, text) to the shingles of those whose text has the prints: of rows that share an id, some may hold another text. Repeated rows of a task give one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch["id"].to_pylist()
            wanted = np.stack([batch["print1"].to_numpy(), batch["print2"].to_numpy()], 1)
            for a, b, data, offsets in byte_slices(batch["text"]):
                hashes, first = word_hashes(data, offsets)
                right = (_prints(hashes, first) == wanted[a:b]).all(1)
                rows = [i for i in range(b - a) if right[i] and ids[a + i] not in seen and not seen.add(ids[a + i])]
                if rows:
                    sets = shingle_sets(hashes, first, n)
                    sets = [sets[i] for i in rows]
                    at = pa.array([a + i for i in rows])
                    kept = ["id", "copies", "at", "paths", "told"]
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in kept), list_array(np.concatenate(sets).view(np.int64), [len(x) for x in sets], pa.int64())], [*kept, "shingles"])

    return make


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their prints."""
    for batch in batches:
        for a, b, data, offsets in byte_slices(batch["text"]):
            prints = _prints(*word_hashes(data, offsets))
            yield pa.RecordBatch.from_arrays([batch["text"].slice(a, b - a), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["text", "print1", "print2"])


def _children(branching: float):
    """Rows (id, paths, shingles) to the paths that each path splits into: (id, parent, size, path); and for the task's members of each path how many have their smallest shingle under each probe in each bin: (parent, bins)."""
    probes = mixed(np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    names, kind = ["id", "parent", "size", "path"], pa.list_(pa.int32())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            n, none = len(counts), pa.nulls(len(counts), pa.int64())
            bins = list_array(np.concatenate([*counts.values(), np.zeros(0, np.int32)]), [PROBES * _BINS] * n, pa.int32())
            out = pa.RecordBatch.from_arrays([none, pa.array([*counts], pa.int64()), none, none, bins], [*names, "bins"])
            counts.clear()
            return out

        for batch in batches:
            out = [[], [], [], []]
            for id_, paths, shingles in zip(batch["id"].to_pylist(), batch["paths"], batch["shingles"]):
                shingles = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                below = _below(np.array([len(shingles)]), branching)[0]
                # a text has the same smallest shingles on all its paths
                smallest = [i * _BINS + int(mixed(shingles ^ p).min()) // 7 % _BINS for i, p in enumerate(probes)]
                for path in paths.values.to_numpy(zero_copy_only=False):
                    _, to = _chosen(shingles, below, path.view(np.uint64))
                    for x, value in zip(out, (id_, path, len(shingles))):
                        x.append(np.full(len(to), value, np.int64))
                    out[3].append(to.view(np.int64))
                    if int(path) not in counts:
                        counts[int(path)] = np.zeros(PROBES * _BINS, np.int32)
                    counts[int(path)][smallest] += 1
            columns = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), kind)], [*names, "bins"])
            if len(counts) > _COUNTED:
                yield told()
        yield told()

    return make


def _shares(table: pa.Table) -> pa.Table:
    """The counts of one path, of all tasks, to the mean of its fullest bins."""
    bins = table["bins"].combine_chunks().flatten().to_numpy().reshape(-1, PROBES, _BINS).sum(0, dtype=np.int64)
    return pa.table([table["parent"][:1], pa.array([float(bins.max(1).mean())])], ["path", "mean"])


def _common(table: pa.Table) -> pa.Table:
    """The shingles that over half of some texts of one path hold, as a map of bits; others may stand for a common one by chance, the same for all texts of the path."""
    sets = lists(table, "shingles", np.arange(table.num_rows))
    shingles, count = np.unique(np.concatenate(sets), return_counts=True)
    shingles = shingles[2 * count > len(sets)].view(np.uint64)
    bits = min(_MAP_BITS, max(6, (16 * len(shingles)).bit_length()))
    held = np.zeros(1 << bits, bool)
    held[mixed(shingles) >> np.uint64(64 - bits)] = True
    return pa.table([table["path"][:1], pa.array([np.packbits(held).tobytes()])], ["path", "common"])


def _is_common(hashes: np.ndarray, common: bytes) -> np.ndarray:
    """Which shingles, given by their hashes, a map of bits holds; an empty map holds none."""
    held = np.unpackbits(np.frombuffer(common or bytes(8), np.uint8)).view(bool)
    return held[hashes >> np.uint64(65 - len(held).bit_length())]


def _rests(threshold: float, branching: float):
    """Rows (id, at, shingles), ``at`` of paths and the maps of what is common there, to the paths that each path splits into by other shingles: (id, parent, size, path); path is null for a text that may have links by what is common alone.

    Two linked texts have at least ``threshold`` times the larger size in common, so of the
    rest at least that less the common shingles of either: ``least``. Each text follows its
    rest by branching * threshold / least, so that both expect to follow as many together
    as without a common part. Of two texts with next to no rest the bucket takes both; one
    such text still follows as much as any text that it is linked to and that has more.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            whole = [[], [], []]
            for id_, at, shingles in zip(batch["id"].to_pylist(), batch["at"].to_pylist(), batch["shingles"]):
                shingles = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                size, hashes = len(shingles), mixed(shingles)
                for path, common in ((x["path"], x["common"]) for x in at):
                    rest = shingles[~_is_common(hashes, common)]
                    least = threshold * size - (size - len(rest))
                    if least < threshold * size / 4:
                        for x, value in zip(whole, (id_, path, size)):
                            x.append(value)
                    below = _below(np.array([max(least, threshold**2 * size / 4)]), branching * threshold)[0]
                    _, to = _chosen(rest, below, np.array([path], np.int64).view(np.uint64)[0])
                    for x, value in zip(out, (id_, path, size)):
                        x.append(np.full(len(to), value, np.int64))
                    out[3].append(to.view(np.int64))
            columns = [pa.array(np.concatenate([*x, np.array(y, np.int64)])) for x, y in zip(out, whole)]
            to = pa.array(np.concatenate([*out[3], np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([to, pa.nulls(len(whole[0]), pa.int64())])], ["id", "parent", "size", "path"])

    return make


def _compare(threshold: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["path", "one", "two"]):
            table = table.combine_chunks()
            ids, rows = np.unique(table["id"].to_numpy(), return_index=True)
            sets = lists(table, "shingles", rows)
            size = np.array([len(x) for x in sets], np.float64)
            both = shared(len(ids), sets)
            linked = np.concatenate([both[s] >= threshold * (size[s, None] + size[None, :] - both[s]) - 1e-6 for s in strips(len(ids))])
            del both
            out = link_rows(linked, table, rows, ids, table["path"][0].as_py(), table["one"][0].as_py() != table["two"][0].as_py())
            if out is not None:
                yield out

    return make


def _near_sizes(members: DataFrame, threshold: float) -> DataFrame:
    """The members (path, id, size, ...) of small buckets that can have a link there: sizes of linked sets differ by the threshold at most, so that the next smaller or next larger size tells."""
    path = W.partitionBy("path").orderBy("size")
    near = (F.lag("size").over(path) + 1e-6 >= F.col("size") * threshold) | (F.col("size") + 1e-6 >= F.lead("size").over(path) * threshold)
    return members.withColumn("near", near).where("near").drop("near")


def _at(large: DataFrame) -> DataFrame:
    """(id, paths, told) of members (path, id, texts) of large paths: all paths of a text, and those of which it tells what is common."""
    telling = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) * F.col("texts") < TELLING << 20
    return large.groupBy("id").agg(F.collect_list("path").alias("paths"), F.collect_list(F.when(telling, F.col("path"))).alias("told"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, branching: float = 2.0, target_recall: float = 0.9995) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, n_links).

    Two texts are linked when their sets of ``n``-word shingles have a Jaccard similarity
    of at least ``threshold``. n_links counts the other texts linked to this one, equal
    ones included; class_id is the smallest doc_id that links reach, the own one for a
    text without links. Links are exact when reported; a pair at the threshold is found
    with probability ``target_recall`` or more.

    Texts with the same words stand together from the start and count as copies of one
    representative, so groups of copies are never expanded into pairs; links inside a
    bucket are counted where they are found and only their totals leave the task.

    Texts of fewer than ``n`` words have one shingle of all their words. Null texts and
    texts without words link with nothing. Rows with one id and the same words are one
    text: it counts once and doesn't link with itself. Rows with one id but other words are
    texts of their own that share the id. A text without an id takes part like all others, but counts for no
    n_links and its id is none to be reached; its class_id is null where no other has one.
    Other columns are not read. An empty table gives an empty one.
    """
    return near_classes(docs, id_col, text_col, n, threshold, branching, target_recall).select("doc_id", "class_id", "n_links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, branching: float = 2.0, target_recall: float = 0.9995) -> DataFrame:
    """:func:`ngram_jaccard_join` with two more columns: ``mark``, xxhash64 of the text as it is, and ``near``, the same number for all rows of a class (null: no words)."""
    seeds = mixed(np.arange(1, runs_needed(target_recall, threshold, branching) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    prints = ["print1", "print2"]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = bounded(docs).withColumn("mark", F.xxhash64("text"))
    sketch = written(marked.mapInArrow(_sketches(n, seeds, branching), "doc_id long, mark long, print1 long, print2 long, size long, paths array<long>"))
    one = sketch.where("print1 is not null")
    same = one.select(*prints, "doc_id").distinct().groupBy(*prints).agg(F.min("doc_id").alias("low"), F.count("doc_id").alias("copies"))
    # a number of its own for each representative: an id may have several
    reps = written(one.dropDuplicates(prints).drop("doc_id", "mark").join(same, prints).withColumn("id", F.monotonically_increasing_id()))

    members = reps.select("id", "size", F.explode("paths").alias("path"))
    # large paths with the same members all stay: the recall rests on each splitting by its own seed
    members = written(members.join(distinct_buckets(members, BUCKET_TEXTS), "path"))
    small, large = written(_near_sizes(members.where(F.col("texts") <= BUCKET_TEXTS), threshold)), members.where(F.col("texts") > BUCKET_TEXTS)
    blocks = F.greatest(F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("texts") / BLOCK_TEXTS)).cast("int").alias("blocks")
    # texts without large paths have all their buckets now
    wanted = small.groupBy("id").agg(F.collect_list(F.struct("path", blocks)).alias("at")).join(_at(large), "id", "full").withColumn("at", F.expr("if(paths is null, at, null)"))
    texts = reps.select(F.col("low").alias("doc_id"), "id", "copies", *prints).join(wanted, "id")
    columns = ["id", "copies", "at", "paths", "told", *prints, "text"]
    rows = docs.join(texts, "doc_id").select(columns)
    if not sketch.where("doc_id is null and print1 is not null").isEmpty():
        # texts of no id are found by their prints
        bare = docs.where("doc_id is null and text is not null").select("text").mapInArrow(_printed, "text string, print1 long, print2 long")
        rows = rows.unionByName(bare.dropDuplicates(prints).join(texts.where("doc_id is null"), prints).select(columns))
    # a text comes with its large paths, or with its buckets, so that the first round needs no join, and the comparison none for most texts
    sets = written(rows.mapInArrow(_sets(n), "id long, copies long, at array<struct<path: long, blocks: int>>, paths array<long>, told array<long>, shingles array<long>"))

    leaves, whole, done, left = [small], [], [members, small, sets], sets.where("paths is not null").select("id", "paths", "told", "shingles")
    for depth in range(MOST_DEPTH):
        if large.isEmpty():
            break
        if depth == MOST_DEPTH - 1:
            whole.append(large.select("id", "size", "path"))
            break
        if depth:
            # the next round only takes sets of this one
            taken = written(_at(large).join(left.select("id", "shingles"), "id").select("id", "paths", "told", "shingles"))
            forget(left)
            left = taken
        split = written(left.select("id", "paths", "shingles").mapInArrow(_children(branching), "id long, parent long, size long, path long, bins array<int>"))
        means = split.where("bins is not null").select("parent", "bins").groupBy("parent").applyInArrow(_shares, "path long, mean double")
        alike = written(large.select("path", "texts").distinct().join(means, "path").where(F.col("mean") >= MUCH * F.col("texts")).select("path"))
        # a set may stand twice, see _sets
        apart = split.where("bins is null").join(alike.withColumnRenamed("path", "parent"), "parent", "left_anti").select("id", "size", "path").distinct()
        done.append(alike)
        if not alike.isEmpty():
            told = left.select(F.explode("told").alias("path"), "shingles").join(alike, "path")
            common = written(told.groupBy("path").applyInArrow(_common, "path long, common binary"))
            # a path of which no text tells has no map
            at = large.join(alike, "path").join(common, "path", "left").select("id", F.struct("path", "common").alias("at")).groupBy("id").agg(F.collect_list("at").alias("at"))
            rests = written(at.join(left.select("id", "shingles"), "id").select("id", "at", "shingles").mapInArrow(_rests(threshold, branching), "id long, parent long, size long, path long"))
            whole.append(rests.where("path is null").select("id", "size", F.col("parent").alias("path")).distinct())
            apart = apart.unionByName(rests.where("path is not null").select("id", "size", "path").distinct())
            done += [common, rests]
        children = written(apart.join(distinct_buckets(apart, BUCKET_TEXTS), "path"))
        forget(split)
        done.append(children)
        leaves.append(_near_sizes(children.where(F.col("texts") <= BUCKET_TEXTS), threshold))
        large = children.where(F.col("texts") > BUCKET_TEXTS)

    forget(left)
    if whole:
        # nothing splits any more, so of large paths with the same members one is enough
        last = reduce(DataFrame.unionByName, whole)
        leaves.append(last.join(distinct_buckets(last), "path"))
    found = reduce(DataFrame.unionByName, leaves)
    links = written(placed(found.select("id", "path", blocks), sets.select("id", "copies", "at", "shingles")).mapInArrow(_compare(threshold), "id long, n_links long, root long"))
    forget(*done)

    classes = smallest_labels(connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))), reps.select("id", F.col("low").alias("label")))
    totals = links.groupBy("id").agg(F.sum("n_links").alias("far"))
    known = reps.select(*prints, "id", "low", "copies").join(totals, "id", "left").join(classes, "id", "left")
    known = known.select(*prints, F.coalesce("component", "id").alias("near"), F.least("label", "low").alias("class_id"), (F.coalesce("far", F.lit(0)) + F.col("copies")).alias("all"))
    # rows without a print go past the join
    out = one.select("doc_id", "mark", *prints).join(known, prints).select("doc_id", "mark", "near", "class_id", (F.col("all") - F.col("doc_id").isNotNull().cast("long")).alias("n_links"))
    empty = sketch.where("print1 is null").select("doc_id", "mark", F.lit(None).cast("long").alias("near"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty)
