"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs that end together.

Both tokenizers spell the same bytes. Where tokens of both end at one byte, a group of
tokens ends, and the two tokens that end there are linked.

First pass: every task aligns its documents and gives the counts of its linked pairs, by
shard of the pair's second id. The distinct pairs of each shard get a minimal perfect
hash; each task's counts become a dense vector in the order of that hash, and the vectors
of all tasks are summed as a tree. Second pass: documents are aligned again, and the pairs
of each are looked up by their hash; the key kept under that number must be the same.

Neither tokenizer lets a token go over a space that follows another character than white
space, so a text is cut there into units that are encoded, aligned and looked up once for
as long as a task keeps them.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.bytetext import list_array, mixed
from sieveworks.llm.perfect_hash import PerfectHash
from sieveworks.sources.storage import forget, written

FIRST_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
SECOND_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Shards of the pairs, by second id; all pairs of one second id lie in one shard.
SHARDS = 128
#: Partial vectors that one task adds up.
FAN = 32
#: Pairs that a task looks up at a time: 17 bytes each. Beyond, documents are aligned once more for every further part.
PAIRS_AT_ONCE = 2_000_000
#: Pairs that a task counts before it gives its counts away.
PAIRS_COUNTED = 1_000_000
#: Units and characters that a task keeps.
KEPT_UNITS, KEPT_CHARS = 400_000, 8_000_000
#: Units that are encoded as one string.
_TOGETHER = 32

#: Runs up to a space that follows another character than white space.
_UNIT = re.compile(r" *(?:[^ ]*[^\S ] +)*(?:[^ ]+|\Z)")
_SPACE = "▁"


@dataclass(frozen=True)
class Tokenizers:
    """The two model files as they go to the tasks, and the bytes that each id spells."""

    first: str
    second: bytes
    first_bytes: tuple[bytes, ...]
    second_bytes: tuple[bytes, ...]


@functools.lru_cache(4)
def load_tokenizers(first: str = FIRST_MODEL, second: str = SECOND_MODEL) -> Tokenizers:
    """Both models, read on the driver (3 MB). The second is told not to put a space before a text, since units carry their own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer

    with open(first, encoding="utf-8") as file:
        text = file.read()
    one = Tokenizer.from_str(text)
    spelled = _byte_letters()
    first_bytes = tuple(bytes(spelled[c] for c in t) if t is not None and all(c in spelled for c in t) else (t or "").encode() for t in map(one.id_to_token, range(one.get_vocab_size())))
    model = sentencepiece_model_pb2.ModelProto()
    with open(second, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.add_dummy_prefix = False
    packed = model.SerializeToString()
    two = sentencepiece.SentencePieceProcessor(model_proto=packed)
    names = [two.id_to_piece(i) for i in range(two.get_piece_size())]
    if any(re.search(f"[^{_SPACE}]{_SPACE}", x) for x in names):
        raise ValueError("a piece goes on over a space, so texts can't be cut into units")
    second_bytes = tuple(bytes([int(x[3:-1], 16)]) if two.is_byte(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(names))
    return Tokenizers(text, packed, first_bytes, second_bytes)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: How the first tokenizer divides texts before merging, where its file says that it is byte-level (a fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def _encoders(tokenizers: Tokenizers) -> tuple:
    """Functions from strings to their ids under both tokenizers.

    Where the first one's merges come in the order of its ids, its tokens are ranks, and
    the quicker library for ranks gives the same ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    two = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.second)
    second = functools.partial(two.encode, num_threads=1)
    if ranks := _ranks(tokenizers):
        import tiktoken

        one = tiktoken.Encoding("first", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: list(map(one.encode_ordinary, texts)), second
    one = Tokenizer.from_str(tokenizers.first)
    one.encode_special_tokens = True
    return lambda texts: [e.ids for e in one.encode_batch_fast(texts, add_special_tokens=False)], second


def _ranks(tokenizers: Tokenizers) -> dict[bytes, int] | None:
    """The first tokenizer's tokens by rank, if it is byte-level BPE without normalising and its ids follow its merges."""
    told = json.loads(tokenizers.first)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if not plain or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return {tokenizers.first_bytes[i]: i for i in range(256 + len(merges))}


class Aligner:
    """Units with their aligned tokens, and what a table of counts says of their links."""

    def __init__(self, tokenizers: Tokenizers, counts: Counts | None = None, shown: bool = True) -> None:
        self.encoders = _encoders(tokenizers)
        self.spelled = [list(tokenizers.first_bytes), list(tokenizers.second_bytes)]
        self.sizes = [np.array([len(x) for x in s], np.int64) for s in self.spelled]
        self.counts, self.shown = counts, shown
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.keys = np.zeros(0, np.int64)
        #: For each unit: tokens of both, groups, best links, sum of counts; -1 tokens if it isn't spelled by its tokens.
        self.facts = np.zeros((0, 5), np.int64)
        self.starts = np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Align units and add them. Those that begin with a space and end otherwise are encoded many in a string, in which they stay apart."""
        runs = [u for u in new if u[0] == " " and not u[-1].isspace() and _SPACE not in u]
        others = list(set(new).difference(runs)) if len(runs) < len(new) else []
        found = []
        for units, size in ((runs, _TOGETHER), (others, 1)):
            at = 0
            while at < len(units):
                step, chars = at, 0
                while step < len(units) and (chars < 300_000 or step == at):
                    chars += len(units[step])
                    step += 1
                part = units[at:step]
                found.append(self._aligned(part, size) or self._one_by_one(part))
                self.chars += chars
                at = step
        self.index.update(zip([*runs, *others], range(len(self.index), len(self.index) + len(new))))
        facts, groups, keys = zip(*found) if found else ((), (), ())
        self.groups += itertools.chain.from_iterable(groups)
        self.facts, self.keys = np.concatenate([self.facts, *facts]), np.concatenate([self.keys, *keys])
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.facts[:, 2], 0))])

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        bad = np.array([[-1, -1, -1, 0, 0]], np.int64)
        facts, groups, keys = zip(*(self._aligned([u], 1) or (bad, [""], np.zeros(0, np.int64)) for u in units))
        return np.concatenate(facts), list(itertools.chain.from_iterable(groups)), np.concatenate(keys)

    def _aligned(self, units: list[str], together: int) -> tuple[np.ndarray, list[str], np.ndarray] | None:
        """Facts, groups and links of units; none unless their tokens spell every one of them."""
        strings = ["".join(units[i : i + together]) for i in range(0, len(units), together)]
        whole = "".join(strings).encode()
        ids = [list(itertools.chain.from_iterable(encode(strings))) for encode in self.encoders]
        if any(b"".join(map(self.spelled[k].__getitem__, ids[k])) != whole for k in (0, 1)):
            return None
        flat = [np.array(x, np.int64) for x in ids]
        ends = [np.cumsum(self.sizes[k][flat[k]]) for k in (0, 1)]
        sizes = list(map(len, units)) if whole.isascii() else [len(u.encode()) for u in units]
        unit_ends = np.cumsum(sizes)
        both, last_one, last_two = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        per_unit = np.searchsorted(both, unit_ends) + 1
        if (both[np.minimum(per_unit, len(both)) - 1] != unit_ends).any():
            return None
        facts = np.zeros((len(units), 5), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 2] = (np.diff(x, prepend=0) for x in (last_one[per_unit - 1] + 1, last_two[per_unit - 1] + 1, per_unit))
        keys = flat[1][last_two] << 32 | flat[0][last_one]
        texts = [""] * len(units)
        if self.shown:
            names = [list(map(str, x)) for x in ids]
            cuts = [[0, *(x + 1).tolist()] for x in (last_one, last_two)]
            groups = [f"{','.join(names[0][a:b])}|{','.join(names[1][c:d])}" for a, b, c, d in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
            bounds = [0, *per_unit.tolist()]
            texts = [";".join(groups[a:b]) for a, b in zip(bounds, bounds[1:])]
        if self.counts is not None and len(keys):
            count, best = self.counts.of(keys)
            starts = np.concatenate([[0], per_unit[:-1]])
            facts[:, 3], facts[:, 4] = np.add.reduceat(best, starts, dtype=np.int64), np.add.reduceat(count, starts)
        return facts, texts, keys

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, one after another, and how many each has: none for a text that its tokens don't spell, or an empty one."""
        if len(self.index) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.reset()
        split = [[u for u in _UNIT.findall(" " + t) if u] if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.index)))
        out = []
        for words, text in zip(split, texts):
            at = np.array([*map(self.index.__getitem__, words)], np.int64)
            if len(at) and (self.facts[at, 0] < 0).any():
                at = self._whole(" " + text)
            out.append(at)
        return np.concatenate([*out, np.zeros(0, np.int64)]), np.array([len(x) for x in out], np.int64)

    def _whole(self, text: str) -> np.ndarray:
        """A text some unit of which isn't spelled by its tokens, as one unit: it may be spelled as a whole."""
        if text not in self.index:
            self.learn([text])
        at = np.array([self.index[text]], np.int64)
        return at if self.facts[at[0], 0] >= 0 else at[:0]


@dataclass(frozen=True)
class Counts:
    """Counts of pairs by perfect hash, and which are the highest of their second id.

    Pairs of shards outside have none here, nor have pairs that stand only in texts without tokens.
    """

    hashes: dict[int, PerfectHash]
    keys: dict[int, np.ndarray]
    counts: dict[int, np.ndarray]
    best: dict[int, np.ndarray]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        shard = shards(keys)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for s, found in self.hashes.items():
            mine = order[cuts[s] : cuts[s + 1]]
            if not len(mine):
                continue
            at = found.numbers(keys[mine])
            known = (at >= 0) & (self.keys[s][at] == keys[mine])
            mine, at = mine[known], at[known]
            count[mine], best[mine] = self.counts[s][at], self.best[s][at]
        return count, best


def shards(keys: np.ndarray) -> np.ndarray:
    return (mixed((keys >> 32).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


_PARTIAL = "shard int, part long, keys array<long>, counts array<long>"
_HASH = "shard int, sizes array<long>, words array<long>, ranks array<int>, keys array<long>"
_DENSE = "shard int, part long, counts array<long>"


def _slices(texts: pa.Array, most_bytes: int = 3_000_000) -> Iterator[list[str | None]]:
    """Runs of whole texts of about so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    bounds = [0, *(np.flatnonzero(np.diff(sizes // most_bytes)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield texts.slice(a, b - a).to_pylist()


def linked_pairs(texts: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(shard, part, keys, counts): the linked pairs of each task's texts, keys ascending."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(tokenizers, shown=False), TaskContext.get().partitionId()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for texts in _slices(batch["text"]):
                units, _ = aligner.units(texts)
                times = np.bincount(units, minlength=len(aligner.groups))
                sizes = np.diff(aligner.starts)
                here = np.flatnonzero(times)
                flat, lengths = _gathered(aligner.keys, aligner.starts[here], sizes[here])
                keys, counts = _summed(np.concatenate([keys, flat]), np.concatenate([counts, np.repeat(times[here], lengths)]))
                if len(keys) > PAIRS_COUNTED:
                    yield from _by_shard(part, keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from _by_shard(part, keys, counts)

    return texts.mapInArrow(make, _PARTIAL)


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


def _by_shard(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    shard = shards(keys)
    order = np.argsort(shard, kind="stable")
    there, sizes = np.unique(shard, return_counts=True)
    if len(there):
        columns = [pa.array(there, pa.int32()), pa.array(np.full(len(there), part), pa.int64()), list_array(keys[order], sizes, pa.int64()), list_array(counts[order], sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "keys", "counts"])


def hashed_pairs(partials: DataFrame) -> DataFrame:
    """(shard, sizes, words, ranks, keys): the perfect hash of each shard's distinct pairs, and the pairs in its order.

    A shard holds at most its share of the product of both vocabularies, whatever the corpus.
    """
    pairs = partials.select("shard", F.explode("keys").alias("key")).distinct()

    def make(table: pa.Table) -> pa.Table:
        keys = np.sort(table["key"].to_numpy())
        found = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[found.numbers(keys)] = keys
        lists = ((np.array(found.sizes, np.int64), pa.int64()), (found.words.view(np.int64), pa.int64()), (found.ranks.astype(np.int32), pa.int32()), (ordered, pa.int64()))
        return pa.table([table["shard"][:1].cast(pa.int32()), *(list_array(x, [len(x)], kind) for x, kind in lists)], ["shard", "sizes", "words", "ranks", "keys"])

    return pairs.groupBy("shard").applyInArrow(make, _HASH)


def dense_counts(partials: DataFrame, hashes: DataFrame) -> DataFrame:
    """(shard, part, counts): one vector a shard, in the order of its hash: the tasks' counts as dense vectors, :data:`FAN` of them added at a time."""
    tables = written(_first_sums(partials, hashes))
    while tables.groupBy("shard").count().agg(F.max("count")).first()[0] not in (None, 1):
        nearer = written(tables.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("shard", "part").applyInArrow(_add_vectors, _DENSE))
        forget(tables)
        tables = nearer
    return tables


def _first_sums(partials: DataFrame, hashes: DataFrame) -> DataFrame:
    """Dense vectors of runs of tasks. A group meets its shard's hash in a cogroup; it holds the counts of :data:`FAN` tasks."""
    lanes = partials.select("shard", F.floor(F.col("part") / FAN).alias("part"), "keys", "counts")
    bare = hashes.select("shard", "sizes", "words", "ranks", F.size("keys").alias("n"))
    asked = bare.join(lanes.select("shard", F.col("part").alias("lane")).distinct(), "shard").withColumnRenamed("shard", "its_shard")

    def make(mine: pa.Table, its_hash: pa.Table) -> pa.Table:
        found = _hash_of(its_hash.slice(0, 1).to_pylist()[0])
        total = np.zeros(found.count, np.int64)
        for chunk in mine.to_batches():
            for keys, counts in zip(chunk["keys"], chunk["counts"]):
                total[found.numbers(keys.values.to_numpy())] += counts.values.to_numpy()
        return pa.table([mine["shard"][:1], mine["part"][:1], list_array(total, [len(total)], pa.int64())], ["shard", "part", "counts"])

    return lanes.groupBy("shard", "part").cogroup(asked.groupBy("its_shard", "lane")).applyInArrow(make, _DENSE)


def _add_vectors(table: pa.Table) -> pa.Table:
    total = None
    for chunk in table["counts"].chunks:
        for row in chunk:
            values = row.values.to_numpy()
            total = values.copy() if total is None else total + values
    return pa.table([table["shard"][:1], table["part"][:1], list_array(total, [len(total)], pa.int64())], ["shard", "part", "counts"])


def _hash_of(row: dict) -> PerfectHash:
    return PerfectHash(tuple(row["sizes"]), np.array(row["words"], np.int64).view(np.uint64), np.array(row["ranks"], np.uint32), row["n"])


def best_links(hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """The hashes with ``counts`` and ``best``: whether a pair's count is the highest of its second id, all of whose pairs lie in one shard."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                second, count = row["keys"].flatten().to_numpy() >> 32, row["counts"].flatten().to_numpy()
                ids, at = np.unique(second, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, at, count)
                yield pa.RecordBatch.from_arrays([*row.columns, list_array(count == top[at], [len(count)], pa.bool_())], [*row.schema.names, "best"])

    return hashes.join(counts.drop("part"), "shard").mapInArrow(make, f"{_HASH}, counts array<long>, best array<boolean>")


def count_tables(texts: DataFrame, tokenizers: Tokenizers, pairs_at_once: int = PAIRS_AT_ONCE) -> Iterator[Counts]:
    """The first pass and its tables, so many pairs at a time and one shard at least."""
    partials = written(linked_pairs(texts, tokenizers))
    hashes = written(hashed_pairs(partials))
    dense = dense_counts(partials, hashes)
    tables = written(best_links(hashes, dense))
    forget(partials, hashes, dense)
    sizes = {r["shard"]: r["n"] for r in tables.select("shard", F.size("keys").alias("n")).collect()}
    parts: list[list[int]] = []
    room = 0
    for shard in sorted(sizes):
        if sizes[shard] > room:
            parts.append([])
            room = pairs_at_once
        parts[-1].append(shard)
        room -= sizes[shard]
    for part in parts:
        found = Counts({}, {}, {}, {})
        for batch in tables.where(F.col("shard").isin(part)).toArrow().to_batches():
            for i, shard in enumerate(batch["shard"].to_pylist()):
                values = {name: batch[name][i].values.to_numpy(zero_copy_only=False) for name in ("words", "ranks", "keys", "counts", "best")}
                found.hashes[shard] = PerfectHash(tuple(batch["sizes"][i].as_py()), values["words"].view(np.uint64), values["ranks"].astype(np.uint32), len(values["keys"]))
                found.keys[shard], found.counts[shard], found.best[shard] = values["keys"], values["counts"], values["best"]
        yield found
    forget(tables)


def align_tokens(docs: DataFrame, first: str = FIRST_MODEL, second: str = SECOND_MODEL, id_col: str = "doc_id", text_col: str = "text", pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): the aligned tokens of every whole text.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` with the ids of both tokenizers. Each group ends
    in one link; a link's count is the number of links of all documents with the same two
    ids, ``count_sum`` adds them up, ``n_best`` counts links whose count is the highest
    of their second id, ties included. A space is put before each text. Texts that are
    null, empty or not spelled by the tokens of both (such as those with U+2581) have no
    tokens: zeros and empty groups, and count nowhere. Rows that repeat count each. Ids
    may be null or repeat; other columns don't matter. A very long text is held whole by
    its task.
    """
    tokenizers = load_tokenizers(first, second)
    texts = bounded(docs.select(F.col(text_col).alias("text")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    context = docs.sparkSession.sparkContext
    found = [context.broadcast(c) for c in count_tables(texts, tokenizers, pairs_at_once)]
    if not found:
        found = [context.broadcast(Counts({}, {}, {}, {}))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    for i, counts in enumerate(found):
        last = i == len(found) - 1
        shown = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        rows = rows.mapInArrow(_looked_up(tokenizers, counts, last), shown if last else f"doc_id {kind}, text string, n_best long, count_sum long")
    return rows


def _looked_up(tokenizers: Tokenizers, counts, last: bool):
    """A function from batches to the same with the counts of one table added; the last one gives the aligned tokens as well."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers, counts.value)
        for batch in batches:
            row = 0
            for texts in _slices(batch["text"]):
                part = batch.slice(row, len(texts))
                row += len(texts)
                units, sizes = aligner.units(texts)
                ends = np.cumsum(sizes)
                totals = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(aligner.facts[units], axis=0)])
                sums = totals[ends] - totals[ends - sizes]
                best, count = (pa.array(sums[:, k] + part[name].to_numpy(), pa.int64()) for k, name in ((3, "n_best"), (4, "count_sum")))
                if not last:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], best, count], ["doc_id", "text", "n_best", "count_sum"])
                    continue
                names = list(map(aligner.groups.__getitem__, units.tolist()))
                groups = pa.array([";".join(names[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())], pa.string())
                n_a, n_b, n = (pa.array(sums[:, k], pa.int64()) for k in range(3))
                yield pa.RecordBatch.from_arrays([part["doc_id"], n_a, n_b, n, n, best, count, groups], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return make
