"""Benchmark decontamination: approximate search for test items in whole texts.

An item with an error budget of k edits is cut into k + 1 pieces; if the item stands in a
text with at most k edits, one piece stands there unchanged. Rolling hashes find the
pieces, and Myers' bit-parallel algorithm measures the edit distance around each hit.
Items and texts have a space at either end, which counts as a character: an item of any
length is looked for as whole words, and standing inside a word costs edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.bytetext import WORD_BYTE, byte_slices, prefix_hashes, span_hashes
from sieveworks.sources.storage import written

#: Characters of test items that are searched for in one pass over the texts.
PASS_CHARS = 4_000_000
_FILTER_BITS = 22


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with every run of other than word characters as one space, and where each text starts; a space stands before and behind every text, that between two serves both."""
    data = np.insert(np.where(WORD_BYTE[data], data, 32).astype(np.uint8), offsets, 32)
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    keep[0] = True
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return data[keep], places[offsets + np.arange(1, len(offsets) + 1)]


class Item:
    """A test item, ready to be searched for."""

    def __init__(self, item_id: int | None, text: str, budget: float) -> None:
        self.item_id, self.text = item_id, f" {text} "
        self.most = int(len(text) * budget)
        self.place: dict[str, int] = {}
        for i, c in enumerate(self.text):
            self.place[c] = self.place.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[bytes, int]]:
        """The pieces, one more than edits are allowed, and the byte at which each starts."""
        n = self.most + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield self.text[a:b].encode(), len(self.text[:a].encode())

    def distance(self, text: str) -> int:
        """The least edit distance of the item to any part of ``text`` (Myers 1999)."""
        m = len(self.text)
        top, full = 1 << m - 1, (1 << m) - 1
        up, down, score, least = full, 0, m, m
        for c in text:
            same = self.place.get(c, 0)
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            rise, fall = (down | ~(horizontal | up)) & full, up & horizontal
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                least = min(least, score)
            rise, fall = rise << 1, fall << 1
            up, down = (fall | ~(vertical | rise)) & full, rise & vertical & full
        return least


class Pieces:
    """Pieces of items: sorted hashes of their first bytes, as many as all have, and what stands behind each."""

    def __init__(self, found: list[tuple[bytes, int, Item]]) -> None:
        self.width = min(len(p) for p, _, _ in found)
        data = np.frombuffer(b"".join(p[: self.width] for p, _, _ in found), np.uint8)
        starts = np.arange(len(found)) * self.width
        hashes = span_hashes(prefix_hashes(data), starts, starts + self.width)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.pieces = hashes[order], [found[i] for i in order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, data: np.ndarray, starts: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[int, Item, int]]:
        """(text, item, byte at which the item would start) of every piece in its place."""
        last = np.arange(max(0, len(data) - self.width + 1))
        hashes = span_hashes(prefix, last, last + self.width)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        low, high = np.searchsorted(self.hashes, hashes[at]), np.searchsorted(self.hashes, hashes[at], "right")
        some = np.flatnonzero(high > low)
        at, low, high = at[some], low[some], high[some]
        # the second byte's text: the first may be the space before it
        text = np.searchsorted(starts, at + 1, "right") - 1
        for place, a, b, row in zip(at.tolist(), low.tolist(), high.tolist(), text.tolist()):
            for piece, offset, item in self.pieces[a:b]:
                if place + len(piece) <= starts[row + 1] and data[place : place + len(piece)].tobytes() == piece:
                    yield row, item, place - offset


class Index:
    """All pieces of some items, of three bytes at least, in tables by length: under four, under eight, others."""

    def __init__(self, items: list[Item]) -> None:
        parts: dict[int, list[tuple[bytes, int, Item]]] = {}
        for item in items:
            for piece, at in item.pieces():
                parts.setdefault(min(len(piece).bit_length(), 4), []).append((piece, at, item))
        self.parts = [Pieces(found) for found in parts.values()]

    def hits(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, Item, int]]:
        prefix = prefix_hashes(data)
        for part in self.parts:
            yield from part.hits(data, starts, prefix)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, Item, int]]:
        """(text, item, distance) where the distance is within the item's budget."""
        places: dict[tuple[int, Item], list[int]] = {}
        for row, item, start in self.hits(data, starts):
            places.setdefault((row, item), []).append(start)
        for (row, item), where in places.items():
            if not item.most:
                # the piece is the whole item
                yield row, item, 0
                continue
            margin, size = 4 * item.most, len(item.text.encode())
            spans: list[list[int]] = []
            for start in sorted(set(where)):
                a, b = max(start - margin, int(starts[row]) - 1), min(start + size + margin, int(starts[row + 1]))
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            # a span that starts inside a character loses only that character's rest, which the margin covers
            least = min(item.distance(data[a:b].tobytes().decode(errors="ignore")) for a, b in spans)
            if least <= item.most:
                yield row, item, least


def item_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", budget: float = 0.08) -> Iterator[tuple[Index, bool]]:
    """Indexes over all items, one after another, each of at most about :data:`PASS_CHARS` characters, and whether it is the last, so that what the driver holds and sends to the executors stays bounded however many items there are.

    Items are normalised as the texts are. Items with a null text and those without any
    word character stand nowhere. Rows with the same id and text are one item; ids may be null.
    """
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // PASS_CHARS)
    for i in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").collect()
        items = {}
        for row in part:
            _, _, data, offsets = next(byte_slices(pa.array([row["text"]])))
            if text := normalised(data, offsets)[0].tobytes().decode().strip():
                items[row["item_id"], text] = Item(row["item_id"], text, budget)
        if items:
            yield Index([*items.values()]), i == passes - 1


def _scan(index: Index, texts: pa.Array, tell: Callable[[int, Item, int], None]) -> None:
    for a, _, data, offsets in byte_slices(texts):
        for row, item, distance in index.matches(*normalised(data, offsets)):
            tell(a + row, item, distance)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float = 0.08) -> DataFrame:
    """(doc_id, item_id, distance, budget): the items that stand in each text within ``budget`` edits a character, with the least edit distance (budget: the edits allowed).

    Texts and items are compared lower-cased, with runs of other characters as one space
    and a space at either end. The budget of an item of n characters, these two aside, is
    n times ``budget``, rounded down: none for very short ones. Null and empty texts hold nothing. A repeated text gives its rows as
    often as it stands; rows with the same item id give one row each only if their
    normalised texts differ. Without items, or without texts, the result is empty.
    """

    def scan(index: Index):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple[int, int, int, int]] = []
                _scan(index, batch["text"], lambda row, item, distance: rows.append((row, item.item_id, distance, item.most)))
                if rows:
                    at, item, distance, most = (pa.array(x, pa.int64()) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), item, distance, most], ["doc_id", "item_id", "distance", "budget"])

        return make

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance long, budget long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, last in item_indexes(benchmark, budget=budget):
        found = bounded(docs).mapInArrow(scan(index), schema)
        # written, so that the driver can let go of the index before it makes the next
        out = out.unionByName(found if last else written(found))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", budget: float = 0.08) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item stands within the budget; null and empty texts stay."""

    def clean(index: Index):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                _scan(index, batch[text_col], lambda row, item, distance: keep.__setitem__(row, False))
                yield batch.filter(pa.array(keep))

        return make

    for index, last in item_indexes(benchmark, budget=budget):
        docs = bounded(docs).mapInArrow(clean(index), docs.schema)
        docs = docs if last else written(docs)
    return docs
