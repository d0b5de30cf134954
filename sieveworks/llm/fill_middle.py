"""Fill-in-the-middle transformation with memoised content-defined chunks.

A text is cut into *units*: a run of ASCII letters, or any other single character. Where
the prefix, middle and suffix of a document lie is given in units, so units have to be
counted and located in every text. Texts are divided into chunks where a rolling hash of
the last 32 bytes says so, so passages that texts share become equal chunks wherever they
stand. A chunk's *boundary summary* is its number of units and characters and whether it
begins or ends inside letters; a task keeps the summaries of chunks that it has seen, by
the chunk's whole content. Summaries combine: units add up, less one wherever letters
meet over a boundary. Sums over a text's chunks give its number of units and the chunk in
which a cut lies; only there single bytes are looked at.

The memo is bounded, holds nothing that can't be computed again, and makes no difference
to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded

#: Share of documents, in hundredths, that are transformed; and share of those, in hundredths, with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"

#: Bytes that the rolling hash covers; shortest and longest chunk; bits of the hash that must be zero at a cut.
WINDOW, LEAST_CHUNK, MOST_CHUNK, CUT_BITS = 32, 64, 4096, 8
#: Bytes of chunks whose summaries a task keeps.
KEPT_BYTES = 48_000_000

_GEAR = np.random.default_rng(20240613).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the :data:`WINDOW` bytes that end with it: older bytes are shifted out of 32 bits, so windows add up by doubling."""
    out = _GEAR[data]
    step = 1
    while step < WINDOW:
        older = out[:-step] << np.uint32(step)
        out[step:] += older
        step *= 2
    return out


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text of ``data`` the ends of its chunks; a chunk never ends inside a character, nor depends on what stands before its text.

    Cuts follow the hash alone but for a least and a most number of bytes.
    """
    follows = np.ones(len(data) + 1, bool)
    follows[:-1] = (data & 0xC0) != 0x80
    if len(data):
        asked = np.flatnonzero(((_rolling(data) >> np.uint32(32 - CUT_BITS)) == 0) & follows[1:]) + 1
    else:
        asked = np.zeros(0, np.int64)
    first = np.searchsorted(asked, offsets)
    out = []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        ends: list[int] = []
        at = a
        for cut in [*asked[i:j].tolist(), b]:
            while cut - at > MOST_CHUNK:
                forced = at + MOST_CHUNK
                while not follows[forced]:
                    forced -= 1
                ends.append(forced)
                at = forced
            if cut - at >= LEAST_CHUNK and cut < b or cut == b > at:
                ends.append(cut)
                at = cut
        out.append(ends)
    return out


def _unit_starts(data: np.ndarray, letters_before: bool) -> np.ndarray:
    """Where units begin in a chunk, given whether letters go on into it."""
    letter = _LETTER[data]
    inside = np.empty(len(data), bool)
    inside[:1] = letters_before
    inside[1:] = letter[:-1]
    return np.flatnonzero(((data & 0xC0) != 0x80) & ~(letter & inside))


@dataclass
class Memo:
    """Boundary summaries of chunks by their content: (units, characters, begins with a letter, ends with one)."""

    most_bytes: int = KEPT_BYTES

    def __post_init__(self) -> None:
        self.known: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.held = 0

    def summaries(self, chunks: list[bytes]) -> np.ndarray:
        """A row of four numbers for each chunk."""
        new = list({c for c in chunks if c not in self.known})
        if new:
            if self.held > self.most_bytes:
                self.known, self.held = {}, 0
                new = list(set(chunks))
            data = np.frombuffer(b"".join(new), np.uint8)
            ends = np.cumsum([len(c) for c in new])
            starts = np.concatenate([[0], ends[:-1]])
            letter, lead = _LETTER[data], (data & 0xC0) != 0x80
            begins = lead.copy()
            begins[1:] &= ~(letter[1:] & letter[:-1])
            begins[starts] = lead[starts]
            units, points = np.add.reduceat(begins, starts, dtype=np.int64), np.add.reduceat(lead, starts, dtype=np.int64)
            self.known.update(zip(new, zip(units.tolist(), points.tolist(), letter[starts].tolist(), letter[ends - 1].tolist())))
            self.held += int(ends[-1])
        return np.array([self.known[c] for c in chunks], np.int64).reshape(len(chunks), 4)


@dataclass
class Summed:
    """Units and characters before each chunk of one text, and whether letters go on into it."""

    text: bytes
    ends: list[int]
    summary: np.ndarray

    def __post_init__(self) -> None:
        joined = np.zeros(len(self.ends), np.int64)
        joined[1:] = self.summary[1:, 2] & self.summary[:-1, 3]
        self.joined = joined
        self.units = np.concatenate([[0], np.cumsum(self.summary[:, 0] - joined)])
        self.points = np.concatenate([[0], np.cumsum(self.summary[:, 1])])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, character) after so many units."""
        if units >= self.units[-1]:
            return len(self.text), int(self.points[-1])
        c = int(np.searchsorted(self.units, units, "right")) - 1
        start = self.ends[c - 1] if c else 0
        data = np.frombuffer(self.text, np.uint8)[start : self.ends[c]]
        inside = int(_unit_starts(data, bool(self.joined[c]))[units - self.units[c]])
        return start + inside, int(self.points[c]) + int(((data[:inside] & 0xC0) != 0x80).sum())


def summed(texts: list[bytes], memo: Memo) -> list[Summed]:
    """Chunk sums of each text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    ends = chunk_ends(np.frombuffer(b"".join(texts), np.uint8), offsets)
    local = [[e - int(o) for e in x] for x, o in zip(ends, offsets[:-1])]
    rows = memo.summaries([t[a:b] for t, x in zip(texts, local) for a, b in zip([0, *x[:-1]], x)])
    at = np.concatenate([[0], np.cumsum([len(x) for x in local])])
    return [Summed(t, x, rows[a:b]) for t, x, a, b in zip(texts, local, at[:-1], at[1:])]


def draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits for a key: the leading groups of the sha256 of ``1:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, most_bytes: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every whole text transformed, or as it is.

    The smaller and the larger of the first two draws modulo n + 1, n the number of units,
    are where prefix and middle end. Form is ``plain`` (the text; lengths null) for an
    empty text, one that holds a mark, or by the third draw; else by the fourth draw
    ``spm`` (suffix, prefix, middle) or ``psm`` (prefix, suffix, middle), each part after
    its mark. A null text counts as empty, a null id as an empty key; rows that repeat
    give the same row again. Very long texts are read in one piece, in chunks of at most
    4,096 bytes. Other columns of ``docs`` don't matter.
    """
    key = F.col(id_col)
    h = draws(key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = (text == "") | text.contains(PREFIX_MARK) | text.contains(SUFFIX_MARK) | text.contains(MIDDLE_MARK) | (h[2] % 100 >= transformed)
    form = F.when(whole, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(key.alias("doc_id"), text.alias("text"), form.alias("form"), h[0].alias("one"), h[1].alias("two"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(most_bytes)
        for batch in batches:
            for part in _runs(batch):
                yield _transformed(part, memo)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return bounded(rows).mapInArrow(make, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what :func:`fill_middle` made of it: the marks stand once each, so the parts lie between them."""
    first = F.when(form == "psm", F.lit(PREFIX_MARK)).otherwise(F.lit(SUFFIX_MARK))
    second = F.when(form == "psm", F.lit(SUFFIX_MARK)).otherwise(F.lit(PREFIX_MARK))
    to_second, to_third = F.call_function("instr", output, second), F.instr(output, MIDDLE_MARK)
    one = F.substr(output, F.length(first) + 1, to_second - 1 - F.length(first))
    two = F.substr(output, to_second + F.length(second), to_third - to_second - F.length(second))
    middle = F.substr(output, to_third + len(MIDDLE_MARK))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def _runs(batch: pa.RecordBatch, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about so much text."""
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"]]) if batch.num_rows else np.zeros(0)
    bounds = [0, *(np.flatnonzero(np.diff(sizes // most_bytes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _transformed(batch: pa.RecordBatch, memo: Memo) -> pa.RecordBatch:
    texts = batch["text"].cast(pa.large_binary()).to_pylist()
    p, s, m = PREFIX_MARK.encode(), SUFFIX_MARK.encode(), MIDDLE_MARK.encode()
    columns: list[list] = [[], [], [], []]
    for t, form, one, two in zip(summed(texts, memo), batch["form"].to_pylist(), batch["one"].to_pylist(), batch["two"].to_pylist()):
        n = int(t.units[-1])
        row: tuple = (n, None, None, t.text)
        if form != "plain":
            (a, before), (b, through) = (t.cut(u) for u in sorted((one % (n + 1), two % (n + 1))))
            prefix, middle, suffix = t.text[:a], t.text[a:b], t.text[b:]
            out = b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))
            row = (n, before, through - before, out)
        for column, value in zip(columns, row):
            column.append(value)
    n, before, middle_chars = (pa.array(x, pa.int64()) for x in columns[:3])
    output = pa.array(columns[3], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch["doc_id"], n, batch["form"], before, middle_chars, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
