"""Whole batches of text as numpy byte arrays: words, word hashes and word shingles.

A *word* is a run of digits, ASCII letters and non-ASCII characters of the
lower-cased text; everything else separates. Texts are taken whole; batches are cut
between texts so that the arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[e] - p[s]) * inverse_power[s]`` the hash of ``data[s:e]``."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data) + 1)[0][:-1], out=p[1:])
    return p


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def byte_slices(texts: pa.Array, most_bytes: int = 2_000_000, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole lower-cased texts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = min(row + most_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTE[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each text the index of its first word (one more at the end)."""
    starts, ends, first = words(data, offsets)
    return span_hashes(prefix_hashes(data), starts, ends), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of ``n`` consecutive words; a text of fewer words has one shingle of all of them, one without words has none."""
    step = powers(n + 1)[0]
    count = len(hashes) - n + 1
    rolled = np.zeros(max(count, 0), np.uint64)
    for i in range(n if count > 0 else 0):
        rolled += hashes[i : i + count] * step[i]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * step[: b - a]).sum(keepdims=True)))
        else:
            out.append(hashes[:0])
    return out


def list_array(values: np.ndarray, lengths: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array from the values of all rows and the length of each."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
