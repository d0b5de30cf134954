"""SentencePiece encoding and decoding by a Viterbi search over batches of words.

Words of equal length advance together: at each place the hashes of their next substrings
probe the sorted keys of the vocabulary's pieces, and vectorised maxima keep the best
score and the piece that led there.

A BPE model holds merge ranks in place of log-probabilities. Ranks follow frequency, so
a piece of rank r gets the score -log(r + 300) of a Zipf-Mandelbrot law; a unigram model's
scores are taken as they are. On such a model the pieces are the best by that score, not
those that replaying the merges gives.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.bytetext import list_array, mixed

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Added to the ranks of a BPE model.
RANK_SHIFT = 300
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words whose pieces a Python worker keeps.
_KEPT_WORDS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id: text (None: no ordinary piece), score, bytes when decoded; and the ids of the 256 byte pieces."""

    name: str
    texts: tuple
    scores: tuple
    decoded: tuple
    byte_ids: tuple


def load_vocabulary(model: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a model file, read on the driver; it goes to the executors with the tasks (about 1 MB for 32,000 pieces)."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=model)
    count = reader.get_piece_size()
    raw = [reader.id_to_piece(i) for i in range(count)]
    plain = [not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) or reader.is_unused(i)) for i in range(count)]
    byte_ids = {int(raw[i][3:-1], 16): i for i in range(count) if reader.is_byte(i)}
    if len(byte_ids) < 256:
        raise ValueError("the model has no byte pieces")
    scores = [reader.get_score(i) for i in range(count)]
    numbers = [s for s, p in zip(scores, plain) if p]
    if all(float(s).is_integer() for s in numbers):
        scores = [-float(np.log(RANK_SHIFT - s)) for s in [min(0.0, s) for s in scores]]
    decoded = [x.replace(SPACE, " ").encode() if p else b"" for x, p in zip(raw, plain)]
    for byte, i in byte_ids.items():
        decoded[i] = bytes([byte])
    # pieces hold plain spaces from here on: a text with the space mark itself spells it in bytes, and it comes back
    return Vocabulary(model, tuple(x.replace(SPACE, " ") if p else None for x, p in zip(raw, plain)), tuple(scores), tuple(decoded), tuple(byte_ids[b] for b in range(256)))


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


class Encoder:
    """Sorted substring keys of a vocabulary, by length, and the search over them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        ids: dict[str, int] = {}
        for i, text in enumerate(vocabulary.texts):
            if text:
                ids.setdefault(text, i)
        self.scores = np.array(vocabulary.scores)
        self.unknown = min(self.scores[list(ids.values())], default=0) - 10
        by_length: dict[int, dict[str, int]] = {}
        for text, i in ids.items():
            for n in range(1, len(text)):
                by_length.setdefault(n, {}).setdefault(text[:n], -1)
            by_length.setdefault(len(text), {})[text] = i
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, max(by_length, default=0) + 1):
            parts = by_length.get(n, {})
            points = _points(list(parts), n)
            h = np.zeros(len(parts), np.uint64)
            for j in range(n):
                h = mixed(h * _STEP + points[:, j] + np.uint64(1))
            order = np.argsort(h)
            self.keys.append((h[order], np.array(list(parts.values()), np.int64)[order]))
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def search(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words of one length, one word after another, and how many each has; of equal scores the one with the longer last piece stays."""
        points = _points(words, length)
        count = len(words)
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0
        back = np.ones((length + 1, count), np.int16)
        piece = np.full((length + 1, count), -1, np.int32)
        for i in range(length):
            unknown = best[i] + self.unknown
            better = unknown > best[i + 1]
            best[i + 1][better], back[i + 1][better], piece[i + 1][better] = unknown[better], 1, -1
            rows, h = np.arange(count), np.zeros(count, np.uint64)
            for n, (keys, ids) in enumerate(self.keys[: length - i], 1):
                h = mixed(h * _STEP + points[rows, i + n - 1] + np.uint64(1))
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                there = keys[at] == h
                rows, h, found = rows[there], h[there], ids[at[there]]
                if not len(rows):
                    break
                whole = found >= 0
                who, what = rows[whole], found[whole]
                score = best[i, who] + self.scores[what]
                better = score > best[i + n, who]
                who, what = who[better], what[better]
                best[i + n, who], back[i + n, who], piece[i + n, who] = score[better], n, what
        place, row = np.full(count, length), np.arange(count)
        taken, owner = [], []
        while len(row):
            taken.append(np.stack([piece[place, row], place]))
            owner.append(row)
            place = place - back[place, row]
            row, place = row[place > 0], place[place > 0]
        taken, owner = np.concatenate(taken[::-1], 1), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        ids, ends, owner = taken[0][order], taken[1][order], owner[order]
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            spelled = [words[w][e - 1].encode() for w, e in zip(owner[strange].tolist(), ends[strange].tolist())]
            sizes = np.ones(len(ids), np.int64)
            sizes[strange] = [len(x) for x in spelled]
            ids, owner = np.repeat(ids, sizes), np.repeat(owner, sizes)
            ids[ids < 0] = np.array(self.vocabulary.byte_ids)[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(owner, minlength=count)

    def learn(self, words: set[str]) -> None:
        """Add the pieces of new words to the table."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        flat, starts = [self.flat], [self.starts]
        for length, group in by_length.items():
            step = max(1, 400_000 // (length + 1))
            for a in range(0, len(group), step):
                ids, sizes = self.search(group[a : a + step], length)
                self.index.update(zip(group[a : a + step], range(len(self.index), len(self.index) + len(sizes))))
                flat.append(ids.astype(np.int32))
                starts.append(starts[-1][-1] + np.cumsum(sizes))
        self.flat, self.starts = np.concatenate(flat), np.concatenate(starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, one after another, and how many each text has."""
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > _KEPT_WORDS:
            self.reset()
        self.learn(set().union(*split).difference(self.index))
        at = np.array([x for words in split for x in map(self.index.__getitem__, words)], np.int64)
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], np.cumsum([len(words) for words in split])])
        return flat, np.diff(np.concatenate([[0], ends])[cuts])


_WORD = re.compile(r" *[^ \n]+|\n| +")
@functools.lru_cache(1)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def encode_batches(vocabulary: Vocabulary, text_col: str, ids_col: str):
    """A function from batches with a text to the same with its piece ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, text_col):
                texts = part[text_col].to_pylist()
                ids, lengths = encoder.encode([t or "" for t in texts])
                out = list_array(ids, lengths, pa.int32())
                if part[text_col].null_count:
                    out = pa.array([None if t is None else x for t, x in zip(texts, out)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, ids_col])

    return make


def decode_batches(vocabulary: Vocabulary, ids_col: str, decoded_col: str, most_ids: int = 500_000):
    """A function from batches with piece ids to the same with the text that they spell."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = np.array(vocabulary.decoded, object)
        for batch in batches:
            ids = batch[ids_col]
            flat, cuts, absent = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_null().to_pylist()
            texts: list[str | None] = []
            while len(texts) < batch.num_rows:
                first = len(texts)
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + most_ids, "right")) - 1)
                parts = spelled[flat[cuts[first] : cuts[last]]].tolist()
                for row in range(first, last):
                    text = b"".join(parts[cuts[row] - cuts[first] : cuts[row + 1] - cuts[first]]).decode(errors="replace")
                    # the space before the text goes
                    texts.append(None if absent[row] else text.removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, decoded_col])

    return make


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``: the pieces of the whole text with the largest sum of scores.

    A space is put before a text, as the model's own encoder does; characters outside the
    vocabulary are spelled in byte pieces. A null text has null ids, an empty one none.
    ``ids_col`` must be a new column.
    """
    return bounded(docs).mapInArrow(encode_batches(load_vocabulary(model), text_col, ids_col), f"{_columns(docs)}, `{ids_col}` array<int>")


def decode(tokens: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and the text that ``ids`` spell; null ids give null, none an empty text.

    Bytes that aren't UTF-8, which no encoded text gives, become replacement characters.
    ``decoded_col`` must be a new column.
    """
    return bounded(tokens).mapInArrow(decode_batches(load_vocabulary(model), ids_col, decoded_col), f"{_columns(tokens)}, `{decoded_col}` string")


def round_trip(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, same): the ids of every text and whether decoding them gives the text again.

    A null text has null ids and counts as the same. Encoding and decoding run in one
    task, so that the ids cross to the JVM once.
    """
    vocabulary = load_vocabulary(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = decode_batches(vocabulary, "ids", "decoded")(encode_batches(vocabulary, "text", "ids")(batches))
        for batch in both:
            same = pc.fill_null(pc.equal(batch["text"].cast(pa.string()), batch["decoded"]), True)
            counts = pc.list_value_length(batch["ids"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], counts, same], ["doc_id", "ids", "n_tokens", "same"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return bounded(rows).mapInArrow(make, f"doc_id {kind}, ids array<int>, n_tokens long, same boolean")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _slices(batch: pa.RecordBatch, text_col: str, most_bytes: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about so much text, so that many words of one length come together."""
    sizes = np.cumsum([len(t) + 50 if t else 50 for t in batch[text_col].to_pylist()])
    cuts = np.flatnonzero(np.diff(sizes // most_bytes, prepend=0)) if len(sizes) else []
    bounds = sorted({0, *map(int, cuts), batch.num_rows})
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield batch.slice(a, b - a)
