"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter gram is bound from the
vectors of its letters, rotated by their place; a text is the bundle (sum) of its grams,
and a language the bundle of its training texts. A text takes the language whose profile
has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.bytetext import byte_slices

UNDETERMINED = "und"
_SPACE, _CODE_POINTS, _CHUNK = 32, 0x110000, 8192


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(_CODE_POINTS)])


@functools.lru_cache(100_000)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


class Grams:
    """The three-letter grams of a run of texts: ``codes`` of the distinct ones, the gram and the text of each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
        edges = starts[offsets]
        # every text stands between two spaces; what isn't a letter is a space, and runs of spaces are one
        letters = np.insert(np.where(_is_letter()[points], points, _SPACE), edges, _SPACE)
        keep = letters != _SPACE
        keep[1:] |= letters[:-1] != _SPACE
        keep[0] = True
        edges = (np.cumsum(keep) - 1)[edges + np.arange(len(edges))]
        letters = letters[keep]
        self.texts, self.lettered = len(edges) - 1, np.diff(edges) > 0
        present = np.zeros(_CODE_POINTS, bool)
        present[letters] = True
        self.alphabet = np.flatnonzero(present)
        rank = np.zeros(_CODE_POINTS, np.int64)
        rank[self.alphabet] = np.arange(len(self.alphabet))
        letters, size = rank[letters], len(self.alphabet)
        gram = (letters[:-2] * size + letters[1:-1]) * size + letters[2:]
        within = np.ones(len(gram), bool)
        within[edges[(edges > 0) & (edges <= len(gram))] - 1] = False
        place = np.flatnonzero(within)
        gram, self.text = gram[place], np.searchsorted(edges, place, "right") - 1
        if size**3 <= 1 << 24:
            seen = np.zeros(size**3, bool)
            seen[gram] = True
            self.codes = np.flatnonzero(seen)
            order = np.zeros(size**3, np.int64)
            order[self.codes] = np.arange(len(self.codes))
            self.gram = order[gram]
        else:
            self.codes, self.gram = np.unique(gram, return_inverse=True)

    def vectors(self, low: int, high: int, dimensions: int) -> np.ndarray:
        """The bound vectors of the distinct grams ``low`` to ``high``."""
        size = len(self.alphabet)
        letter = np.stack([_letter_vector(int(c), dimensions) for c in self.alphabet])
        codes = self.codes[low:high]
        return np.roll(letter, 2, 1)[codes // size**2] * np.roll(letter, 1, 1)[codes // size % size] * letter[codes % size]

    def bundles(self, owner: np.ndarray, owners: int, dimensions: int) -> np.ndarray:
        """The sums of the gram vectors of each owner of texts; an owner below 0 is left out."""
        out = np.zeros((owners, dimensions))
        whose, gram = owner[self.text], self.gram
        if (whose < 0).any():
            gram, whose = gram[whose >= 0], whose[whose >= 0]
        if len(self.codes) > _CHUNK:
            order = np.argsort(gram, kind="stable")
            gram, whose = gram[order], whose[order]
        for low in range(0, len(self.codes), _CHUNK):
            high = min(low + _CHUNK, len(self.codes))
            a, b = np.searchsorted(gram, (low, high)) if len(self.codes) > _CHUNK else (0, len(gram))
            counts = np.bincount(whose[a:b] * (high - low) + gram[a:b] - low, minlength=owners * (high - low))
            out += counts.reshape(owners, high - low).astype(np.float32) @ self.vectors(low, high, dimensions).astype(np.float32)
        return out


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, Grams]]:
    for a, b, data, offsets in byte_slices(texts, 1_500_000, 600):
        yield a, b, Grams(data, offsets)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = 1024) -> dict[str, np.ndarray]:
    """language -> profile, from all texts that have a language.

    Each partition bundles its own texts; the partial profiles are summed by Spark, and
    one vector of ``dimensions`` numbers for each distinct language reaches the driver.
    Null texts and texts without letters teach nothing.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds, owner = np.unique(batch["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for a, b, grams in _grams(batch["text"]):
                for kind, vector in zip(kinds, grams.bundles(owner[a:b], len(kinds), dimensions)):
                    sums[kind] = sums.get(kind, 0) + np.rint(vector)
        for kind, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([vector])], ["lang", "vector"])

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    parts = bounded(known).mapInArrow(partial, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "value"))
    profiles: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toLocalIterator():
        profiles.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["value"]
    return {k: v for k, v in sorted(profiles.items()) if v.any()}


def identify(docs: DataFrame, profiles: Mapping[str, np.ndarray], text_col: str = "text", lang_pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its cosine (0 to 1) added.

    A null text, a text without letters, and any text where no language was learned gets
    ``und`` and 0. Of equal cosines the first language in alphabetical order wins. Only
    the text is looked at. The columns that are added must be new ones.
    """
    names = [*profiles]
    table = np.stack([profiles[k] / np.linalg.norm(profiles[k]) for k in names]) if names else np.zeros((0, 1))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            for a, b, grams in _grams(batch[text_col]) if names else ():
                vectors = grams.bundles(np.arange(grams.texts), grams.texts, table.shape[1])
                norm = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ table.T / np.maximum(norm, 1e-9)[:, None]
                top = cosine.argmax(1)
                best[a:b] = np.where(grams.lettered, np.array(names, object)[top], UNDETERMINED)
                score[a:b] = np.where(grams.lettered, cosine[np.arange(b - a), top].clip(0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], [*batch.schema.names, lang_pred_col, score_col])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return bounded(docs).mapInArrow(predict, f"{columns}, `{lang_pred_col}` string, `{score_col}` double")


def _size_bin(text_col: str):
    """The binary logarithm of a text's length."""
    return F.floor(F.log2(F.greatest(F.length(text_col), F.lit(1)))).cast("int")


def usual_scores(identified: DataFrame, lang_col: str = "lang", lang_pred_col: str = "lang_pred", score_col: str = "score", text_col: str = "text", deviations: float = 6.0):
    """A column: the score that no text of a learned language is expected to fall under, given its length; 0 where nothing is known.

    Mean and deviation are those of all texts that got their own language, by the binary
    logarithm of the length, some forty numbers whatever the corpus; the deviation of a
    length is at least that of all lengths together. Short texts have low and scattered
    scores, so the limit of the shortest lies below 0.
    """
    right = identified.where(F.col(lang_col) == F.col(lang_pred_col)).groupBy(_size_bin(text_col).alias("bin"))
    rows = right.agg(F.count("*").alias("n"), F.avg(score_col).alias("mean"), F.var_pop(score_col).alias("variance")).collect()
    if not rows:
        return F.lit(0.0)
    pooled = sum(r["n"] * r["variance"] for r in rows) / sum(r["n"] for r in rows)
    limits = {r["bin"]: float(r["mean"] - deviations * max(r["variance"], pooled) ** 0.5) for r in rows}
    column = F.lit(0.0)
    for least in sorted(limits):
        # a length without texts has the limit of the next shorter one
        column = F.when(_size_bin(text_col) >= least, F.lit(limits[least])).otherwise(column)
    return column


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
