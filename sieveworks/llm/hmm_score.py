"""Language-model scoring: a unigram base and a hidden Markov model trained by Baum-Welch.

Tokens are the words of the text (runs of other than ASCII white space, A-Z lower-cased)
and one end. The model's symbols are the end, the most frequent training words, and classes of all
other words by their ending; a word of a class is drawn from the class by its smoothed
count. Each round of Baum-Welch sums expected counts over all training texts, partition
by partition; scoring runs the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.llm.bytetext import list_array
from sieveworks.sources.storage import written

#: Word symbols of the model, classes of other words, hidden states, rounds of Baum-Welch.
SYMBOL_WORDS, CLASSES, STATES, ROUNDS = 4096, 64, 8, 4
#: The most words whose counts go to the tasks; all others meet theirs in a join. None is longer than so many bytes.
NEAR_WORDS, NEAR_BYTES = 65_536, 64
#: Tokens of a run: longer texts are worked on in runs side by side, with what the other runs say of their ends.
RUN_TOKENS = 512
#: Tokens whose forward vectors are held at a time.
GROUP_TOKENS = 300_000
#: Smoothing of counts, as in the base score.
ADDED = 0.1
#: The end token among the words; no word is empty.
END = ""
_FLUSH_WORDS = 300_000
#: Steps after which products are scaled; no probability of a step is under 1e-12 or so.
_SCALED_STEPS = 16


def text_words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _class_of(word: bytes) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % CLASSES


def _class_column(word):
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % CLASSES


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*total], pa.binary()).cast(pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch["text"]:
            total.update(text_words(text.as_py()))
            total[END.encode()] += 1
            if len(total) > _FLUSH_WORDS:
                yield out()
                total.clear()
    yield out()


@dataclass
class Lexicon:
    """Totals of the training tokens and the counts of the frequent words."""

    tokens: int
    kinds: int
    near: dict[bytes, int]
    near_counts: np.ndarray
    #: Words (with the end) that are symbols, and the last of them in the order of (count, word).
    symbols: int
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    @property
    def size(self) -> int:
        return self.symbols + CLASSES

    def base(self, count):
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.kinds + 1)))

    def in_class(self, count, which):
        return np.log10((count + ADDED) / (self.class_tokens[which] + ADDED * (self.class_kinds[which] + 1)))


def _most_frequent(counts: DataFrame, most: int | None = None) -> list:
    """Words with the largest counts, at most ``most`` (NEAR_WORDS), in the order of (count down, word).

    Counts are binned by their logarithm, some hundred bins whatever the corpus; whole
    bins are taken from above while they fit. Only what is taken reaches the driver.
    """
    most = NEAR_WORDS if most is None else most
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, taken = None, 0
    for r in bins.orderBy(F.desc("bin")).collect():
        taken += r["words"]
        if taken > most:
            break
        least = r["least"]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


def count_words(docs: DataFrame) -> tuple[DataFrame, Lexicon]:
    """The counts of all training words, written, and what the tasks need of them."""
    counts = written(bounded(docs).select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    top = _most_frequent(counts.where((F.octet_length("word") <= NEAR_BYTES) & (F.col("word") != END)))
    ends = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    # the end comes first and is a symbol whatever its count
    near = {END.encode(): 0} | {r["word"].encode(): i for i, r in enumerate(top, 1)}
    symbols = 1 + min(SYMBOL_WORDS, len(top))
    rest = counts.where(F.col("word") != END)
    if symbols > 1:
        last = top[symbols - 2]
        is_symbol = (F.octet_length("word") <= NEAR_BYTES) & ((F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") <= last["word"])))
        rest = rest.where(~is_symbol)
    class_tokens, class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy(_class_column(F.col("word")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        class_tokens[r["class"]], class_kinds[r["class"]] = r["n"], r["kinds"]
    return counts, Lexicon(tokens or 0, kinds, near, np.array([ends, *(r["n"] for r in top)], np.float64), symbols, class_tokens, class_kinds)


def _encode(lexicon: Lexicon):
    """Texts to symbols, the sums over their frequent words, and the words that aren't among these with their numbers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = lexicon.near
        classes = np.array([lexicon.symbols + _class_of(w) for w in near])
        symbol_of = np.where(np.arange(len(near)) < lexicon.symbols, np.arange(len(near)), classes)
        base_of = lexicon.base(lexicon.near_counts)
        class_part = np.where(symbol_of < lexicon.symbols, 0, lexicon.in_class(lexicon.near_counts, np.maximum(symbol_of - lexicon.symbols, 0)))
        class_of = functools.lru_cache(200_000)(_class_of)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [[*text_words(t), END.encode()] for t in part["text"].to_pylist()]
                lengths = np.array([len(w) for w in texts])
                text_of = np.repeat(np.arange(len(texts)), lengths)
                at = np.fromiter(map(near.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(lengths.sum()))
                far = np.flatnonzero(at < 0)
                starts = np.cumsum(lengths) - lengths
                far_words = [texts[i][j] for i, j in zip(text_of[far].tolist(), (far - starts[text_of[far]]).tolist())]
                symbols = symbol_of[at]
                symbols[far] = lexicon.symbols + np.array([class_of(w) for w in far_words], np.int64)
                known = at >= 0
                sums = [np.bincount(text_of, np.where(known, values[at], 0), len(texts)) for values in (base_of, class_part, lexicon.near_counts > 0)]
                groups = [Counter() for _ in texts]
                for i, w in zip(text_of[far].tolist(), far_words):
                    groups[i][w] += 1
                sizes = [len(g) for g in groups]
                words = pa.array([w for g in groups for w in g], pa.binary()).cast(pa.string())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(texts))), part["doc_id"], part["held_out"], pa.array(lengths), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), list_array(symbols.astype(np.int16), lengths, pa.int16()), pa.ListArray.from_arrays(offsets, words), list_array(np.array([n for g in groups for n in g.values()], np.int32), sizes, pa.int32())],
                    ["key", "doc_id", "held_out", "n_tokens", "near_base", "near_class", "near_known", "symbols", "far_words", "far_numbers"],
                )
                key += len(texts)

    return make


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def random(states: int, symbols: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) ** 8 + 0.02)
        return Model(share(states), share(states, states), share(states, symbols))

    @staticmethod
    def from_counts(counts: np.ndarray, states: int) -> Model:
        """From a row a state of (starts, moves to each state, emissions of each symbol), smoothed."""
        counts = counts + 0.01
        share = lambda x: x / x.sum(-1, keepdims=True)
        return Model(share(counts[:, 0]), share(counts[:, 1 : 1 + states]), share(counts[:, 1 + states :]))


class Sequences:
    """Symbol sequences side by side, longest first; ``active[t]`` of them have a token at t."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths, self.flat = starts[self.order], lengths[self.order], flat
        self.active = np.searchsorted(-self.lengths, -np.arange(int(self.lengths[0]) if len(lengths) else 0), "left")

    def at(self, t: int) -> np.ndarray:
        return self.flat[self.starts[: self.active[t]] + t]


def log_likelihoods(model: Model, sequences: Sequences) -> np.ndarray:
    """log10 of the probability of each sequence, in the order given, by the scaled forward recursion."""
    total = np.zeros(len(sequences.lengths))
    onward = np.ascontiguousarray(model.move.T)
    state = np.zeros((len(model.start), 0))
    for t, n in enumerate(sequences.active):
        state = (model.start[:, None] if t == 0 else onward @ state[:, :n]) * model.emit[:, sequences.at(t)]
        scale = state.sum(0)
        state /= scale
        total[:n] += np.log10(scale)
    out = np.zeros(len(total))
    out[sequences.order] = total
    return out


def _run_tables(model: Model, sequences: Sequences) -> np.ndarray:
    """The product of transition and emission matrices over each sequence, in the order given, scaled: only proportions count."""
    states, count = len(model.start), len(sequences.lengths)
    onward = np.ascontiguousarray(model.move.T)
    out = np.zeros((states, states, count))
    # the state reached, the state in front, the sequence
    now = np.repeat(np.eye(states)[:, :, None], count, 2)
    for t, n in enumerate(sequences.active):
        if n < now.shape[2]:
            out[:, :, n : now.shape[2]] = now[:, :, n:]
            now = now[:, :, :n]
        now = (onward @ now.reshape(states, -1)).reshape(states, states, n) * model.emit[:, None, sequences.at(t)]
        if t % _SCALED_STEPS == 0:
            now /= now.sum((0, 1))
    out[:, :, : now.shape[2]] = now
    ordered = np.empty((count, states, states))
    ordered[sequences.order] = out.transpose(2, 1, 0)
    return ordered / ordered.sum((1, 2), keepdims=True)


def _ends(model: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of texts cut into runs (``first`` marks the first of each): the distribution of the state before it, and how well each of its last states explains what follows, up to a factor."""
    states = len(model.start)
    before, after = np.zeros((len(first), states)), np.ones((len(first), states))
    inner = np.flatnonzero(~first)
    if not len(inner):
        return before, after
    tables = np.zeros((len(first), states, states))
    for low in range(0, len(inner), 2000):
        some = inner[low : low + 2000]
        tables[some] = _run_tables(model, Sequences(flat, starts[some], lengths[some]))
    # the first run of a text is a token with the start distribution in place of a move, and the rest
    heads = inner[first[inner - 1]] - 1
    seen = model.start * model.emit.T[flat[starts[heads]]]
    leaving = {}
    for low in range(0, len(heads), 2000):
        some = heads[low : low + 2000]
        rest = _run_tables(model, Sequences(flat, starts[some] + 1, lengths[some] - 1))
        leaving.update(zip(some.tolist(), np.einsum("ni,nij->nj", seen[low : low + 2000], rest)))
    for i in inner.tolist():
        state = leaving[i - 1] if first[i - 1] else before[i - 1] @ tables[i - 1]
        before[i] = state / state.sum()
    for i in inner[::-1].tolist():
        later = tables[i] @ after[i]
        after[i - 1] = later / later.sum()
    return before, after


def expected_counts(model: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, run_tokens: int | None = None) -> np.ndarray:
    """Per state: expected starts, moves and emissions of whole symbol sequences (forward-backward).

    Sequences longer than ``run_tokens`` (RUN_TOKENS) are worked on in runs side by side.
    The states at the ends of each run follow from the matrix products of all runs of its
    sequence, so the counts are those of the whole sequence, moves across the cuts included.
    """
    size = RUN_TOKENS if run_tokens is None else run_tokens
    runs = -(-lengths // size)
    number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    run_starts = np.repeat(starts, runs) + number * size
    run_lengths = np.minimum(np.repeat(lengths, runs) - number * size, size)
    first = number == 0
    before, after = _ends(model, flat, run_starts, run_lengths, first)
    out = np.zeros((len(model.start), 1 + len(model.start) + model.emit.shape[1]))
    # runs of like length go together
    order = np.argsort(run_lengths, kind="stable")
    group = np.cumsum(run_lengths[order]) // GROUP_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        out += _run_counts(model, Sequences(flat, run_starts[part], run_lengths[part]), first[part], before[part], after[part])
    return out


def _run_counts(model: Model, sequences: Sequences, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """:func:`expected_counts` of runs whose ends are known. States are rows here, runs columns."""
    states, symbols = model.emit.shape
    first, before, after = first[sequences.order], before[sequences.order].T, after[sequences.order].T
    onward = np.ascontiguousarray(model.move.T)
    forward, ratios, seen = [], [], []
    for t, n in enumerate(sequences.active):
        seen.append(sequences.at(t))
        shown = model.emit[:, seen[-1]]
        state = (np.where(first, model.start[:, None], onward @ before) if t == 0 else onward @ forward[-1][:, :n]) * shown
        scale = 1 / state.sum(0)
        forward.append(state * scale)
        ratios.append(shown * scale)
    out = np.zeros((states, 1 + states + symbols))
    moves = np.zeros((states, states))
    backward = ahead = np.zeros((states, 0))
    shares = []
    for t in range(len(forward) - 1, -1, -1):
        n, m = forward[t].shape[1], backward.shape[1]
        later = np.empty((states, n))
        # of the runs that end here, scaled so that the shares of the states sum to 1
        later[:, m:] = after[:, m:n] / (forward[t][:, m:] * after[:, m:n]).sum(0)
        if m:
            moves += forward[t][:, :m] @ ahead.T
            later[:, :m] = model.move @ ahead
        backward = later
        ahead = ratios[t] * backward
        shares.append(forward[t] * backward)
    if shares:
        out[:, 0] = shares[-1][:, first].sum(1)
        moves += before[:, ~first] @ ahead[:, ~first].T
        share, symbol = np.concatenate(shares, 1), np.concatenate(seen[::-1])
        for k in range(states):
            out[k, 1 + states :] = np.bincount(symbol, share[k], symbols)
    out[:, 1 : 1 + states] = moves * model.move
    return out


def _symbol_batches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch["symbols"]
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(), offsets[:-1], np.diff(offsets)


def train(encoded: DataFrame, symbols: int, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """A model from all texts of ``encoded`` (symbols) that aren't held out.

    Every partition sums its expected counts; Spark sums them over the partitions, and one
    number for each state and symbol reaches the driver.
    """
    model = Model.random(states, symbols)
    texts = encoded.where("not held_out").select("symbols")
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, 1 + states + symbols))
            for batch in batches:
                total += expected_counts(model, *_symbol_batches(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(states)), pa.array(list(total), pa.list_(pa.float64()))], ["state", "counts"])

        parts = texts.mapInArrow(partial, "state long, counts array<double>").select("state", F.posexplode("counts").alias("place", "n")).where("n > 0")
        counts = np.zeros((states, 1 + states + symbols))
        for r in parts.groupBy("state", "place").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["state"], r["place"]] = r["n"]
        model = Model.from_counts(counts, states)
    return model


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column of ``docs``; words and model are learned from the
    other rows. n_known counts tokens that occur in training, train_tokens all training
    tokens. base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens;
    score is the model's log10 probability of the text, end included.

    A null text is an empty one, whose only token is the end. Rows are scored one by one:
    repeated rows and ids give repeated results. Other columns aren't read. An empty table
    gives an empty result; without training rows all counts are 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, lexicon = count_words(rows.where("not held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = written(rows.mapInArrow(_encode(lexicon), f"key long, doc_id {kind}, held_out boolean, n_tokens long, near_base double, near_class double, near_known long, symbols array<short>, far_words array<string>, far_numbers array<int>"))
    model = train(encoded, lexicon.size, states, rounds)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likelihoods = log_likelihoods(model, Sequences(*_symbol_batches(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(likelihoods) if c == "symbols" else batch[c] for c in batch.schema.names], [*batch.schema.names[:-1], "likelihood"])

    near = encoded.select("key", "doc_id", "held_out", "n_tokens", "near_base", "near_class", "near_known", "symbols")
    scored = near.mapInArrow(forward, f"key long, doc_id {kind}, held_out boolean, n_tokens long, near_base double, near_class double, near_known long, likelihood double")

    # no word outside the frequent ones is a hot key of this join
    far = encoded.select("key", F.explode(F.arrays_zip("far_words", "far_numbers")).alias("far")).select("key", F.col("far.far_words").alias("word"), F.col("far.far_numbers").alias("times"))
    far = far.join(counts, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"), _class_column(F.col("word")).alias("class"))
    denominators = F.array(*(F.lit(float(lexicon.class_tokens[i] + ADDED * (lexicon.class_kinds[i] + 1))) for i in range(CLASSES)))
    of_class = F.log10((F.col("n") + ADDED) / F.element_at(denominators, (F.col("class") + 1).cast("int")))
    of_all = F.log10((F.col("n") + ADDED) / F.lit(float(lexicon.tokens + ADDED * (lexicon.kinds + 1))))
    sums = far.groupBy("key").agg(F.sum(F.col("times") * of_all).alias("far_base"), F.sum(F.col("times") * of_class).alias("far_class"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("far_known"))
    nothing = F.lit(0.0)
    return scored.join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("near_base") + F.coalesce("far_base", nothing)).alias("base_score"),
        (F.col("likelihood") + F.col("near_class") + F.coalesce("far_class", nothing)).alias("score"),
    )
