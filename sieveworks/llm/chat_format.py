"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

The hidden states are the first and the further lines of a turn, for each role. A line
shows a speaker marker or none, its length, and how it ends. Probabilities come from
labelled turns; Viterbi's best path over all lines of a transcript gives turns and roles.

A conversation of many turns lies in several parts, and its best path is still that of all
its lines: every part is summed up as the best score from each state before it to each of
its last states, these tables multiply (with + and max), and what they leave open inside a
part is searched for with the states at both its ends known.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded
from sieveworks.sources.storage import written

ROLES = ("system", "user", "assistant")
_ALIASES = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "prompter": "user", "question": "user", "q": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "chatbot": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant",
}
#: Words that also begin lines of content; a marker of one of these is an observation of its own.
_WEAK = frozenset("context customer question q model agent answer a".split())
_MARKER = re.compile(rf"\s*(?:#{{1,6}}\s*|>\s*|<\|)?[*_\[]*({'|'.join(sorted(_ALIASES, key=lambda x: (-len(x), x)))})[*_\]]*(?:\|>|\s*:)[*_]*[ \t]?", re.IGNORECASE)
#: States: the first line of a turn of each role, then the further lines.
STATES = 2 * len(ROLES)
#: Kinds of each observed feature: marker (none, of a role, weakly of a role), length, ending.
KINDS = (1 + 2 * len(ROLES), 6, 4)
#: Turns of a conversation in one part.
PART_TURNS = 512
#: The row of a part's table for a path that begins with the part.
BEGIN = STATES
#: What is trimmed from the ends of a turn.
BLANK = " \t\n\r\f\v"


def marker_of(line: str) -> tuple[int, int]:
    """(0 for none or the role's number from 1 on, weak markers after the others; characters that the marker takes)."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    name = m[1].lower()
    return 1 + ROLES.index(_ALIASES[name]) + (name in _WEAK) * len(ROLES), m.end()


def observe(lines: list[str]) -> np.ndarray:
    """The features of each line."""
    out = np.zeros((len(lines), len(KINDS)), np.int64)
    for i, line in enumerate(lines):
        marker, taken = marker_of(line)
        body = line[taken:].strip()
        length = min(KINDS[1] - 1, len(body).bit_length() // 2) if body else 0
        ending = 3 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!…\"”" else 0
        out[i] = marker, length, ending
    return out


@dataclass
class ChatModel:
    """Log probabilities: of the first state, of moves, and of each feature's kinds by state."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @staticmethod
    def from_counts(counts: np.ndarray) -> ChatModel:
        """From counts in the layout of :func:`count`, above a weak belief in markers and in turns that alternate."""
        size = len(ROLES)
        start, move, *emit = _parts(counts.astype(float) + 0.05)
        first, further = np.arange(size), np.arange(size, 2 * size)
        start[first] += 1
        start[further] = 1e-9
        # further lines follow a line of their own role
        move[first, further] += 2
        move[further, further] += 2
        for a, b in (("system", "user"), ("user", "assistant"), ("assistant", "user")):
            move[[ROLES.index(a), ROLES.index(a) + size], ROLES.index(b)] += 1
        for i in first:
            for j in further:
                if j - size != i:
                    move[i, j] = move[i + size, j] = 1e-9
        emit[0][first, 1 + first] += 5
        emit[0][first, 1 + size + first] += 2
        emit[0][further, 0] += 5
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return ChatModel(log(start), log(move), [log(x) for x in emit])

    def _shown(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, i]] for i, table in enumerate(self.emit)).T

    def viterbi(self, seen: np.ndarray, entry: int = BEGIN, last: int = -1) -> np.ndarray:
        """The most probable states after the state ``entry`` and, where ``last`` isn't negative, with that one at the end; of equal ones the first in order."""
        if not len(seen):
            return np.zeros(0, np.int64)
        shown = self._shown(seen)
        best, back = (self.start if entry == BEGIN else self.move[entry]) + shown[0], np.zeros((len(seen), STATES), np.int64)
        for t in range(1, len(seen)):
            paths = best[:, None] + self.move
            back[t] = paths.argmax(0)
            best = paths[back[t], np.arange(STATES)] + shown[t]
        out = np.zeros(len(seen), np.int64)
        out[-1] = best.argmax() if last < 0 else last
        for t in range(len(seen) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def table(self, seen: np.ndarray) -> np.ndarray:
        """The best score of a path over the lines from each state before them, or from the beginning (last row), to each state of the last."""
        shown = self._shown(seen)
        out = np.vstack([self.move, self.start]) + shown[0]
        for row in shown[1:]:
            out = _joined(out, self.move) + row
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The table of two parts, one after the other."""
    return (a[:, :, None] + b[None, :STATES]).max(1)


def _between(tables: list[np.ndarray], entry: int, last: int) -> list[int]:
    """The last state of each part on the best path over all of them."""
    best, back = tables[0][entry], []
    for table in tables[1:]:
        paths = best[:, None] + table[:STATES]
        back.append(paths.argmax(0))
        best = paths.max(0)
    out = [int(best.argmax()) if last < 0 else last]
    for row in reversed(back):
        out.append(int(row[out[-1]]))
    return out[::-1]


_SIZE = STATES + STATES**2 + STATES * sum(KINDS)


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    shapes = [(STATES,), (STATES, STATES), *((STATES, k) for k in KINDS)]
    out, at = [], 0
    for shape in shapes:
        out.append(flat[at : at + int(np.prod(shape))].reshape(shape).copy())
        at += int(np.prod(shape))
    return out


def _count(total: list[np.ndarray], seen: np.ndarray, states: np.ndarray) -> None:
    """Add the moves and features of lines whose state is known, one after another."""
    both = (states[:-1] >= 0) & (states[1:] >= 0)
    np.add.at(total[1], (states[:-1][both], states[1:][both]), 1)
    known = states >= 0
    for i, table in enumerate(total[2:]):
        np.add.at(table, (states[known], seen[known, i]), 1)


def pieces(lines: list[str], seen: np.ndarray, states: np.ndarray, begins: bool) -> list[tuple[bool, str, list[str], int]]:
    """(whether a turn starts, role, lines, number of the first line) of each run of lines of one turn; markers go where they name the role that the path gives their line."""
    out: list[tuple[bool, str, list[str], int]] = []
    for i, (line, (marker, *_), state) in enumerate(zip(lines, seen.tolist(), states.tolist())):
        role = state % len(ROLES)
        starts = state < len(ROLES) or begins and not i
        if starts or not out:
            out.append((starts, ROLES[role], [line[marker_of(line)[1] :] if starts and marker in (role + 1, role + 1 + len(ROLES)) else line], i))
        else:
            out[-1][2].append(line)
    return out


def parse(text: str | None, model: ChatModel) -> list[tuple[str, str]]:
    """(role, text) of the turns of a whole transcript."""
    if not text:
        return []
    lines = text.split("\n")
    seen = observe(lines)
    return [(role, "\n".join(body)) for _, role, body, _ in pieces(lines, seen, model.viterbi(seen), True)]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical text: every turn as <|role|>, a line break, its trimmed text and <|end|>."""
    return "\n".join(f"<|{role}|>\n{text.strip(BLANK)}\n<|end|>" for role, text in turns)


def plain_marker(conv: int | None, turn: int | None, role: str | None) -> str:
    """``role: `` before every turn that has a role."""
    return f"{role}: " if role else ""


def varied_marker(conv: int | None, turn: int | None, role: str | None) -> str:
    """One of several ways of writing a marker, the same in all of a conversation; a quarter of the turns have none."""
    name = (role or "").strip().lower()
    if name not in _ALIASES or zlib.crc32(f"{conv}/{turn}".encode()) % 4 == 0:
        return ""
    other = {"system": "Instruction", "user": "Human", "assistant": "AI"}[_ALIASES[name]]
    return (f"{name}: ", f"**{name.title()}**: ", f"### {other}:\n", f"<|{name}|>", f"{other}: ")[zlib.crc32(str(conv).encode()) % 5]


def _transcript(turns: list[tuple], marker: Callable) -> tuple[str, list[int]]:
    """The raw transcript of some turns (conv_id, turn, role, text) and the state of each line (-1: of no known role)."""
    lines, states = [], []
    for conv, turn, role, text in turns:
        known = _ALIASES.get((role or "").strip().lower())
        body = (marker(conv, turn, role) + (text or "")).split("\n")
        lines += body
        at = ROLES.index(known) if known else -1
        states += [at, *[at + len(ROLES) if known else -1] * (len(body) - 1)]
    return "\n".join(lines), states


PARTS = "part long, conv_id long, run long, open boolean, before int, transcript string, states array<int>"


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", marker: Callable[[int | None, int | None, str | None], str] = plain_marker, part_turns: int = PART_TURNS) -> DataFrame:
    """(part, conv_id, run, open, before, transcript, states): the turns of each conversation, in order, as raw text with speaker markers.

    Rows are dealt by ranges of (conversation, turn, role, text), so a conversation however
    long spreads over tasks; a part is what stands together in one task, of ``part_turns`` turns
    at most. Parts are numbered in order. run is the first part of the conversation in its
    task, open says that the conversation may have other parts, before is the state of the
    line in front in the same run (null: none known). states has the true state of each line.

    A null turn number comes first; turns of equal number are ordered by role and text. A
    turn without a role has no marker, a null text is empty. Rows without a conv_id are one
    conversation. Repeated rows are repeated turns.
    """
    names = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << 32
        run, before, held, out = number, None, [], []

        def close(more: bool, last: bool) -> None:
            nonlocal number, before, held
            text, states = _transcript(held, marker)
            is_open = more or last or run == first or run != number
            out.append((number, held[0][0], run, is_open, before, text, states))
            before = states[-1] if states[-1] >= 0 else None
            number, held = number + 1, []

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in names)):
                if held and (row[0] != held[0][0] or len(held) == part_turns):
                    more = row[0] == held[0][0]
                    close(more, False)
                    if not more:
                        run, before = number, None
                    if len(out) >= 500:
                        yield _batch(out)
                        out.clear()
                held.append(row)
        if held:
            close(False, True)
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in PARTS.split(", ")])

    return bounded(rows).mapInArrow(make, PARTS)


def train(parts: DataFrame) -> ChatModel:
    """A model from :func:`transcripts`.

    Lines of no known role count for nothing. Counts are summed by partition, then by
    Spark, and a few hundred numbers reach the driver; where a conversation goes from one
    task to another, the states on both sides meet in a window over its runs.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _parts(np.zeros(_SIZE))
        for batch in batches:
            for part, run, is_open, before, text, states in zip(*(batch[c].to_pylist() for c in ("part", "run", "open", "before", "transcript", "states"))):
                states = np.array(states)
                _count(total, observe(text.split("\n")), states)
                if states[0] >= 0 and before is not None:
                    total[1][before, states[0]] += 1
                if states[0] >= 0 and part == run and not is_open:
                    total[0][states[0]] += 1
        flat = np.concatenate([x.ravel() for x in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "n"])

    counts = np.zeros(_SIZE)
    parted = parts.select("part", "run", "open", "before", "transcript", "states").mapInArrow(make, "place long, n double")
    for r in parted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r["place"]] = r["n"]
    runs = parts.where("open").groupBy("run").agg(F.first("conv_id").alias("conv_id"), F.min_by(F.col("states")[0], "part").alias("first"), F.max_by(F.element_at("states", -1), "part").alias("last"))
    edges = runs.select("first", F.lag("last", 1, BEGIN).over(W.partitionBy("conv_id").orderBy("run")).alias("before"))
    for r in edges.where("first >= 0 and before >= 0").groupBy("before", "first").count().collect():
        counts[r["first"] if r["before"] == BEGIN else STATES + r["before"] * STATES + r["first"]] += r["count"]
    return ChatModel.from_counts(counts)


def _ends(lasts: list[int], entry: int) -> list[int]:
    return [entry, *lasts[:-1]]


def _known_ends(parts: DataFrame, model: ChatModel) -> DataFrame:
    """``parts``, all open, with the state before each (entry) and its last state on the best path of the whole conversation.

    The tables of a run are multiplied in one task and so are those of a conversation's
    runs; a run has one small table for each part in its task, a conversation one for each
    of the tasks that it is spread over.
    """

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [model.table(observe(t.split("\n"))).ravel().tolist() for t in batch["transcript"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["part"], batch["run"], batch["conv_id"], pa.array(tables, pa.list_(pa.float64()))], ["part", "run", "conv_id", "table"])

    shaped = lambda rows: [np.array(x).reshape(STATES + 1, STATES) for x in rows["table"]]

    def multiplied(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        out, *more = shaped(rows)
        for table in more:
            out = _joined(out, table)
        return pd.DataFrame({"run": rows["run"][:1], "conv_id": rows["conv_id"][:1], "table": [out.ravel()]}, index=rows.index[:1])

    def of_runs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        lasts = _between(shaped(rows), BEGIN, -1)
        return pd.DataFrame({"run": rows["run"], "run_entry": _ends(lasts, BEGIN), "run_last": lasts})

    def of_parts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        entry = int(rows["run_entry"].iloc[0])
        lasts = _between(shaped(rows), entry, int(rows["run_last"].iloc[0]))
        return pd.DataFrame({"part": rows["part"], "entry": _ends(lasts, entry), "last": lasts})

    tables = written(parts.select("part", "run", "conv_id", "transcript").mapInArrow(sum_up, "part long, run long, conv_id long, table array<double>"))
    runs = tables.groupBy("run").applyInPandas(multiplied, "run long, conv_id long, table array<double>")
    ends = runs.groupBy("conv_id").applyInPandas(of_runs, "run long, run_entry int, run_last int")
    known = tables.join(ends, "run").groupBy("run").applyInPandas(of_parts, "part long, entry int, last int")
    return parts.join(known, "part")


def format_turns(parts: DataFrame, model: ChatModel) -> DataFrame:
    """The turns of all conversations of :func:`transcripts`: conv_id, turn (from 0), role, rendered (canonical text), n_lines, n_right.

    n_right counts the lines of the turn whose true role is ``role``. A conversation's
    canonical text is that of its turns in order; the path is the best one over all its
    lines, in however many parts they lie (of equal ones, one of them). An empty table
    gives an empty one.
    """

    def make(with_ends: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                ends = zip(*(batch[c].to_pylist() for c in ("entry", "last"))) if with_ends else iter(lambda: (BEGIN, -1), None)
                for conv, part, text, truth, (entry, last) in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "transcript", "states")), ends):
                    lines = text.split("\n")
                    seen = observe(lines)
                    turn = -1
                    for starts, role, body, at in pieces(lines, seen, model.viterbi(seen, entry, last), entry == BEGIN):
                        turn += starts
                        right = sum(x >= 0 and ROLES[x % len(ROLES)] == role for x in truth[at : at + len(body)])
                        out.append((conv, part, turn, role, "\n".join(body), len(body), right))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], ["conv_id", "part", "turn", "role", "text", "n_lines", "n_right"])

        return run

    schema = "conv_id long, part long, turn long, role string, text string, n_lines long, n_right long"
    columns = ["conv_id", "part", "transcript", "states"]
    whole = bounded(parts.where("not open").select(*columns)).mapInArrow(make(False), schema).drop("part")
    cut = written(_known_ends(parts.where("open").select(*columns, "run"), model).select(*columns, "entry", "last").mapInArrow(make(True), schema))
    # turns are numbered on from part to part; a turn may reach over several
    sizes = cut.groupBy("conv_id", "part").agg((F.max("turn") + 1).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("start"))
    rows = cut.join(starts, "part").withColumn("turn", F.col("start") + F.col("turn"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n")
    merged = rows.groupBy("conv_id", "turn").agg(F.min_by("role", "part").alias("role"), text.alias("text"), F.sum("n_lines").alias("n_lines"), F.sum("n_right").alias("n_right"))
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.trim(F.col("text"), F.lit(BLANK)), F.lit("\n<|end|>"))
    return whole.unionByName(merged).select("conv_id", "turn", "role", rendered.alias("rendered"), "n_lines", "n_right")


def format_chats(raw: DataFrame, model: ChatModel, keys: tuple[str, ...] = ("conv_id",), text_col: str = "transcript") -> DataFrame:
    """Transcripts that are whole in their rows: the ``keys`` of each with n_turns, roles (comma-joined) and rendered, its canonical text.

    A null or empty transcript has no turns and an empty text. Lines without any marker
    get their role from their neighbours and features. Repeated rows give repeated results.
    """
    rows = raw.select(*keys, F.col(text_col).alias("transcript"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [parse(t, model) for t in batch["transcript"].to_pylist()]
            columns = [pa.array([len(t) for t in turns], pa.int64()), pa.array([",".join(r for r, _ in t) for t in turns], pa.string()), pa.array([render(t) for t in turns], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], [*keys, "n_turns", "roles", "rendered"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return bounded(rows).mapInArrow(make, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_turns long, roles string, rendered string")
