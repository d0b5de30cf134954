"""The trial funnel over a stream of listens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveworks.functions import tolerance as T

PROMOTED = "item string, ts timestamp, listens int"


def timed(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """A stream with a watermark; times without a zone are taken as UTC (the session's zone)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_listens(listens: DataFrame, item: str, ts: str, days: int = 28, step: str = "1 day") -> DataFrame:
    """Listens of each item in sliding windows; windows that the watermark closed are final."""
    return listens.groupBy(F.window(ts, f"{days} days", step), item).agg(F.count("*").alias("listens"))


def promotions(listens: DataFrame, item: str, ts: str, days: int = 28, least: int = 3, idle_days: int = 42) -> DataFrame:
    """The first time that each item has ``least`` listens within ``days`` days: (item, ts, listens).

    The state of an item holds its listens of the last ``days`` days, at most ``least`` of
    them, and whether it was promoted; it goes ``idle_days`` after the last one. Within a
    trigger an item's listens are taken in the order of time.
    """
    rows = listens.select(F.col(item).cast("string").alias("item"), F.col(ts).alias("ts"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, done = state.get if state.exists else ([], False)
        times, now = list(times), sorted(t.timestamp() for b in batches for t in b["ts"])
        for t in now:
            times = [x for x in times if x >= t - days * 86400][1 - least :] + [t] if least > 1 else [t]
            if len(times) >= least and not done:
                done = True
                yield pd.DataFrame({"item": [key[0]], "ts": [pd.Timestamp(t, unit="s")], "listens": [len(times)]})
        state.update((times, done))
        if now:
            state.setTimeoutTimestamp(max(int((now[-1] + idle_days * 86400) * 1000), state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("item").applyInPandasWithState(step, PROMOTED, "times array<double>, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


#: What a trial file's stream tells: it was downloaded (again), heard, starred or not any more, and its song came into the library.
KINDS = ("added", "listen", "starred", "unstarred", "library")
ACTIONS = "item string, day timestamp, action string, idle_days double"
_DAY = 86_400.0
#: Transform-with-state keeps its variables in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Days and listens of the funnel's rules, as in :func:`sieveworks.operators.funnel.classify`."""

    warn: int = T.WARN_DAYS
    delete: int = T.DELETE_DAYS
    notice: int = T.NOTICE_DAYS
    adopt: int = T.ADOPT_DAYS
    window: int = T.PROMOTE_DAYS
    least: int = T.PROMOTE_LISTENS


@dataclass
class Trial:
    """One trial file as its reviews find it; times in seconds, null where it never happened."""

    downloaded: float | None = None
    last_listen: float | None = None
    promoted: float | None = None
    warned: float | None = None
    starred: bool = False
    replaced: bool = False
    gone: bool = False
    recent: list[float] = field(default_factory=list)

    def apply(self, ts: float, kind: str, least: int) -> None:
        if kind == "added" and self.gone:
            self.__init__()
        if self.gone:
            return
        if self.downloaded is None or kind == "added":
            self.downloaded = ts
        if kind == "listen":
            self.last_listen = ts
            self.recent = [*self.recent, ts][-least:]
        elif kind in ("starred", "unstarred"):
            self.starred = kind == "starred"
        elif kind == "library":
            self.replaced = True

    def idle(self, now: float) -> float:
        return (now - (self.downloaded if self.last_listen is None else self.last_listen)) / _DAY

    def review(self, now: float, rules: Rules) -> str:
        """The action of one day's review, which changes what later ones find."""
        since = lambda t: (now - t) / _DAY
        free = not self.starred and self.promoted is None
        if self.replaced or self.promoted is not None and since(self.promoted) >= rules.adopt:
            self.gone = True
            return "replace" if self.replaced else "adopt"
        if self.promoted is None and sum(t >= now - rules.window * _DAY for t in self.recent) >= rules.least:
            self.promoted = now
            return "promote"
        if free and self.warned is not None and self.idle(now) >= rules.delete and since(self.warned) >= rules.notice:
            self.gone = True
            return "delete"
        if free and self.warned is None and self.idle(now) >= rules.warn:
            self.warned = now
            return "warn"
        if free and self.warned is not None and self.idle(now) < rules.warn:
            self.warned = None
            return "cancel"
        return "keep"

    def due(self, rules: Rules) -> float | None:
        """The next time at which a review can act without another event."""
        if self.gone or self.downloaded is None:
            return None
        if self.promoted is not None:
            return self.promoted + rules.adopt * _DAY
        if self.starred:
            return None
        last = self.downloaded if self.last_listen is None else self.last_listen
        return last + rules.warn * _DAY if self.warned is None else max(last + rules.delete * _DAY, self.warned + rules.notice * _DAY)


def _next_day(t: float) -> float:
    return -(-t // _DAY) * _DAY


def reviewed(trial: Trial, events: list[tuple[float, str]], reviewed_to: float, until: float, rules: Rules) -> Iterator[tuple[float, str, float]]:
    """(day, action, idle days) of the daily reviews after ``reviewed_to`` and up to ``until``, over events in the order of time; only days on which something can change are looked at."""
    at = 0
    while True:
        days = [max(_next_day(t), reviewed_to + _DAY) for t in (trial.due(rules), events[at][0] if at < len(events) else None) if t is not None]
        day = min(days, default=None)
        if day is None or day > until:
            break
        while at < len(events) and events[at][0] <= day:
            trial.apply(*events[at], rules.least)
            at += 1
        if not trial.gone and trial.downloaded is not None and (action := trial.review(day, rules)) != "keep":
            yield day, action, trial.idle(day)
        reviewed_to = day
    del events[:at]


class TrialFunnel(StatefulProcessor):
    """The funnel of one item. Two variables: the file with the last day reviewed and its timer, and the events that the watermark hasn't passed; each is read and written once a call.

    Events wait until the watermark passes them, so their order of arrival doesn't matter;
    a timer is due on the first day on which a review can act. What went leaves no state.
    """

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "downloaded double, last_listen double, promoted double, warned double, starred boolean, replaced boolean, gone boolean, recent array<double>, day double, timer long, waits boolean")
        self.waiting = handle.getListState("waiting", "ts double, kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._advanced(key, [(r["ts"], r["kind"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advanced(key, [], timerValues, expired=True)

    def _advanced(self, key: tuple, new: list[tuple[float, str]], timerValues, expired: bool = False) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        n = len(fields(Trial))
        known = self.file.get()
        trial = Trial(*known[:n]) if known else Trial()
        trial.recent = list(trial.recent)
        reviewed_to, timer, waits = known[n:] if known else (float("-inf"), None, False)
        events = sorted((t, KINDS.index(kind)) for t, kind in [*(self.waiting.get() if waits else ()), *new])
        events = [(t, KINDS[k]) for t, k in events]
        until = watermark // _DAY * _DAY
        for day, action, idle in reviewed(trial, events, reviewed_to, until, self.rules):
            yield Row(item=key[0], day=pd.Timestamp(day, unit="s").to_pydatetime(), action=action, idle_days=idle)
        self._keep(trial, events, max(until, reviewed_to), None if expired else timer, waits)

    def _keep(self, trial: Trial, events: list[tuple[float, str]], reviewed_to: float, timer: int | None, waited: bool) -> None:
        if trial.gone and not events:
            # later events of a file that went tell nothing, unless it is added again: that it went has to be known
            trial = Trial(gone=True)
        due = [t for t in (trial.due(self.rules), events[0][0] if events else None) if t is not None]
        at = int(max(_next_day(min(due)), reviewed_to + _DAY) * 1000) if due else None
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if events:
            self.waiting.put(events)
        elif waited:
            self.waiting.clear()
        self.file.update((*(getattr(trial, f.name) for f in fields(Trial)), reviewed_to, at, bool(events)))

    def close(self) -> None:
        pass


def trial_actions(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(item, day, action, idle_days): every action of the funnel, once, on the day of the review that takes it.

    ``events`` is a stream of (item, ts, kind) with a watermark on ts; kinds are those of
    :data:`KINDS`, others and nulls are left out. Reviews take place at the beginning of
    each day (UTC) that the watermark has passed, with all events up to it. The first
    event of an item counts as its download if none is told. A file that was replaced,
    adopted or deleted is only seen again after it was added again. Events of one time
    count in the order of :data:`KINDS`. Events later than the watermark are dropped by Spark.
    The session's state store must be :data:`STATE_STORE`.
    """
    rows = events.where(F.col("kind").isin(*KINDS) & F.col("item").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.col("item").cast("string").alias("item"), F.col("kind"), F.col("ts").alias("_at"), (F.unix_micros("ts") / 1e6).alias("ts"))
    return rows.groupBy("item").transformWithState(TrialFunnel(rules), ACTIONS, "append", "eventTime")


def use_state_store(spark: SparkSession) -> None:
    """Let the session's streams keep their state in :data:`STATE_STORE`."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
