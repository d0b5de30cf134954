"""The funnel as a stream: against the batch rules replayed day by day, in any order of arrival, over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import funnel
from sieveworks.streaming import funnel as stream

RULES = stream.Rules(warn=4, delete=7, notice=2, adopt=5, window=10, least=3)
START = dt.datetime(2024, 1, 1)
SCHEMA = "item string, ts timestamp, kind string"


def made(n, days, seed):
    """Events of ``n`` items, the busier the higher their number."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        out.append((f"i{i}", START + dt.timedelta(hours=draw.uniform(0, 24 * days / 2)), "added"))
        for _ in range(draw.randrange(1 + i % 7)):
            kind = draw.choices(("listen", "starred", "unstarred", "library", "added"), (12, 1, 1, 2, 1))[0]
            out.append((f"i{i}", START + dt.timedelta(hours=draw.uniform(0, 24 * days)), kind))
    return out


def replayed(spark, events, until):
    """Every day's review of all files by ``funnel.classify``, with the state kept in a dict."""
    state, out, gone_at = {}, [], {}
    day = START
    while day <= until:
        rows = []
        for item in sorted({e[0] for e in events}):
            mine = sorted((e for e in events if e[0] == item and e[1] <= day), key=lambda e: (e[1], stream.KINDS.index(e[2])))
            if item in gone_at:
                again = [e for e in mine if e[1] > gone_at[item] and e[2] == "added"]
                if not again:
                    continue
                mine = [e for e in mine if e[1] >= again[0][1]]
            if not mine:
                continue
            listens = [e[1] for e in mine if e[2] == "listen"]
            starred = ([e[2] == "starred" for e in mine if "starred" in e[2]] or [False])[-1]
            down = ([e[1] for e in mine if e[2] == "added"] or [mine[0][1]])[-1]
            first = mine[0][1]
            if not any(e[2] == "added" for e in mine):
                down = first
            now = state.get(item, {})
            rows.append((item, any(e[2] == "library" for e in mine), starred, now.get("promoted"), now.get("warned"), max(listens, default=None), down, sum(t >= day - dt.timedelta(days=RULES.window) for t in listens)))
        if rows:
            df = spark.createDataFrame(rows, "item string, replaced boolean, starred boolean, promoted timestamp, warned timestamp, last_listen timestamp, downloaded timestamp, recent int")
            got = funnel.classify(df, F.lit(day), RULES.warn, RULES.delete, RULES.notice, RULES.adopt, RULES.least).where("action <> 'keep'").select("item", "action").collect()
            for r in got:
                out.append((r["item"], day, r["action"]))
                if r["action"] in ("replace", "adopt", "delete"):
                    state.pop(r["item"], None)
                    gone_at[r["item"]] = day
                elif r["action"] == "promote":
                    state.setdefault(r["item"], {})["promoted"] = day
                elif r["action"] == "warn":
                    state.setdefault(r["item"], {})["warned"] = day
                else:
                    state[r["item"]].pop("warned")
        day += dt.timedelta(days=1)
    return sorted(out)


class Streamed:
    """A stream over a folder that batches are written to, one run a batch."""

    def __init__(self, spark, folder, late="3 days"):
        self.spark, self.folder, self.late = spark, str(folder), late
        stream.use_state_store(spark)

    def run(self, rows):
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = stream.trial_actions(stream.timed(source, "ts", self.late), RULES)
        query = out.writeStream.option("checkpointLocation", f"{self.folder}/state").option("path", f"{self.folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self):
        return sorted((r["item"], r["day"], r["action"]) for r in self.spark.read.parquet(f"{self.folder}/out").collect())


@pytest.fixture(scope="module")
def batch(spark):
    events = made(48, 24, 5)
    last = START + dt.timedelta(days=40)
    return events, last, replayed(spark, events, last)


def test_rules_alone_equal_the_replay(batch):
    events, last, want = batch
    got = []
    for item in {e[0] for e in events}:
        mine = sorted(((e[1] - dt.datetime(1970, 1, 1)).total_seconds(), stream.KINDS.index(e[2])) for e in events if e[0] == item)
        for day, action, _ in stream.reviewed(stream.Trial(), [(t, stream.KINDS[k]) for t, k in mine], float("-inf"), (last - dt.datetime(1970, 1, 1)).total_seconds(), RULES):
            got.append((item, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=day), action))
    assert sorted(got) == want
    assert {"replace", "adopt", "promote", "delete", "warn", "cancel"} == {a for _, _, a in want}


def test_stream_equals_batch_over_restarts(spark, tmp_path, batch):
    """Three runs, the second of which begins from the checkpoint; arrival up to three days out of order."""
    events, last, want = batch
    draw = random.Random(3)
    arrived = sorted(events, key=lambda e: e[1] + dt.timedelta(days=draw.uniform(0, 2.9)))
    third = len(arrived) // 3
    run = Streamed(spark, tmp_path)
    for part in (arrived[:third], arrived[third : 2 * third], arrived[2 * third :], [("last", last + dt.timedelta(days=3), "listen")]):
        run.run(part)
    got = run.rows()
    assert got == want and len(got) == len(set(got))


def test_late_rows_change_nothing(spark, tmp_path):
    run = Streamed(spark, tmp_path, "1 day")
    run.run([("a", START, "added"), ("a", START + dt.timedelta(days=6), "unstarred")])
    # more than a day behind: the warning of day 4 was given, a listen on day 2 can't take it back
    run.run([("a", START + dt.timedelta(days=2), "listen")])
    run.run([("a", START + dt.timedelta(days=8), "unstarred"), (None, START, "listen"), ("b", None, "listen"), ("c", START + dt.timedelta(days=8), "other")])
    run.run([("z", START + dt.timedelta(days=30), "added")])
    assert run.rows() == [("a", START + dt.timedelta(days=4), "warn"), ("a", START + dt.timedelta(days=7), "delete")]


def test_the_funnel_keeps_two_variables_and_reads_each_once():
    from sieveworks.streaming import funnel as stream

    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *a: calls.append((self.name, call))

    class Handle:
        getValueState = getListState = lambda self, name, schema: calls.append(("made", name)) or State(name)
        registerTimer = deleteTimer = lambda self, at: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    one = stream.TrialFunnel(stream.Rules())
    one.init(Handle())
    list(one.handleInputRows(("a",), iter([{"ts": 5.0, "kind": "listen"}]), Times()))
    assert calls == [("made", "file"), ("made", "waiting"), ("file", "get"), ("waiting", "put"), ("file", "update")]
