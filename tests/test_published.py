"""Published tables: batches that arrive twice, crashes, other writers, and change logs kept up to date."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import changes
from sieveworks.sources import published as P
from sieveworks.sources import readers

COUNTS = "song string, plays long, last string"
ON, MERGED = ["song"], {"plays": "sum", "last": "max"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def batch(spark, *values):
    return spark.createDataFrame(list(values), COUNTS)


def test_a_batch_counts_once(spark, tmp_path):
    table = P.Published(spark, str(tmp_path), COUNTS)
    sink = P.counter_sink(table, ON, MERGED, "zip")
    assert rows(P.counters(table, ON, MERGED)) == [] and table.latest().number == 0
    one, two = batch(spark, ("a", 1, "2024"), ("a", 2, "2023"), (None, 1, None)), batch(spark, ("a", 5, "2025"), ("b", 1, None))
    for df, n in ((one, 0), (one, 0), (two, 1), (one, 0), (two, 1)):
        sink(df, n)
    P.counter_sink(table, ON, MERGED, "other")(batch(spark, ("b", 1, "2020")), 0)
    assert rows(P.counters(table, ON, MERGED)) == [("a", 8, "2025"), ("b", 2, "2020"), (None, 1, None)]
    assert table.latest().number == 3 and table.latest().applied == {"zip": 1, "other": 0}


def test_parts_are_merged(spark, tmp_path):
    table = P.Published(spark, str(tmp_path), COUNTS)
    sink = P.counter_sink(table, ON, MERGED, "zip", most_parts=3)
    for n in range(9):
        sink(batch(spark, ("a", 1, str(n))), n)
        assert len(table.latest().parts) <= 3
    assert rows(P.counters(table, ON, MERGED)) == [("a", 9, "8")]
    table.clean()
    assert rows(P.counters(table, ON, MERGED)) == [("a", 9, "8")]
    assert len(list((tmp_path / "data").iterdir())) == len(table.latest().parts)


def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = P.Published(spark, str(tmp_path), COUNTS)
    sink = P.counter_sink(table, ON, MERGED, "zip")
    sink(batch(spark, ("a", 1, "2024")), 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_renamed", crash)
        with pytest.raises(OSError):
            sink(batch(spark, ("a", 1, "2025")), 1)
    assert rows(P.counters(table, ON, MERGED)) == [("a", 1, "2024")]
    sink(batch(spark, ("a", 1, "2025")), 1)
    assert rows(P.counters(table, ON, MERGED)) == [("a", 2, "2025")]


def test_two_writers(spark, tmp_path):
    table = P.Published(spark, str(tmp_path), COUNTS)
    before = table.latest()
    table.publish(before, [table.write(batch(spark, ("a", 1, None)))], "one", 0)
    with pytest.raises(RuntimeError):
        table.publish(before, [table.write(batch(spark, ("b", 1, None)))], "two", 0)
    assert rows(table.read()) == [("a", 1, None)] and not [f for f in (tmp_path / "versions").iterdir() if f.name.startswith("_")]


@pytest.mark.parametrize("seed", range(4))
def test_further_compaction_equals_the_whole(spark, seed):
    """Logs with moves onto known paths, swaps, returns and removals, cut anywhere."""
    draw = random.Random(seed)
    paths = [f"p{i}" for i in range(9)]
    log = [(n, draw.choice(paths), draw.choice([*paths, *paths, None])) for n in range(60)]
    whole = rows(changes.compact(spark.createDataFrame(log, "seq long, old string, new string")))
    known, at = spark.createDataFrame([], P.CHANGE_MAP), 0
    for end in sorted(draw.sample(range(1, 60), 3)) + [60]:
        part = [(n - at, a, b) for n, a, b in log[at:end]]
        known = changes.compact_further(known, spark.createDataFrame(part, "seq long, old string, new string"))
        at = end
    assert rows(known) == whole


def test_log_files_as_a_stream(spark, tmp_path):
    """After every batch of files, and after a repeated run, the kept map is that of all files."""
    folder = tmp_path / "logs"
    folder.mkdir()
    table = P.Published(spark, str(tmp_path / "map"), P.CHANGE_MAP)
    keep = P.change_map_sink(table, "logs")
    steps = [[("01.json", [("a", "b"), ("b", "c")], ["x"])], [("02.json", [("c", "d"), ("x", "y")], []), ("03.json", [("d", "e"), ("", "z")], ["y"])], [("04.json", [("a", "q")], ["e"])]]
    for step in steps:
        for name, moved, gone in step:
            (folder / name).write_text(json.dumps({"cambios": [{"old_path": o, "new_path": n} for o, n in moved], "quitadas": gone}))
        for _ in range(2):
            stream = readers.change_log_stream(spark, str(folder)).writeStream.foreachBatch(lambda df, n: keep(readers.batch_records(df), n))
            stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert rows(table.read()) == rows(changes.compact(readers.change_logs(spark, str(folder))))
    assert table.latest().number == 3


def test_stream_from_nothing_adds_nothing(spark, tmp_path):
    batch(spark, ("a", 1, "1"), ("b", 2, "2")).write.parquet(str(tmp_path / "in"))
    table = P.Published(spark, str(tmp_path / "out"), COUNTS)
    sink = P.counter_sink(table, ON, MERGED, "in")
    for _ in range(2):
        source = spark.readStream.schema(COUNTS).parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).start().awaitTermination()
    assert rows(P.counters(table, ON, MERGED)) == [("a", 1, "1"), ("b", 2, "2")]
    assert table.read().where(F.col("plays") > 0).count() == 2
