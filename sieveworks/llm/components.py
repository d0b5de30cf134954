"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.sources.storage import forget, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Alternates large-star and small-star rounds: every node hangs its larger neighbours,
    then its smaller ones, on the smallest node that it sees, until each component is a
    star. Minima are pre-aggregated before their shuffle; a hub's edges meet its minimum
    in an equi-join of two exchanges, which adaptive execution can split. Every round is
    written to the shared folder.

    Ids that stand in no edge are not returned. Self-loops and edges with a null end are
    ignored, repeated edges count once; an empty table gives an empty one.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b")
    now = written(pairs.distinct())
    state = None
    for _ in range(most_rounds):
        # large-star: the larger neighbours of a node go to the smallest node it sees
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(now.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = written(both.join(least, "node").where("near > node").select(F.col("near").alias("hi"), F.col("low").alias("lo")).distinct())
        # small-star: the smaller neighbours of a node, and the node, go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = large.join(low, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        after = written(moved.unionByName(low.select("hi", F.col("low").alias("lo"))).distinct())
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        forget(now, large)
        now = after
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"no stars after {most_rounds} rounds")
    out = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return out.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def smallest_labels(components: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component, label): the smallest label in the component of each id; ``labels`` (id, label) is unique by id, null labels don't count. Minima are pre-aggregated before their shuffle."""
    least = components.join(labels, "id").groupBy("component").agg(F.min("label").alias("label"))
    return components.join(least, "component").select("id", "component", "label")
