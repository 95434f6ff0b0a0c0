"""Connected components by contraction; no edge list reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import dropped, stored


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) of integer nodes: component is the smallest node that is reachable.

    In each round every node points at the neighbour of the smallest seeded
    hash, if that is below its own, and on to where that one points; edges are
    then drawn again between what their ends point at, loops and repeats go, and
    the next round sees those only. The hashes differ by round, so that no
    order of the numbers makes long chains; a round with edges always removes
    a node, so it ends by itself, in about log(nodes) rounds. A star, as of a
    hub with a third of all edges, is gone after one. Aggregates combine before the
    shuffle; joins have one row for each node on one side. Rounds are written to
    the shared folder and deleted when the next one stands; the driver sees
    whether edges are left. Self loops and repeated edges are harmless, an
    empty input gives no rows.
    """
    left = stored(edges.select(F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while labels is None or left.limit(1).count():
        h = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        both = left.union(left.select("v", "u"))
        low = both.groupBy("u").agg(F.min(h("v")).alias("least"), F.min_by("v", h("v")).alias("best"))
        step = stored(low.select("u", F.when(F.col("least") < h("u"), F.col("best")).otherwise(F.col("u")).alias("p")), "step")
        further = step.select(F.col("u").alias("p"), F.col("p").alias("label"))
        label = stored(step.join(further, "p").select(F.col("u").alias("node"), "label"), "labels")
        drawn = left.join(label.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(label.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        new = stored(drawn.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        if labels is None:
            now = label
        else:
            then = label.select(F.col("node").alias("label"), F.col("label").alias("then"))
            now = stored(labels.join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label")), "labels")
            dropped(labels, label)
        dropped(left, step)
        left, labels, turn = new, now, turn + 1
    dropped(left)
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    out = stored(labels.join(smallest, "label").select("node", "component"), "components")
    dropped(labels)
    return out
