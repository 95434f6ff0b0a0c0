"""Hidden Markov tagger: counts to log-probabilities, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge import schema
from spanforge.operators.viterbi import best_path

#: Log-probabilities are kept as whole millionths, so sums don't depend on their order.
SCALE = 1_000_000
#: A model that workers hold has at most so many rows: all of Unicode with ten states or so.
MOST_ROWS = 2_000_000


def _log(count, total, smoothing: float, choices):
    return F.round(F.ln((F.coalesce(count, F.lit(0)) + F.lit(smoothing)) / (total + F.lit(smoothing) * choices)) * SCALE).cast("long")


def train(tagged: DataFrame, types: tuple[str, ...] = schema.LEGACY_TYPES, smoothing: float = 0.1, key: str = "sid") -> dict[str, DataFrame]:
    """start(state, logp), transition(prev, state, logp), emission(state, char, logp), unknown(state, logp).

    Counts combine before the shuffle; the model has at most a row for each
    state and character.
    """
    spark, states = tagged.sparkSession, schema.states(types)
    frame = lambda rows, cols: F.broadcast(spark.createDataFrame(rows, cols))
    w = Window.partitionBy(key).orderBy("pos")
    pairs = tagged.select("tag", "char", "pos", F.lag("tag").over(w).alias("prev"))
    first = [s for s in states if schema.may_start(s)]
    starts = pairs.where("prev is null").groupBy(F.col("tag").alias("state")).agg(F.count("*").alias("n"))
    start = frame([(s,) for s in first], "state string").join(starts, "state", "left").withColumn("t", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0))))
    start = start.select("state", _log(F.col("n"), F.col("t"), smoothing, len(first)).alias("logp"))
    moves = [(a, b) for a in states for b in states if schema.may_follow(a, b)]
    seen = pairs.where("prev is not null").groupBy("prev", F.col("tag").alias("state")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("prev")
    transition = frame(moves, "prev string, state string").join(seen, ["prev", "state"], "left").withColumn("t", F.sum(F.coalesce("n", F.lit(0))).over(by)).withColumn("k", F.count("*").over(by))
    transition = transition.select("prev", "state", _log(F.col("n"), F.col("t"), smoothing, F.col("k")).alias("logp"))
    counts = tagged.groupBy(F.col("tag").alias("state"), "char").agg(F.count("*").alias("n"))
    vocabulary = tagged.agg(F.countDistinct("char").alias("v"))
    totals = frame([(s,) for s in states], "state string").join(counts.groupBy("state").agg(F.sum("n").alias("t")), "state", "left").join(F.broadcast(vocabulary), F.lit(True)).select("state", F.coalesce("t", F.lit(0)).alias("t"), "v")
    emission = counts.join(F.broadcast(totals), "state").select("state", "char", _log(F.col("n"), F.col("t"), smoothing, F.col("v") + 1).alias("logp"))
    unknown = totals.select("state", _log(F.lit(0), F.col("t"), smoothing, F.col("v") + 1).alias("logp"))
    return {"start": start, "transition": transition, "emission": emission, "unknown": unknown}


def decoder(model: dict[str, DataFrame], types: tuple[str, ...] = schema.LEGACY_TYPES):
    """A pandas UDF text -> tags; the model is what the driver holds: states x characters, MOST_ROWS at most."""
    states = schema.states(types)
    at = {s: i for i, s in enumerate(states)}
    none = F.lit(None).cast("string")
    tables = [df.select(F.lit(k).alias("kind"), prev.alias("a"), F.col("state").alias("b"), char.alias("c"), "logp") for k, df, prev, char in (
        ("start", model["start"], none, none), ("transition", model["transition"], F.col("prev"), none), ("unknown", model["unknown"], none, none), ("emission", model["emission"], none, F.col("char")),
    )]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3]).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a model of more than {MOST_ROWS} rows")
    start = {at[r.b]: r.logp for r in rows if r.kind == "start"}
    moves = {(at[r.a], at[r.b]): r.logp for r in rows if r.kind == "transition"}
    unknown = [0] * len(states)
    for r in rows:
        if r.kind == "unknown":
            unknown[at[r.b]] = r.logp
    emit: dict[str, list[int]] = {}
    for r in rows:
        if r.kind == "emission":
            emit.setdefault(r.c, list(unknown))[at[r.b]] = r.logp
    final = [i for s, i in at.items() if schema.may_end(s)]
    before = [[p for p in range(len(states)) if (p, c) in moves] for c in range(len(states))]

    @F.pandas_udf("array<string>")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [states[i] for i in best_path([emit.get(c, unknown) for c in t or ""], start, moves, before, final)])

    return decode
