"""Exact-span scores, coverage and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def matches(gold: DataFrame, predicted: DataFrame, key: str = "sid") -> DataFrame:
    """(key, start, end, type, tp, fp, fn) of distinct spans."""
    on = [key, "start", "end", "type"]
    g, p = gold.select(*on).distinct().withColumn("_g", F.lit(1)), predicted.select(*on).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, on, "full")
    has_g, has_p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return both.select(*on, (has_g & has_p).cast("long").alias("tp"), (~has_g).cast("long").alias("fp"), (~has_p).cast("long").alias("fn"))


def scores(gold: DataFrame, predicted: DataFrame, key: str = "sid") -> DataFrame:
    """Counts, precision, recall and F1 by type, and overall (type ALL)."""
    counted = matches(gold, predicted, key).rollup("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _with_prf(counted.select(F.coalesce("type", F.lit("ALL")).alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def extended(cases: DataFrame, gold: DataFrame, predicted: DataFrame, key: str = "sid") -> DataFrame:
    """One row over cases (key, text): exact sentences, false positives a 1,000 characters, those in negative cases."""
    m = matches(gold, predicted, key).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = cases.select(key, F.length("text").alias("chars")).join(m, key, "left").fillna(0, ["tp", "fp", "fn"])
    negative = (F.col("tp") + F.col("fn") == 0).cast("long")
    n = rows.agg(
        F.count("*").alias("sentences"), F.sum("chars").alias("chars"), F.sum(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("long")).alias("exact"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum(negative).alias("negatives"), F.sum(negative * F.col("fp")).alias("negative_fp"),
    )
    return _with_prf(n).withColumn("exact_rate", F.round(_ratio(F.col("exact"), F.col("sentences")), 6)).withColumn("fp_per_1k", F.round(_ratio(F.col("fp") * 1000.0, F.col("chars")), 6))


def failures(cases: DataFrame, gold: DataFrame, predicted: DataFrame, limit: int = 10, key: str = "sid") -> DataFrame:
    """The first cases (by key) that aren't exact; a negative limit gives all."""
    bad = matches(gold, predicted, key).where("fp + fn > 0").select(key).distinct()
    rows = cases.join(bad, key, "left_semi").orderBy(key)
    return rows if limit < 0 else rows.limit(limit)


def coverage(gold: DataFrame, candidates: DataFrame, key: str = "sid") -> DataFrame:
    """Gold spans by type, and how many a candidate of the same place and kind covers; none: 1.0."""
    c = candidates.select(key, "start", "end", "sources").dropDuplicates([key, "start", "end"])
    hit = gold.select(key, "start", "end", "type").distinct().join(c, [key, "start", "end"], "left").withColumn("covered", F.coalesce(F.array_contains("sources", F.col("type")), F.lit(False)).cast("long"))
    out = hit.rollup("type").agg(F.count("*").alias("gold"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return out.select(F.coalesce("type", F.lit("ALL")).alias("type"), "gold", "covered", F.round(F.when(F.col("gold") > 0, F.col("covered") / F.col("gold")).otherwise(1.0), 6).alias("coverage"))


def require_coverage(gold: DataFrame, candidates: DataFrame, least: float = 0.99, key: str = "sid") -> None:
    """Raise if candidates cover less than a share of the gold spans."""
    got = coverage(gold, candidates, key).where("type = 'ALL'").first()
    if got is not None and got.coverage < least:
        raise ValueError(f"candidates cover {got.covered} of {got.gold} spans, {got.coverage} < {least}")


def density(cases: DataFrame, candidates: DataFrame, key: str = "sid") -> DataFrame:
    """One row: characters, distinct candidates, and candidates a 1,000 characters."""
    n = candidates.select(key, "start", "end").distinct().groupBy(key).agg(F.count("*").alias("n"))
    out = cases.select(key, F.length("text").alias("c")).join(n, key, "left").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    return out.withColumn("per_1k", F.round(_ratio(F.col("candidates") * 1000.0, F.col("chars")), 6))


def shown(text, span):
    """TYPE:start:end:surface of a span, for reports."""
    return F.concat_ws(":", span["type"], span["start"].cast("string"), span["end"].cast("string"), F.substring(text, span["start"] + 1, span["end"] - span["start"]))


def gates(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, value, limit, ok) for limits (metric, '>=' or '<=', limit) on a one-row frame."""
    rows = [F.struct(F.lit(f"{m} {op} {x}").alias("gate"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("limit"), (F.col(m) >= x if op == ">=" else F.col(m) <= x).alias("ok")) for m, op, x in limits]
    return metrics.select(F.inline(F.array(*rows)))


def passed(gate_rows: DataFrame) -> bool:
    return gate_rows.where("not ok").limit(1).count() == 0
