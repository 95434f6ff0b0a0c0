"""N-gram tables and the proposal gate of a weight table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pair and triple features, by the side on which they look.
PAIRS = {"c-1c0=": "right", "c0c+1=": "left"}
TRIPLES = {"c-2c-1c0=": "right", "c0c+1c+2=": "left"}
_NGRAM = r"^(c-2c-1c0=|c0c\+1c\+2=|c-1c0=|c0c\+1=)(.*)$"
_UNITS = r"<(?:BOS|EOS)[12]>|[\s\S]"


def ngrams(weights: DataFrame) -> DataFrame:
    """(feature, side, key, arity, o, b, m, e, s) of pair and triple features; keys may hold border marks."""
    name = F.regexp_extract("feature", _NGRAM, 1)
    side = F.when(name.isin(*[k for k, v in (PAIRS | TRIPLES).items() if v == "left"]), "left").otherwise("right")
    key = F.regexp_extract("feature", _NGRAM, 2)
    return weights.where(name != "").select("feature", side.alias("side"), key.alias("key"), F.size(F.regexp_extract_all(key, F.lit(_UNITS), F.lit(0))).alias("arity"), "o", "b", "m", "e", "s").where("arity between 2 and 3")


def table(weights: DataFrame) -> DataFrame:
    """One row an n-gram with the weights of both sides (0 where there are none)."""
    side = lambda s: [F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for c in "obmes"]
    return ngrams(weights).groupBy("key", "arity").agg(*side("left"), *side("right"))


def proposals(weights: DataFrame, least: float, weak: float = 0.4) -> DataFrame:
    """(key, arity, delta) of n-grams that propose a name.

    delta: the better of starting and single over outside, on the better
    side. Kept from `least` on; pairs inside a kept triple go; a pair below
    `least` + `weak` gives way to its best triple above zero, if it has one.
    """
    d = ngrams(weights).groupBy("key", "arity").agg(F.max(F.greatest("b", "s") - F.col("o")).alias("delta"))
    units = d.withColumn("u", F.regexp_extract_all("key", F.lit(_UNITS), F.lit(0)))
    inside = units.where("arity = 3").select("key", "delta", F.explode(F.array(F.concat(F.col("u")[0], F.col("u")[1]), F.concat(F.col("u")[1], F.col("u")[2]))).alias("pair"))
    kept = d.where(F.col("delta") >= least)
    pairs = kept.where("arity = 2").join(inside.where(F.col("delta") >= least).select(F.col("pair").alias("key")).distinct(), "key", "left_anti")
    best = inside.where("delta > 0").groupBy("pair").agg(F.max(F.struct("delta", "key")).alias("t"))
    refined = pairs.where(F.col("delta") < least + weak).join(best, F.col("key") == F.col("pair"), "left")
    strong = pairs.where(F.col("delta") >= least + weak).select("key", "arity", "delta")
    plain = refined.where("t is null").select("key", "arity", "delta")
    instead = refined.where("t is not null").select(F.col("t.key").alias("key"), F.lit(3).alias("arity"), F.col("t.delta").alias("delta"))
    return strong.unionByName(plain).unionByName(kept.where("arity = 3")).unionByName(instead).distinct()


#: The multiplier of the gate's hash, in halves, and the bit that marks three code points.
_HIGH, _LOW, _THREE = 0xD6E8FEB8, 0x6659FD93, 1 << 63


def _wide(x) -> Column:
    return x.cast("decimal(38,0)") if isinstance(x, Column) else F.lit(str(x)).cast("decimal(38,0)")


def gate_key(points: Column) -> Column:
    """Two or three code points as one number (DECIMAL(20, 0)): 21 bits each, the top bit for three, and one more."""
    p = lambda i: _wide(F.element_at(points, i))
    two = p(1) * _wide(1 << 21) + p(2)
    three = _wide(_THREE) + p(1) * _wide(1 << 42) + p(2) * _wide(1 << 21) + p(3)
    return F.when(F.size(points) == 2, two + 1).when(F.size(points) == 3, three + 1).cast("decimal(20,0)")


def gate_hash(key: Column) -> Column:
    """The hash of a key below 2**64 (DECIMAL(20, 0)): halves are mixed, multiplied modulo 2**64, and mixed again."""
    half, size = _wide(1 << 32), _wide(1 << 64)
    parts = lambda x: (((x - F.pmod(x, half)) / half).cast("long"), F.pmod(x, half).cast("long"))
    mixed = lambda high, low: _wide(high) * half + _wide(high.bitwiseXOR(low))
    x = mixed(*parts(_wide(key)))
    # x * (_HIGH * 2**32 + _LOW): the upper product counts with x's lower half only.
    x = F.pmod(x * _wide(_LOW) + F.pmod(F.pmod(x, half) * _wide(_HIGH), half) * half, size)
    return mixed(*parts(x)).cast("decimal(20,0)")


def records(weights: DataFrame, hashed) -> DataFrame:
    """Weights in the order of their names' hashes: (hash, feature, o, b, m, e, s)."""
    return weights.select(hashed(F.col("feature")).alias("hash"), "feature", "o", "b", "m", "e", "s").orderBy("hash", "feature")


def prefix_bits(words: DataFrame, bits: int = 17) -> DataFrame:
    """(bit) that are set in a filter of 2**bits for words of three characters or more: the hashes of their first three."""
    first = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.ascii(F.substring(F.col("word"), i, F.lit(1))))
    return words.where(F.length("word") >= 3).select(F.pmod(gate_hash(gate_key(first)), _wide(1 << bits)).cast("int").alias("bit")).distinct()


def collisions(names: DataFrame, hashed) -> DataFrame:
    """(hash, n) of hashes that several names have."""
    return names.select("feature", hashed(F.col("feature")).alias("hash")).groupBy("hash").agg(F.countDistinct("feature").alias("n")).where("n > 1")


def consistency(weights: DataFrame, columns: tuple[str, ...] = ("o", "b", "m", "e", "s")) -> DataFrame:
    """(rule, broken) counts: repeated features, weights that aren't finite, rows without weight."""
    n = weights.agg(
        (F.count("*") - F.countDistinct("feature")).alias("repeated"),
        F.sum(F.greatest(*[(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("int") for c in columns])).alias("not_finite"),
        F.sum(F.greatest(*[(F.col(c) != 0).cast("int") for c in columns]) * -1 + 1).alias("empty"),
    )
    return n.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).cast("long").alias("broken")) for r in ("repeated", "not_finite", "empty")])))
