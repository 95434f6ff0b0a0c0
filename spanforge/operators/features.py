"""Features of characters, and their weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx
from spanforge.operators import lexicon
from spanforge.operators.viterbi import STATES


def characters(sentences: DataFrame, key: str = "sid", text: str = "text") -> DataFrame:
    """(key, text, pos) of each character."""
    return sentences.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("pos"))


def _named(c: list[Column], k: list[Column]) -> list[Column]:
    """The 15 features of the five characters around a place, and of the classes of the middle three."""
    cat = lambda name, *parts: F.concat(F.lit(name), *parts)
    colon = F.lit(":")
    # The names of the features.
    return [
        F.lit("bias"), cat("c0=", c[2]), cat("c-1=", c[1]), cat("c+1=", c[3]), cat("c-2=", c[0]), cat("c+2=", c[4]), cat("c-1c0=", c[1], c[2]), cat("c0c+1=", c[2], c[3]), cat("c-2c-1c0=", c[0], c[1], c[2]),
        cat("c0c+1c+2=", c[2], c[3], c[4]), cat("k0=", k[1]), cat("k-1=", k[0]), cat("k+1=", k[2]), cat("k-1k0=", k[0], colon, k[1]), cat("k0k+1=", k[1], colon, k[2]),
    ]


def char_features(sentences: DataFrame, key: str = "sid", text: str = "text") -> DataFrame:
    """(key, pos, feature): the 15 features of characters, classes and their pairs and triples."""
    at = lambda d: tx.char_at(F.col(text), F.col("pos") + d)
    c = characters(sentences, key, text).select(key, "pos", *[at(d).alias(f"c{d + 2}") for d in range(-2, 3)])
    c = c.select(key, "pos", *[f"c{i}" for i in range(5)], *[tx.char_class(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2, 3)])
    out = _named([F.col(f"c{i}") for i in range(5)], [F.col(f"k{i}") for i in (1, 2, 3)])
    return c.select(key, "pos", F.explode(F.array(*out)).alias("feature"))


def windows(text: Column, matches: Column) -> Column:
    """Array of (text, pos, roles) by position: what its features depend on, the text two characters around and its roles in lexicon matches.

    Texts have many fewer of these than positions with features; `spelt` makes the features of one.
    """
    before = lambda i: F.least(i, F.lit(2))
    near = lambda i: F.struct(F.substring(text, i - before(i) + 1, before(i) + 3).alias("text"), before(i).alias("pos"), lexicon.roles(matches, i).alias("roles"))
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), near))


def spelt(window: Column) -> Column:
    """The features of one of `windows`: those of `char_features` and `lexicon.features`."""
    c = [tx.char_at(window["text"], window["pos"] + d) for d in range(-2, 3)]
    return F.concat(F.array(*_named(c, [tx.char_class(x) for x in c[1:4]])), lexicon.of_roles(window["roles"]))


class _Numbers:
    """Numbers of keys from 0 on, in the order in which they are first seen."""

    def __init__(self):
        self.known, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of keys, and where in them each new key stands first."""
        at, seen = pd.factorize(keys)
        place, n = np.searchsorted(self.known, seen), len(self.known)
        fresh = np.ones(len(seen), bool)
        inside = place < n
        fresh[inside] = self.known[place[inside]] != seen[inside]
        number, new = np.empty(len(seen), np.int64), np.flatnonzero(fresh)
        number[~fresh] = self.numbers[place[~fresh]]
        number[new] = n + np.arange(len(new))
        by = new[np.argsort(seen[new])]
        self.known, self.numbers = np.insert(self.known, place[by], seen[by]), np.insert(self.numbers, place[by], number[by])
        first = np.empty(len(seen), np.int64)
        first[at[::-1]] = np.arange(len(keys) - 1, -1, -1)
        return number[at], first[new]


class Windows:
    """The `windows` of texts that come in batches, as numbers from 0 on in the order in which they are first seen.

    Keys are the code points themselves and a bit a role, so that no two windows have one number.
    """

    #: The type of a window; what stands for a place outside a text.
    KIND, OUTSIDE = "struct<text:string,pos:int,roles:array<string>>", 0x110000
    #: Roles in code-point order, as `lexicon.roles` has them.
    ROLES = [f"{r}:{n}" for r in "BEM" for n in ("1", "2", "3", "4", "5+")]

    def __init__(self):
        self.left, self.right, self.both = _Numbers(), _Numbers(), _Numbers()

    def put(self, texts: pa.Array, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        """Numbers by position, sizes of texts, and the new windows; found: lexicon matches (start, end) of each text."""
        said = texts.to_pylist()
        size = np.fromiter(map(len, said), np.int64, len(said))
        first, place = np.cumsum(size) - size, np.arange(size.sum()) + np.repeat(4 * np.arange(len(size)) + 2, size)
        char = np.full(size.sum() + 4 * len(size), self.OUTSIDE, np.int64)
        char[place] = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)
        of, i, start, end, _ = lexicon.places(found, size)
        n = np.minimum(end - start, 5)
        role = np.where(i == start, 0, np.where(i == end - 1, 1, 2))
        mask = np.zeros(size.sum(), np.int64)
        np.bitwise_or.at(mask, first[of] + i, 1 << (role * 5 + n - 1))
        left = self.left.put(char[place - 2] << 42 | char[place - 1] << 21 | char[place])[0]
        right = self.right.put(mask << 42 | char[place + 1] << 21 | char[place + 2])[0]
        number, new = self.both.put(left << 31 | right)
        around = char[place[new][:, None] + np.arange(-2, 3)]
        fresh = [
            {"text": "".join(chr(c) for c in cs if c != self.OUTSIDE), "pos": 2 - cs[:2].count(self.OUTSIDE), "roles": [r for k, r in enumerate(self.ROLES) if m >> k & 1]}
            for cs, m in zip(around.tolist(), mask[new].tolist())
        ]
        return number, size, fresh


def emissions(features: DataFrame, weights: DataFrame, key: str = "sid") -> DataFrame:
    """(key, pos, o, b, m, e, s): summed weights (feature, o, b, m, e, s) of each place; unknown ones count 0.

    Weights are whole millionths, so that the sums are exact. The weight
    table is a broadcast only if Spark finds it small.
    """
    lower = [s.lower() for s in STATES]
    return features.join(weights, "feature", "left").groupBy(key, "pos").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in lower])


# Features by what they look at, and how far their place is from there.
_CHARS = {"c0=": 0, "c-1=": 1, "c+1=": -1, "c-2=": 2, "c+2=": -2}
_PAIRS = {"c-1c0=": 1, "c0c+1=": 0}
_TRIPLES = {"c-2c-1c0=": 2, "c0c+1c+2=": 0}
_CLASSES = ("HAN", "DIGIT", "LATIN", "SPACE", "PUNCT", "OTHER", "<")
_LOWER = [s.lower() for s in STATES]


#: A weight table of at most so many features is broadcast; a larger one is joined by shuffle.
BROADCAST_FEATURES = 300_000


def _side(weights: DataFrame):
    """broadcast, or nothing, for tables that have at most a row a feature."""
    return F.broadcast if weights.limit(BROADCAST_FEATURES + 1).count() <= BROADCAST_FEATURES else lambda df: df


def _by_key(weights: DataFrame, names: dict[str, int], key: str) -> DataFrame:
    """(key, a struct of five weights for each name) of the features `name` + key."""
    w = F.struct(*[F.col(s) for s in _LOWER])
    part = [F.when(F.col("feature").startswith(n), F.substring("feature", F.lit(len(n) + 1), F.length("feature"))) for n in names]
    own = weights.select(F.coalesce(*part).alias(key), *[F.when(F.col("feature").startswith(n), w).alias(n) for n in names]).where(F.col(key).isNotNull())
    return own.groupBy(key).agg(*[F.first(f"`{n}`", ignorenulls=True).alias(n) for n in names])


def contexts(weights: DataFrame) -> DataFrame:
    """(before, own, after, o, b, m, e, s): the sums of the bias and all class features, for each three classes."""
    explode = lambda more: F.explode(F.array(*[F.lit(c) for c in (*_CLASSES, *more)]))
    three = weights.sparkSession.range(1).select(explode(["<BOS1>"]).alias("before")).select("*", explode([]).alias("own")).select("*", explode(["<EOS1>"]).alias("after"))
    cat = lambda *parts: F.concat(*[F.lit(x) if x[-1] in "=:" else F.col(x) for x in parts])
    names = F.array(F.lit("bias"), cat("k0=", "own"), cat("k-1=", "before"), cat("k+1=", "after"), cat("k-1k0=", "before", ":", "own"), cat("k0k+1=", "own", ":", "after"))
    rows = three.select("*", F.explode(names).alias("feature")).join(weights, "feature", "left")
    return rows.groupBy("before", "own", "after").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _LOWER])


def scored(sentences: DataFrame, weights: DataFrame, key: str = "sid", text: str = "text", gate: DataFrame | None = None) -> DataFrame:
    """(key, text, pos, o, b, m, e, s, pair, triple): the emissions of each place of the features of `char_features`.

    Equal to `emissions` of these, without a row a feature: a character, a pair
    and a triple are each looked up once, with the weights that they have for
    the places around, and the class features once for three classes. The
    tables are broadcast if Spark finds them small. Sentences are dealt by key
    once, before they are exploded; all else goes on in place.
    pair, triple: whether one of `gate` (key, arity) starts here (null without);
    these also start up to two places before a text.
    """
    side = _side(weights)
    tasks = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as short rows that become many would be put together
    at = lambda d: tx.char_at(F.col(text), F.col("pos") + d)
    n = F.length(text)
    c = sentences.where(n > 0).select(key, text).repartition(tasks, key).select(key, text, n.alias("_n"), F.explode(F.sequence(F.lit(-2), n + 1)).alias("pos"))
    c = c.select("*", *[at(d).alias(f"_c{d}") for d in (-1, 0, 1, 2)])
    c = c.select("*", F.concat("_c0", "_c1").alias("_p"), F.concat("_c0", "_c1", "_c2").alias("_t"), tx.char_class(F.col("_c-1")).alias("before"), tx.char_class(F.col("_c0")).alias("own"), tx.char_class(F.col("_c1")).alias("after"))
    c = c.drop("_c-1", "_c1", "_c2")
    for names, k in ((_CHARS, "_c0"), (_PAIRS, "_p"), (_TRIPLES, "_t")):
        c = c.join(side(_by_key(weights, names, k)), k, "left")
    c = c.join(F.broadcast(contexts(weights)), ["before", "own", "after"], "left")  # 448 rows
    if gate is not None:
        for arity, k, name in ((2, "_p", "pair"), (3, "_t", "triple")):
            c = c.join(side(gate.where(F.col("arity") == arity).select(F.col("key").alias(k), F.lit(True).alias(name)).distinct()), k, "left")
    else:
        c = c.withColumn("pair", F.lit(None).cast("boolean")).withColumn("triple", F.lit(None).cast("boolean"))
    w = Window.partitionBy(key).orderBy("pos")
    names = {k: d for t in (_CHARS, _PAIRS, _TRIPLES) for k, d in t.items()}
    near = c.select(key, text, "_n", "pos", "pair", "triple", *_LOWER, *[(F.lag(f"`{k}`", d).over(w) if d > 0 else F.lead(f"`{k}`", -d).over(w) if d < 0 else F.col(f"`{k}`")).alias(k) for k, d in names.items()])
    total = lambda s: sum((F.coalesce(F.col(f"`{k}`")[s], F.lit(0)) for k in names), F.coalesce(s, F.lit(0)))
    return near.select(key, text, "_n", "pos", *[total(s).alias(s) for s in _LOWER], "pair", "triple")


def in_text(found: DataFrame) -> DataFrame:
    """The rows of `scored` that are places of the text."""
    return found.where("pos >= 0 and pos < _n").drop("_n")


def by_sentence(found: DataFrame, key: str = "sid", text: str = "text") -> DataFrame:
    """(key, text, scores, pairs, triples): rows of `scored` as arrays, without another shuffle.

    pairs, triples: where one of the gate starts.
    """
    inside = (F.col("pos") >= 0) & (F.col("pos") < F.col("_n"))
    rows = F.array_sort(F.collect_list(F.when(inside, F.struct("pos", F.array(*_LOWER).alias("x")))))
    g = found.groupBy(key).agg(F.first(text).alias(text), rows.alias("r"), *[F.array_sort(F.collect_list(F.when(F.col(k), F.col("pos")))).alias(f"{k}s") for k in ("pair", "triple")])
    return g.select(key, text, F.transform("r", lambda r: r["x"]).alias("scores"), "pairs", "triples")


def wide(weights: DataFrame) -> DataFrame:
    """(feature, state, weight) as a row a feature."""
    return weights.groupBy("feature").agg(*[F.sum(F.when(F.col("state") == s, F.col("weight")).otherwise(0)).alias(s.lower()) for s in STATES])


def score_rows(found: DataFrame, key: str = "sid") -> DataFrame:
    """(key, scores): the five scores by position."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.array("o", "b", "m", "e", "s").alias("x"))))
    return found.groupBy(key).agg(F.transform(rows, lambda r: r["x"]).alias("scores"))


def prune(weights: DataFrame, least: float) -> DataFrame:
    return weights.where(F.abs("weight") >= least).withColumn("weight", F.round("weight", 6))


def margins(found: DataFrame, spans: DataFrame, key: str = "sid") -> DataFrame:
    """(key, start, end, margin): mean over a span's places of the chosen score over the best other."""
    role = F.when(F.col("end") - F.col("start") == 1, "s").when(F.col("pos") == F.col("start"), "b").when(F.col("pos") == F.col("end") - 1, "e").otherwise("m")
    s = spans.select(key, "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).withColumn("role", role)
    x = s.join(found, [key, "pos"])
    names = [n.lower() for n in STATES]
    pick = F.coalesce(*[F.when(F.col("role") == n, F.col(n)) for n in names])
    rest = F.coalesce(*[F.when(F.col("role") == n, F.greatest(*[F.col(o) for o in names if o != n])) for n in names])
    return x.groupBy(key, "start", "end").agg((F.sum(pick - rest) / F.count("*")).alias("margin"))
