"""Averaged structured perceptron: one sequential run, or mixing over partitions."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators import features as ft
from spanforge.operators import tags as tg
from spanforge.operators.viterbi import System, best_path

#: Weights that workers and the driver hold at once.
MOST_WEIGHTS = 20_000_000
#: The states O, B, M, E, S.
GENERIC = System()


class Averaged:
    """Sparse weights and their mean over steps.

    The mean after n steps is the weight less the changes, each times the share
    of steps that were over before it: so a change is booked twice, once as it
    is and once times the number of steps before it.
    """

    def __init__(self, given: dict | None = None):
        self.now: dict[tuple[str, str], float] = defaultdict(float, given or {})
        self.late: dict[tuple[str, str], float] = defaultdict(float)
        self.steps = 0

    def add(self, key: tuple[str, str], by: float) -> None:
        self.now[key] += by
        self.late[key] += by * self.steps

    def mean(self) -> dict[tuple[str, str], float]:
        n = max(1, self.steps)
        return {k: w - self.late[k] / n if k in self.late else w for k, w in self.now.items()}


def predict(weights, features: list[list[str]], system: System = GENERIC) -> list[str]:
    """The best tags by weights (feature or move, state)."""
    states = system.states
    scores = [[sum(weights.get((f, s), 0.0) for f in fs) for s in states] for fs in features]
    start = {i: weights.get(("T=<START>", states[i]), 0.0) for i in system.start}
    moves = {(p, c): weights.get((f"T={states[p]}", states[c]), 0.0) for c, ps in enumerate(system.before) for p in ps}
    return [states[i] for i in best_path(scores, start, moves, system.before, system.final)]


class Tagger:
    """A sequence perceptron over cases whose places are numbers of feature lists: a row of weights for each feature, a column a state.

    Weights are held in whole parts, `unit` to 1, so that sums don't depend on
    their order (exact below 2**53). Feature 0 is none and stays zero; moves
    have the row of the state before, the last row is of the start. Means as
    in `Averaged`. Weights change only at a case that is predicted wrongly,
    so the cases up to the next one are predicted together.
    """

    #: Cases that are predicted together at least, places at most; lists that are summed at once, and whose sums are kept at most.
    LEAST_CASES, MOST_PLACES, MOST_LISTS, MOST_KEPT = 8, 1 << 17, 1 << 14, 1 << 20

    def __init__(self, names: list[str], lists: tuple[np.ndarray, np.ndarray], cases: tuple[np.ndarray, np.ndarray, np.ndarray], system: System = GENERIC, given: dict | None = None, unit: int = 1):
        """names of features from 1 on; lists: numbers of features, sizes; cases: numbers of lists, states, sizes."""
        self.system, self.names, self.unit, n = system, names, unit, len(system.states)
        (self.flat, self.list_size), (self.places, self.gold, self.size) = lists, cases
        self.list_first, self.first = (np.cumsum(x) - x for x in (self.list_size, self.size))
        self.now, self.moves = np.zeros((len(names) + 1, n)), np.zeros((n + 1, n))
        number = {f: i for i, f in enumerate(names, 1)} if given else {}
        self.other = {k: w for k, w in (given or {}).items() if not self._put(number, k, w)}
        self.late, self.late_moves, self.steps = np.zeros_like(self.now), np.zeros_like(self.moves), 0
        self.kept = np.empty((len(self.list_size), n)) if len(self.list_size) <= self.MOST_KEPT else None
        self.summed = np.zeros(len(self.list_size), bool)
        # States in an order that has those before each in the order of ties; states that the same may stand before, by size of both.
        self.order = np.array(list(dict.fromkeys(p for ps in system.before for p in ps)))
        same: dict[tuple, list[int]] = {}
        for c, ps in enumerate(system.before):
            same.setdefault(tuple(ps), []).append(c)
        if any(sorted(ps, key=self.order.tolist().index) != list(ps) for ps in same):
            raise ValueError("states must have one order of ties")
        shapes: dict[tuple[int, int], list] = {}
        for ps, cs in same.items():
            shapes.setdefault((len(ps), len(cs)), []).append((ps, cs))
        self.steps_of = [(np.array([ps for ps, _ in x]), np.array([cs for _, cs in x])) for x in shapes.values()]
        self.barred = np.full((len(self.order), n), -np.inf)
        for c, ps in enumerate(system.before):
            self.barred[np.isin(self.order, ps), c] = 0

    def _put(self, number: dict[str, int], key: tuple[str, str], w: int) -> bool:
        """Take in a given weight, in parts; false if its feature isn't in the cases."""
        f, state = key
        if f.startswith("T=") and (f[2:] in self.system.at or f == "T=<START>"):
            self.moves[self.system.at.get(f[2:], len(self.system.states)), self.system.at[state]] = w
            return True
        if f in number:
            self.now[number[f], self.system.at[state]] = w
        return f in number

    def _sums(self, lists: np.ndarray) -> np.ndarray:
        """The scores of the states for lists of features."""
        out = np.empty((len(lists), len(self.system.states)))
        for i in range(0, len(lists), self.MOST_LISTS):
            part = lists[i : i + self.MOST_LISTS]
            size = self.list_size[part]
            first = np.cumsum(size) - size
            flat = self.flat[np.repeat(self.list_first[part] - first, size) + np.arange(size.sum())]
            out[i : i + self.MOST_LISTS] = np.add.reduceat(self.now[flat], first, axis=0)
        return out

    def _scores(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A table of `_sums`, and the rows of lists in it; a list is summed once between two changes, if they aren't too many to be kept."""
        if self.kept is None:
            own, at = np.unique(lists, return_inverse=True)
            return self._sums(own), at
        new = np.zeros(len(self.summed), bool)
        new[lists] = True
        own = np.flatnonzero(new & ~self.summed)
        self.kept[own], self.summed[own] = self._sums(own), True
        return self.kept, lists

    def predict(self, k: int) -> np.ndarray:
        s, t = self.system, self.moves.tolist()
        table, at = self._scores(self.places[self.first[k] : self.first[k] + self.size[k]])
        moves = {(p, c): t[p][c] for c, ps in enumerate(s.before) for p in ps}
        return np.array(best_path(table[at].tolist(), {i: t[-1][i] for i in s.start}, moves, s.before, s.final), np.int64)

    def _right(self, order: np.ndarray) -> int:
        """The number of cases before the first that `predict` gets wrong: `best_path` over all at once, the longest first.

        A case is right if the best way to the last tag, and to each tag from the one before, is that of its own tags.
        """
        s, size = self.system, self.size[order]
        by = np.argsort(-size, kind="stable")
        size, first = size[by], self.first[order][by]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # cases that have the place t
        start = np.cumsum(live) - live
        at = np.concatenate([np.zeros(0, np.int64), *[first[:k] + t for t, k in enumerate(live)]])
        table, lists = self._scores(self.places[at])
        gold, moves = self.gold[at], self.moves[:-1]
        own, first_moves = moves[self.order] + self.barred, self.moves[-1, s.start][:, None]
        last, right, now = np.zeros((len(s.states), len(order))), np.ones(len(order), bool), None
        for t, k in enumerate(live):
            here = slice(start[t], start[t] + k)
            e = table[lists[here]].T
            then = np.full((len(s.states), k), -np.inf)
            if now is None:
                then[s.start] = e[s.start] + first_moves
            else:
                now = now[:, :k]
                for before, after in self.steps_of:
                    best = now[before[:, 0]][:, None] + moves[before[:, :1], after][:, :, None]
                    x = np.empty_like(best)
                    for p in before.T[1:]:
                        np.maximum(best, np.add(now[p][:, None], moves[p[:, None], after][:, :, None], out=x), out=best)
                    then[after.ravel()] = best.reshape(-1, k)
                then += e
                via = np.argmax(now[self.order] + own[:, gold[here]], axis=0)  # the first of equals
                right[:k] &= self.order[via] == gold[start[t - 1] : start[t - 1] + k]
            now, ended = then, live[t + 1] if t + 1 < len(live) else 0
            last[:, ended:k] = now[:, ended:k]
        filled = size > 0
        ends = gold[(start[size[filled] - 1] + np.flatnonzero(filled))]
        right[filled] &= np.array(s.final)[np.argmax(last[s.final], axis=0)][filled] == ends
        return int(by[~right].min()) if not right.all() else len(order)

    def _update(self, k: int) -> None:
        at, start = slice(self.first[k], self.first[k] + self.size[k]), len(self.system.states)
        lists, gold = self.places[at], self.gold[at].astype(np.int64)
        size = self.list_size[lists]
        flat = np.concatenate([self.flat[i : i + n] for i, n in zip(self.list_first[lists], size)])
        for path, by in ((gold, 1), (self.predict(k), -1)):
            place, before = (flat, np.repeat(path, size)), (np.concatenate([[start], path[:-1]]), path)
            for now, late, where in ((self.now, self.late, place), (self.moves, self.late_moves, before)):
                np.add.at(now, where, by * self.unit)
                np.add.at(late, where, by * self.steps)
        self.now[0] = self.late[0] = 0
        self.summed[:] = False

    def one_pass(self, order: list[int]) -> int:
        """Update on each case that is predicted wrongly, from its own step on; the number of those."""
        order, done, wrong, room = np.array(order, np.int64), 0, 0, self.LEAST_CASES
        while done < len(order):
            some = order[done : done + room]
            some = some[: max(1, np.searchsorted(np.cumsum(self.size[some]), self.MOST_PLACES, side="right"))]
            right = self._right(some)
            self.steps, done = self.steps + right, done + right
            if right == len(some):
                room = 2 * len(some)
                continue
            self._update(some[right])
            self.steps, done, wrong, room = self.steps + 1, done + 1, wrong + 1, max(self.LEAST_CASES, 2 * right)
        return wrong

    def mean(self) -> dict[tuple[str, str], float]:
        n, states = max(1, self.steps), self.system.states
        own, moves = self.now / self.unit - self.late / n, self.moves / self.unit - self.late_moves / n
        out = {k: w / self.unit for k, w in self.other.items()}
        for i, c in np.argwhere(own).tolist():
            out[self.names[i - 1], states[c]] = float(own[i, c])
        for p, name in enumerate((*states, "<START>")):
            out.update({(f"T={name}", states[c]): float(moves[p, c]) for c in np.flatnonzero(moves[p]).tolist()})
        return out


class _Shard:
    """What a task holds of a shard: features numbered, lists by their code, cases as numbers of lists."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.codes, self.flat, self.list_size, self.places, self.gold, self.size = [], [], [], [], [], []
        self.known = None

    def lists(self, codes: pa.Array, features: pa.ListArray) -> None:
        said = features.flatten().dictionary_encode()
        number = np.array([self.number.setdefault(f, len(self.number) + 1) for f in said.dictionary.to_pylist()], np.int32)
        size = features.value_lengths().to_numpy() + 1
        own = np.ones(size.sum(), bool)
        own[np.cumsum(size) - size] = False
        flat = np.zeros(len(own), np.int32)  # feature 0 begins each list, as a sum needs one at least
        flat[own] = number[said.indices.to_numpy()]
        self.flat.append(flat)
        self.list_size.append(size)
        self.codes.append(codes.flatten().to_numpy())

    def cases(self, codes: pa.ListArray, states: pa.ListArray) -> None:
        if self.known is None:
            every = np.concatenate([np.zeros(0, np.int64), *self.codes])
            self.order = np.argsort(every).astype(np.int32)
            self.known, self.codes = every[self.order], []
            if (self.known[1:] == self.known[:-1]).any():
                raise ValueError("two feature lists have one 64-bit code")
        size, gold = codes.value_lengths().to_numpy(), states.flatten().to_numpy()
        if not np.array_equal(size, states.value_lengths().to_numpy()) or (gold < 0).any():
            raise ValueError("cases must have a known tag for each place")
        self.places.append(self.order[np.searchsorted(self.known, codes.flatten().to_numpy())])
        self.gold.append(gold)
        self.size.append(size)

    def texts(self, blocks: pa.RecordBatch) -> None:
        """Lists and cases of `_numbered`."""
        said = blocks["features"].filter(blocks["features"].is_valid())
        if len(said):
            self.lists(pa.array([np.zeros(0, np.int64)]), said)
        for name, held, kind in (("places", self.places, np.int32), ("gold", self.gold, np.int8), ("size", self.size, np.int64)):
            held += [np.frombuffer(x, kind) for x in blocks[name].drop_null().to_pylist()]

    def tagger(self, system: System, given: dict | None = None, unit: int = 1) -> Tagger:
        one = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        lists = one(self.flat, np.int32), one(self.list_size, np.int64)
        cases = one(self.places, np.int32), one(self.gold, np.int8), one(self.size, np.int64)
        self.flat, self.places, self.gold = [], [], []
        return Tagger(list(self.number), lists, cases, system, given, unit)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of equal ones."""
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
    return ((int(shard[i]), i, j) for i, j in zip(cuts, cuts[1:]) if i < j)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """The shards of rows of `_coded` or `_numbered`, one after the other."""
    held, own = None, None
    for b in batches:
        if "places" in b.schema.names:
            for shard, i, j in _runs(b["shard"].to_numpy()):
                if shard != own:
                    if held is not None:
                        yield held
                    held, own = _Shard(), shard
                held.texts(b.slice(i, j - i))
            continue
        kinds = np.stack([b["shard"].to_numpy(), b["features"].is_null().to_numpy(zero_copy_only=False)])
        cuts = [0, *(np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            shard, case = kinds[:, i].tolist()
            if shard != own:
                if held is not None:
                    yield held
                held, own = _Shard(), shard
            x = b.slice(i, j - i)
            if case:
                held.cases(x["codes"], x["states"])
            else:
                held.lists(x["codes"], x["features"])
    if held is not None:
        yield held


def _coded(cases: DataFrame, shards: int, system: System, spell: Callable[[Column], Column]) -> DataFrame:
    """(shard, codes, states, features) of cases (sid, features, tags) by shard: first a row for each feature list, then the cases in the order of sid.

    A list is told by its 64-bit hash (two of the same in a shard are an
    error), so that a place of a case is a number, and features are spelt
    once for each list that differs.
    """
    put = cases.select((F.lit(0) if shards == 1 else F.pmod(F.xxhash64("sid"), F.lit(shards))).cast("int").alias("shard"), "sid", "features", "tags")
    state = F.array(*[F.lit(s) for s in system.states])
    lists = put.select("shard", F.explode_outer("features").alias("f")).where("f is not null").distinct()  # outer: else Spark makes the arrays once more, to filter empty ones
    lists = lists.select("shard", F.lit(None).cast("string").alias("sid"), F.array(F.xxhash64("f")).alias("codes"), F.lit(None).cast("array<tinyint>").alias("states"), spell(F.col("f")).alias("features"))
    own = put.select("shard", "sid", F.transform("features", lambda f: F.xxhash64(f)).alias("codes"), F.transform("tags", lambda t: (F.array_position(state, t) - 1).cast("tinyint")).alias("states"), F.lit(None).cast("array<string>").alias("features"))
    rows = lists.unionByName(own)
    dealt = rows.repartition(1) if shards == 1 else rows.repartitionById(shards, "shard")
    return dealt.sortWithinPartitions("shard", F.col("features").isNull(), "sid", "states").drop("sid")


_BLOCK = pa.schema([("shard", pa.int32()), ("window", pa.struct([("text", pa.string()), ("pos", pa.int32()), ("roles", pa.list_(pa.string()))])), ("places", pa.binary()), ("gold", pa.binary()), ("size", pa.binary())])


def _numbered(texts: DataFrame, shards: int, system: System, typed: bool, spell: Callable[[Column], Column]) -> DataFrame:
    """(shard, features, places, gold, size) of texts (sid, text, spans, found): the features of windows by their number, and blocks of cases.

    The windows of a shard are numbered as its texts come, in the order of
    sid, and told once each; a block has numbers of windows and states as
    bytes, so that no row or array element stands for a place.
    """
    shard = (F.lit(0) if shards == 1 else F.pmod(F.xxhash64("sid"), F.lit(shards))).cast("int").alias("shard")
    put = texts.select(shard, "sid", "text", "spans", "found")
    dealt = put.repartition(1) if shards == 1 else put.repartitionById(shards, "shard")
    rows = dealt.sortWithinPartitions("shard", "sid", "text", "spans").drop("sid")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, own = None, None
        for b in batches:
            for k, i, j in _runs(b["shard"].to_numpy()):
                if k != own:
                    windows, own = ft.Windows(), k
                x = b.slice(i, j - i)
                if x["text"].null_count or x["spans"].null_count:
                    raise ValueError("cases must have a text and spans")
                places, size, fresh = windows.put(x["text"], x["found"])
                gold = tg.numbers(size, x["spans"], system.states, typed)
                if (gold < 0).any():
                    raise ValueError("cases must have a known tag for each place")
                held = [places.astype(np.int32), gold, size]
                none = [None] * len(fresh)
                yield pa.record_batch([[k] * (len(fresh) + 1), [*fresh, None], *[[*none, a.tobytes()] for a in held]], schema=_BLOCK)

    coded = rows.mapInArrow(code, f"shard int, window {ft.Windows.KIND}, places binary, gold binary, size binary")
    return coded.select("shard", F.when(F.col("window").isNotNull(), spell(F.col("window"))).alias("features"), "places", "gold", "size")


def _rows(weights: dict, least: float) -> pd.DataFrame:
    found = sorted((f, s, round(w, 6)) for (f, s), w in weights.items() if abs(w) >= least)
    return pd.DataFrame(found, columns=["feature", "state", "weight"])


def _held(cases: DataFrame, shards: int, system: System, types: tuple[str, ...] | None, spell: Callable[[Column], Column] | None) -> DataFrame:
    if "features" in cases.columns:
        return _coded(cases, shards, system, spell or (lambda f: f))
    return _numbered(cases, shards, system, types is not None, spell or ft.spelt)


_WEIGHTS = "feature string, state string, weight double"


def _batch(rows: pd.DataFrame) -> pa.RecordBatch:
    kind = pa.schema([("feature", pa.string()), ("state", pa.string()), ("weight", pa.float64())])
    return pa.RecordBatch.from_pandas(rows, kind, preserve_index=False)


def train_exact(cases: DataFrame, epochs: int = 5, seed: int = 23, least: float = 0.05, types: tuple[str, ...] | None = None, spell: Callable[[Column], Column] | None = None) -> DataFrame:
    """Weights (feature, state, weight) of one sequential run in a seeded order; generic, or with states of `types`.

    Cases are (sid, features by position, tags by position); `spell` makes an
    array of features of what `features` has for a position, if it isn't one.
    Or they are texts (sid, text, spans, found) with their spans and lexicon
    matches (start, end): then a position has the features of its window, by
    `features.spelt` if `spell` isn't given, and the tag of its span.
    One task sees all cases, as the updates depend on each other; it holds a
    number and a tag for each position, and each list of features once.
    """
    system = System(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            rng, model = random.Random(seed), shard.tagger(system)
            order = list(range(len(model.size)))
            for _ in range(epochs):
                rng.shuffle(order)
                model.one_pass(order)
            yield _batch(_rows(model.mean(), least))

    return _held(cases, 1, system, types, spell).mapInArrow(run, _WEIGHTS)


def train_mixed(cases: DataFrame, shards: int = 8, epochs: int = 5, seed: int = 23, least: float = 0.05, types: tuple[str, ...] | None = None, spell: Callable[[Column], Column] | None = None) -> DataFrame:
    """Iterative parameter mixing: each shard runs a pass from the mixed weights, then the means are mixed.

    Cases and `spell` as in `train_exact`. The weights of one pass come back
    to the driver (one row a feature and state, not a case; MOST_WEIGHTS at
    most) and go out again as a broadcast, in whole millionths of a shard.
    A shard is what one task holds: take more shards for more cases.
    """
    spark, system, unit = cases.sparkSession, System(types), 1_000_000 * shards
    put = _held(cases, shards, system, types, spell).persist()
    mixed: dict[tuple[str, str], int] = {}
    try:
        for epoch in range(epochs):
            given = spark.sparkContext.broadcast(mixed)

            def run(batches: Iterator[pa.RecordBatch], epoch=epoch, given=given) -> Iterator[pa.RecordBatch]:
                for shard in _shards(batches):
                    model = shard.tagger(system, given.value, unit)
                    order = list(range(len(model.size)))
                    random.Random(seed + epoch).shuffle(order)
                    model.one_pass(order)
                    yield _batch(_rows(model.mean(), 0.0))

            found = put.mapInArrow(run, _WEIGHTS).groupBy("feature", "state").agg(F.sum(F.round(F.col("weight") * 1_000_000).cast("long")).alias("w"))
            mixed = {(r.feature, r.state): r.w for r in found.limit(MOST_WEIGHTS + 1).toLocalIterator() if r.w}
            if len(mixed) > MOST_WEIGHTS:
                raise ValueError(f"more than {MOST_WEIGHTS} weights")
    finally:
        put.unpersist()
    return spark.createDataFrame(_rows({k: w / unit for k, w in mixed.items()}, least), _WEIGHTS)


def train_spans(candidates: DataFrame, epochs: int = 5, seed: int = 29, least: float = 0.05, positive: float = 4.0) -> DataFrame:
    """Weights of a multiclass perceptron over candidates (cid, features, sources, gold); NONE is a label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(list(f), list(s), g) for f, s, g in pdf.sort_values("cid")[["features", "sources", "gold"]].itertuples(index=False)]
        rng, model = random.Random(seed), Averaged()
        for _ in range(epochs):
            rng.shuffle(own)
            for fs, sources, gold in own:
                score = {c: sum(model.now.get((f, c), 0.0) for f in fs) for c in ["NONE", *sources]}
                said = max(score, key=lambda c: score[c])
                if said != gold:
                    by = 1.0 if gold == "NONE" else positive
                    for f in fs:
                        model.add((f, gold), by)
                        model.add((f, said), -by)
                model.steps += 1
        return _rows(model.mean(), least)

    return candidates.select("cid", "features", "sources", "gold", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(run, _WEIGHTS)


def training_cases(features: DataFrame, tagged: DataFrame, key: str = "sid") -> DataFrame:
    """(sid, features by position, tags by position)."""
    per = features.groupBy(key, "pos").agg(F.array_sort(F.collect_list("feature")).alias("fs"))
    rows = per.join(tagged.select(key, "pos", "tag"), [key, "pos"])
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "fs", "tag"))).alias("r"))
    return g.select(F.col(key).cast("string").alias("sid"), F.transform("r", lambda r: r["fs"]).alias("features"), F.transform("r", lambda r: r["tag"]).alias("tags"))
