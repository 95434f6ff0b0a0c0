"""Language-model scoring by Katz backoff over hashed n-gram tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import exchange
from spanforge.llm.common import stored
from spanforge.llm.exchange import Block, mix, pack, pack_sorted, unpack, unpack_sorted

#: Counts above this are not discounted.
TOP = 5
_BASE = np.uint64(0x100000001B3)
#: Symbols for the start of a text, which is no token, and its end, which is one.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def good_turing(n: list[int]) -> np.ndarray:
    """Factors for counts 0..TOP (0 for none) from n[r], the number of n-grams with count r.

    Katz's factors; where the counts of counts don't give factors in (0, 1),
    as in small corpora, half a count is taken off instead.
    """
    d = np.ones(TOP + 1)
    d[0] = 0.0
    r = np.arange(1, TOP + 1)
    if min(n[1 : TOP + 2]) > 0:
        top = (TOP + 1) * n[TOP + 1] / n[1]
        star = np.array([(k + 1) * n[k + 1] / n[k] for k in r])
        found = (star / r - top) / (1 - top) if top < 1 else np.zeros(TOP)
        if (found > 0).all() and (found < 1).all():
            d[1:] = found
            return d
    d[1:] = (r - 0.5) / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count > TOP, 1.0, d[np.minimum(count, TOP)]) * count


class Level:
    """What the driver knows of an order: its factors; for single tokens also totals."""

    def __init__(self, n: list[int], tokens: int, types: int):
        self.d, self.tokens, self.types = good_turing(n), tokens, types
        known = 1.0 - sum((1 - self.d[r]) * r * n[r] for r in range(1, TOP + 1)) / tokens if tokens else 0.0
        self.unknown = max(1.0 - known, 1.0 / (tokens + 1))
        self.scale = (1.0 - self.unknown) / (known * tokens) if known > 0 else 0.0


class Grams:
    """A block as symbols with a start and an end for each document, and its n-grams."""

    def __init__(self, row: dict, held: tuple[int, int]):
        b = self.block = Block(row)
        n = b.counts
        self.first = np.concatenate([[0], np.cumsum(n + 2)])
        size = int(self.first[-1])
        s = np.full(size, START, np.uint64)
        s[self.first[1:] - 1] = END
        word = np.ones(size, bool)
        word[self.first[:-1]] = word[self.first[1:] - 1] = False
        if len(b.at):
            s[word] = b.hashes()[b.at]
        self.symbols = mix(s)
        self.doc = np.repeat(np.arange(len(n)), n + 2)
        self.pos = np.arange(size) - self.first[:-1][self.doc]
        self.held = np.array([i is not None and zlib.crc32(str(i).encode()) % held[0] == held[1] for i in b.ids], bool)
        self.train = ~self.held[self.doc] if size else np.zeros(0, bool)
        self.keys: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}
        self.owned: dict[int, np.ndarray] = {}
        self.chance: dict[int, np.ndarray] = {}

    def key(self, m: int) -> np.ndarray:
        """Hash of the m symbols that end at each place."""
        if m not in self.keys:
            x = self.symbols if m == 1 else mix(np.concatenate([self.key(m - 1)[:1], self.key(m - 1)[:-1]]) * _BASE + self.symbols)
            self.keys[m] = x
        return self.keys[m]

    def valid(self, m: int) -> np.ndarray:
        """Places of m-grams; the start stands alone as a history only."""
        return self.pos >= max(m - 1, 0)

    def distinct(self, m: int):
        """(sorted distinct keys, number of each valid place, training count, a place of each)."""
        at = np.flatnonzero(self.valid(m))
        keys, place, number = np.unique(self.key(m)[at], return_index=True, return_inverse=True)
        return keys, number, np.bincount(number, weights=self.train[at], minlength=len(keys)).astype(np.int64), at[place], at

    def learn(self, m: int, said: np.ndarray) -> None:
        """Take in answers 2 * count + owned."""
        keys, number, _, place, at = self.distinct(m)
        self.count[m] = np.zeros(len(self.pos), np.int64)
        self.count[m][at] = (said >> 1)[number]
        self.owned[m] = place[(said & 1) == 1] if len(said) else place[:0]

    def base(self, level: Level) -> None:
        c = self.count[1]
        self.chance[1] = np.where(c > 0, discounted(c, level.d) * level.scale, level.unknown)

    def history(self, m: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and training count of the history of the m-gram at each place."""
        return self.key(m - 1)[places - 1], self.count[m - 1][places - 1]

    def sums(self, m: int, d: np.ndarray):
        """For the histories of owned m-grams: their discounted counts and lower-order chances, summed."""
        p = self.owned[m]
        p = p[self.count[m][p] > 0]
        h, _ = self.history(m, p)
        keys, number = np.unique(h, return_inverse=True)
        return keys, np.bincount(number, weights=discounted(self.count[m][p], d), minlength=len(keys)), np.bincount(number, weights=self.chance[m - 1][p], minlength=len(keys))

    def wanted(self, m: int):
        """Places of m-grams whose history was seen, and the sorted distinct keys of those histories."""
        p = np.flatnonzero(self.valid(m) & (self.pos >= 1))
        h, c = self.history(m, p)
        p, h = p[c > 0], h[c > 0]
        return p, *np.unique(h, return_inverse=True)

    def back_off(self, m: int, d: np.ndarray, sums: np.ndarray) -> None:
        """Chances of order m from the sums over each wanted history: seen, or backed off."""
        p, _, number = self.wanted(m)
        c, (_, h) = self.count[m][p], self.history(m, p)
        mass, lower = sums[:, 0][number], sums[:, 1][number]
        keep = np.where(mass >= h * (1 - 1e-12), h / (h + 1.0), 1.0)  # something is left for what wasn't seen
        alpha = (1.0 - keep * mass / h) / (1.0 - lower)
        self.chance[m] = self.chance[m - 1].copy()
        self.chance[m][p] = np.where(c > 0, keep * discounted(c, d) / h, alpha * self.chance[m - 1][p])


_STATS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("data", pa.binary()), ("size", pa.int32())])
#: Rows of a bucket that aren't answers to a block: counts of counts, and its part of the model's table.
_COUNTED, _KEYS, _VALUES = "#", "=keys", "=values"


def _table(bucket: int, keys: np.ndarray, values: np.ndarray) -> list[dict]:
    """A bucket's part of a table: its sorted keys, and eight bytes or so for each."""
    (k, ks), (v, vs) = pack_sorted(keys), pack(values)
    return [{"block": _KEYS, "bucket": bucket, "data": k, "size": ks}, {"block": _VALUES, "bucket": bucket, "data": v, "size": vs}]


def _counts(t: pa.Table, skip: np.uint64 | None) -> pa.Table:
    """Counts of a bucket over all blocks: an answer to each, a row of counts of counts, and the table."""
    rows = t.sort_by("block").to_pylist()
    lists = [unpack_sorted(r["hashes"], r["hashes_size"]) for r in rows]
    own = np.concatenate([unpack(r["extra"], r["extra_size"], np.uint32) for r in rows]).astype(np.int64)
    keys, first, number = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    total = np.bincount(number, weights=own, minlength=len(keys)).astype(np.int64)
    said = total[number] * 2
    said[first] += 1
    out, start = [], 0
    for r, x in zip(rows, lists, strict=True):
        data, size = pack(said[start : start + len(x)].astype(np.uint32) if said.max(initial=0) < 2**32 else said[start : start + len(x)].astype(np.uint64))
        out.append({"block": r["block"], "bucket": r["bucket"] * 2 + (said.max(initial=0) >= 2**32), "data": data, "size": size})
        start += len(x)
    seen = total if skip is None else total[keys != skip]
    hist = np.bincount(np.minimum(seen, TOP + 2), minlength=TOP + 3)
    stats = np.concatenate([hist, [seen.sum(), (seen > 0).sum()]]).astype(np.int64).tobytes()
    out.append({"block": _COUNTED, "bucket": rows[0]["bucket"], "data": stats, "size": len(stats)})
    return pa.Table.from_pylist(out + _table(rows[0]["bucket"], keys[total > 0], total[total > 0]), schema=_STATS)


def _read_counts(t: pa.Table) -> np.ndarray:
    rows = t.sort_by("bucket").to_pylist()
    return np.concatenate([unpack(r["data"], r["size"], np.uint64 if r["bucket"] & 1 else np.uint32).astype(np.int64) for r in rows]) if rows else np.zeros(0, np.int64)


def _totals(t: pa.Table) -> pa.Table:
    """Sums of a bucket's histories over all blocks, for the blocks that want them, and the table."""
    rows = t.sort_by("block").to_pylist()
    lists = [unpack_sorted(r["hashes"], r["hashes_size"]) for r in rows]
    extra = [unpack(r["extra"], r["extra_size"], "V16").view(np.float64) for r in rows]
    keys, number = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros((len(keys), 2))
    out = []
    for want in (False, True):
        start = 0
        for r, x, e in zip(rows, lists, extra, strict=True):
            at = number[start : start + len(x)]
            start += len(x)
            if r["block"].startswith("?") == want:
                if want:
                    data, size = pack(np.ascontiguousarray(total[at]).reshape(-1))
                    out.append({"block": r["block"][1:], "bucket": r["bucket"], "data": data, "size": size})
                else:
                    total[at] += e.reshape(-1, 2)
    some = total[:, 0] > 0
    return pa.Table.from_pylist(out + _table(rows[0]["bucket"], keys[some], np.ascontiguousarray(total[some]).view("V16").reshape(-1)), schema=_STATS)


def _looked_up(kind: str, t: pa.Table, table: pa.Table) -> pa.Table:
    """Answers to the requests of a bucket from its part of a stored table: zeros for what isn't there."""
    part = {r["block"]: r for r in table.to_pylist()}
    keys = unpack_sorted(part[_KEYS]["data"], part[_KEYS]["size"]) if part else np.zeros(0, np.uint64)
    width = np.int64 if kind == "count" else np.dtype("V16")
    values = unpack(part[_VALUES]["data"], part[_VALUES]["size"], width) if len(keys) else np.zeros(0, width)
    out = []
    for r in t.to_pylist():
        asked = unpack_sorted(r["hashes"], r["hashes_size"])
        at = np.searchsorted(keys, asked)
        at[at == len(keys)] = 0
        known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        said = np.zeros(len(asked), width)
        said[known] = values[at[known]]
        data, size = pack((said * 2).astype(np.uint64) if kind == "count" else said.view(np.float64))
        out.append({"block": r["block"], "bucket": r["bucket"] * 2 + 1 if kind == "count" else r["bucket"], "data": data, "size": size})
    return pa.Table.from_pylist(out, schema=_STATS)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Steps:
    """What blocks have been told so far, order by order, and how they go on from it."""

    def __init__(self, made: DataFrame, fold: tuple[int, int], buckets: int, levels: dict[int, Level]):
        self.made, self.fold, self.buckets, self.levels = made, fold, buckets, levels
        self.answers: list[tuple[str, int, DataFrame]] = []

    def told(self) -> DataFrame:
        out = None
        for k, (_, _, df) in enumerate(self.answers):
            part = df.where("block <> '#' and not startswith(block, '=')").withColumn("stage", F.lit(k))
            out = part if out is None else out.union(part)
        return out

    def each(self, one: Callable[[dict, Grams], list[dict]], schema: str, kind: pa.Schema) -> DataFrame:
        """one(row, its Grams with all that it has been told) -> rows, for each block."""
        fold, levels, seen = self.fold, dict(self.levels), [(k, m) for k, m, _ in self.answers]

        def known(row: dict, said: pa.Table | None) -> Grams:
            g = Grams(row, fold)
            for k, (what, m) in enumerate(seen):
                own = said.filter(pc.equal(said["stage"], k))
                if what == "count":
                    g.learn(m, _read_counts(own))
                    if m == 1:
                        g.base(levels[1])
                else:
                    got = own.sort_by("bucket").to_pylist()
                    g.back_off(m, levels[m].d, np.concatenate([unpack(r["data"], r["size"], np.float64) for r in got]).reshape(-1, 2) if got else np.zeros((0, 2)))
            return g

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield from pa.Table.from_pylist(one(row, known(row, None)), schema=kind).to_batches()

        def later(t: pa.Table, said: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([x for row in t.to_pylist() for x in one(row, known(row, said))], schema=kind)

        if not seen:
            return self.made.mapInArrow(first, schema)
        return self.made.groupBy("block").cogroup(self.told().groupBy("block")).applyInArrow(later, schema)

    def ask_counts(self, m: int) -> DataFrame:
        """Asks for the counts of a block's m-grams, and tells its own."""
        buckets = self.buckets

        def one(row: dict, g: Grams) -> list[dict]:
            keys, _, count, _, _ = g.distinct(m)
            return exchange.questions(row["block"], keys, count.astype(np.uint32), buckets)

        return self.each(one, exchange.ASK, exchange._ASK)

    def ask_sums(self, m: int, add: bool) -> DataFrame:
        """Asks for the sums of wanted histories; with `add`, sends those over owned m-grams too."""
        buckets, d = self.buckets, self.levels[m].d

        def one(row: dict, g: Grams) -> list[dict]:
            out = []
            if add:
                keys, mass, lower = g.sums(m, d)
                out = exchange.questions(row["block"], keys, np.stack([mass, lower], axis=1).view("V16").reshape(-1), buckets)
            _, keys, _ = g.wanted(m)
            return out + exchange.questions(("?" if add else "") + row["block"], keys, np.zeros(len(keys), "V16"), buckets)

        return self.each(one, exchange.ASK, exchange._ASK)

    def scores(self, order: int) -> DataFrame:
        total, types = self.levels[1].tokens, self.levels[1].types

        def one(row: dict, g: Grams) -> list[dict]:
            token = np.flatnonzero(g.pos >= 1)
            c, doc, n = g.count[1][token], g.doc[token], len(g.block.ids)
            per = lambda x: np.bincount(doc, weights=x, minlength=n)
            base = per(np.log10((c + 1.0) / (total + types + 1.0)))
            best = per(np.log10(g.chance[order][token]))
            size, seen = per(np.ones(len(token))).astype(int).tolist(), per(c > 0).astype(int).tolist()
            return [
                {"doc_id": doc_id, "held_out": bool(g.held[k]), "n_tokens": size[k], "n_known": seen[k], "train_tokens": total, "base_score": float(base[k]), "score": float(best[k])} for k, doc_id in enumerate(g.block.ids)
            ]

        return self.each(one, SCORED, _SCORED)


class Model:
    """A trained model: for each order a table of counts and one of the sums behind the backoff weights.

    tables: (kind, order) -> stored rows (block, bucket, data, size), one pair
    for each bucket of n-gram hashes; these are the partitions. levels: what the
    driver knows of each order.
    """

    def __init__(self, order: int, buckets: int, fold: tuple[int, int], levels: dict[int, Level], tables: dict[tuple[str, int], DataFrame]):
        self.order, self.buckets, self.fold, self.levels, self.tables = order, buckets, fold, levels, tables

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1 << 21) -> DataFrame:
        """Scores of any documents by the stored tables; columns and rules as in `score`."""
        made = stored(exchange.blocks(docs, id_col, text_col, lower=True, block_words=block_words), "blocks")
        steps = Steps(made, self.fold, self.buckets, self.levels)
        for m in range(1, self.order + 1):
            for kind in ("count", "sums") if m > 1 else ("count",):
                table = self.tables[kind, m].where("startswith(block, '=')")

                def run(t: pa.Table, own: pa.Table, kind=kind) -> pa.Table:
                    return _looked_up(kind, t, own)

                asks = steps.ask_counts(m) if kind == "count" else steps.ask_sums(m, False)
                steps.answers.append((kind, m, stored(asks.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_two(run), exchange.ANSWER), kind)))
        return steps.scores(self.order)


def _two(f):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right)

    return run


def _learnt(docs: DataFrame, order: int, folds: int, held_out: int, id_col: str, text_col: str, block_words: int) -> tuple[Model, Steps]:
    """The model of the documents that aren't held out, and what all documents were told on the way."""
    made = stored(exchange.blocks(docs, id_col, text_col, lower=True, block_words=block_words), "blocks")
    steps = Steps(made, (folds, held_out), exchange.buckets_of(made), {})
    start_key = mix(np.array([START], np.uint64))[0]

    def counter(skip: np.uint64 | None):
        def run(t: pa.Table) -> pa.Table:
            return _counts(t, skip)

        return run

    for m in range(1, order + 1):
        df = stored(steps.ask_counts(m).groupBy("bucket").applyInArrow(counter(start_key if m == 1 else None), exchange.ANSWER), f"count{m}")
        stats = np.array([np.frombuffer(bytes(r.data), np.int64) for r in df.where("block = '#'").select("data").toLocalIterator()]).reshape(-1, TOP + 5).sum(axis=0)
        steps.levels[m] = Level(stats[: TOP + 3].tolist(), int(stats[-2]), int(stats[-1]))
        steps.answers.append(("count", m, df))
        if m > 1:
            steps.answers.append(("sums", m, stored(steps.ask_sums(m, True).groupBy("bucket").applyInArrow(_totals, exchange.ANSWER), f"sums{m}")))
    return Model(order, steps.buckets, steps.fold, steps.levels, {(kind, m): df for kind, m, df in steps.answers}), steps


def train(docs: DataFrame, order: int = 2, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1 << 21) -> Model:
    """The model of `score`, to score other documents with."""
    return _learnt(docs, order, folds, held_out, id_col, text_col, block_words)[0]


def score(docs: DataFrame, order: int = 2, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1 << 21) -> DataFrame:
    """log10 probability of every whole text under a Katz model of the documents that aren't held out.

    Tokens: lower-case (A-Z) words, then one end. Single tokens have
    Good-Turing discounted chances, what is left is the chance of the one
    unknown type, as in the base. An n-gram that was seen has its discounted
    relative count; else its history's backoff weight times the chance of one
    order less, recursively; a history that wasn't seen is passed over. Weights
    are exact: 1 - (sum of the seen) over 1 - (sum of the same, one order less).

    Counts of all training documents meet by a 64-bit hash in buckets, which are
    the partitions of the stored tables (see `Model`); a block of documents
    asks for each of its n-grams once and is answered with the count in the same
    pass. One block owns each n-gram and adds it to its history's sums, so a
    history of a third of all tokens is one item a block. The driver sees counts
    of counts only. Two n-grams of one hash would be one: with 2**40 of them, a
    chance of one in 16 million for each.

    held_out: crc32 of the id as text, modulo `folds`, is `held_out`; null ids
    aren't. Null texts are empty: one token, the end. Very long texts are whole.
    Repeated rows count each. An empty table gives no rows; other columns are
    left out, whatever their names. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.
    """
    return _learnt(docs, order, folds, held_out, id_col, text_col, block_words)[1].scores(order)
