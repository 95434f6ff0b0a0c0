"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import WORD

_WORDS = re.compile(WORD)
#: Names of the statistics, in the order of `statistics`.
NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "same_neighbour", "log_lines", "same_lines", "words_a_line", "digits", "upper", "symbols", "commas", "stops",
    "spaces", "beyond_ascii", "brackets", "entropy", "long_words", "vowels", "title_words", "distinct_pairs",
)
_LETTER = {c: np.array([b for b in range(256) if chr(b) in s]) for c, s in {"digits": "0123456789", "symbols": "#$%&*@^~|_+=\\", "commas": ",;:", "stops": ".!?", "spaces": " \t\r\n\v\f", "brackets": "<>{}[]()/\"", "vowels": "aeiouAEIOU"}.items()}


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; an empty or null one has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    n = len(raw)
    part = {k: count[v].sum() / n for k, v in _LETTER.items()}
    words = _WORDS.findall(text)
    k = len(words)
    if not k:
        return [math.log1p(n), *[0.0] * (len(NAMES) - 1)]
    length = np.fromiter(map(len, words), np.int32, k)
    lines = [x for x in text.split("\n") if x]
    freq = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = count[count > 0] / n
    return [
        math.log1p(n), math.log1p(k), float(length.mean()), float(length.std()), len(freq) / k, max(freq.values()) / k, same / k, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(k / max(1, len(lines))),
        part["digits"], count[65:91].sum() / n, part["symbols"], part["commas"], part["stops"], part["spaces"], count[128:].sum() / n, part["brackets"], float(-(p * np.log(p)).sum()), float((length > 20).mean()), part["vowels"], sum(map(str.istitle, words)) / k, pairs / max(1, k - 1),
    ]


def matrix(texts) -> np.ndarray:
    """Statistics of texts, a row each."""
    return np.array([statistics(t) for t in texts], np.float32).astype(np.float64).reshape(-1, len(NAMES))


def with_statistics(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., stats binary of float32), computed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [np.array(statistics(t), np.float32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(stats, pa.binary())], names=[*keep, "stats"])

    rows = docs.select(F.col(text_col), *[F.col(c) for c in keep])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("stats", T.BinaryType())]))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on points sorted by x: (last x of each block, its mean)."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            xb, yb, wb = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [xb, (last[1] * last[2] + yb * wb) / (last[2] + wb), last[2] + wb]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


class Model:
    """Standardised statistics -> cosine features -> ridge score -> calibrated probability."""

    def __init__(self, mean, scale, width: float, n_features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, np.float64), np.asarray(scale, np.float64)
        self.freq = rng.standard_normal((len(self.mean), n_features)) / width
        self.phase = rng.uniform(0, 2 * np.pi, n_features)
        self.beta: np.ndarray | None = None
        self.edges, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.freq + self.phase) * math.sqrt(2 / len(self.phase)), z * 0.1, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta if self.beta is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.edges, self.raw(stats), side="left"), len(self.values) - 1)
        return np.clip(self.values[at], 0.0, 1.0)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, len(NAMES)).astype(np.float64)


def fit(train: DataFrame, n_features: int = 384, width: float = 3.0, ridge: float = 1.0, sums: int = 16, bins: int = 2000, seed: int = 11) -> Model:
    """Fit on train(stats binary, y 0/1).

    Partitions sum X'X and X'y over their rows; `sums` such sums reach the
    driver, whatever the number of rows. Calibration pools counts of at most
    `bins` rounded scores. Without rows of both labels the score is the share
    of label 1, or 0.5.
    """
    train = train.repartition(sums).persist()
    try:
        d = len(NAMES)

        def moments(batches):
            n, s, q, pos = 0, np.zeros(d), np.zeros(d), 0.0
            for b in batches:
                x = _matrix(b.column(0).to_pylist())
                n, s, q, pos = n + len(x), s + x.sum(0), q + (x * x).sum(0), pos + float(sum(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_pylist([{"n": n, "pos": pos, "s": s.tolist(), "q": q.tolist()}], schema=pa.schema([("n", pa.int64()), ("pos", pa.float64()), ("s", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))

        got = train.select("stats", "y").mapInArrow(moments, "n long, pos double, s array<double>, q array<double>").collect()
        n, pos = sum(r.n for r in got), sum(r.pos for r in got)
        if not n or pos in (0, n):
            model = Model(np.zeros(d), np.ones(d), width, n_features, seed)
            model.values = np.full(1, pos / n if n else 0.5)
            return model
        mean = np.sum([r.s for r in got], axis=0) / n
        model = Model(mean, np.sqrt(np.maximum(np.sum([r.q for r in got], axis=0) / n - mean * mean, 1e-12)), width, n_features, seed)
        size = n_features + d + 1
        balance = (n / (2 * (n - pos)), n / (2 * pos))  # both labels weigh alike

        def normal(batches):
            a, c = np.zeros((size, size)), np.zeros(size)
            for b in batches:
                x, y = model.features(_matrix(b.column(0).to_pylist())), np.array(b.column(1).to_pylist(), np.float64)
                wx = x * np.where(y > 0.5, balance[1], balance[0])[:, None]
                a += wx.T @ x
                c += wx.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

        a, c = np.zeros((size, size)), np.zeros(size)
        for r in train.select("stats", "y").mapInArrow(normal, "a binary, c binary").toLocalIterator():
            a += np.frombuffer(bytes(r.a)).reshape(size, size)
            c += np.frombuffer(bytes(r.c))
        model.beta = np.linalg.solve(a + ridge * np.eye(size), c)

        def binned(batches):
            seen: Counter = Counter()
            for b in batches:
                at = np.clip(np.rint(model.raw(_matrix(b.column(0).to_pylist())) * bins / 2), -bins // 2, bins).astype(int).tolist()
                seen.update(zip(at, b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pylist([{"b": k[0], "y": k[1], "n": v} for k, v in seen.items()], schema=pa.schema([("b", pa.int64()), ("y", pa.int32()), ("n", pa.int64())]))

        hist = train.select("stats", "y").mapInArrow(binned, "b long, y int, n long").groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("pos")).orderBy("b").collect()
        w = np.array([r.n for r in hist], np.float64)
        edges, model.values = isotonic(np.array([r.b for r in hist], np.float64), np.array([r.pos for r in hist]) / w, w)
        model.edges = (edges + 0.5) * 2 / bins
        return model
    finally:
        train.unpersist()


def held_out(doc_id: Column, parts: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> Model:
    """The model of the labelled rows outside the held-out fold.

    At most about `most_labels` labels (by a hash of the id) are used, so the
    table of labels is broadcast to the texts and only their statistics are
    computed. A document with several labels has the lowest of them; null
    labels and null ids are ignored; of rows of one id each counts.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    n = marks.count()
    if n > most_labels:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most_labels / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id")
    return fit(with_statistics(rows, "text", "y").select("stats", "y"), **fitting)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Score of every document for label 1, learnt from labelled rows outside the held-out fold.

    See `learnt` for the labels that are used; all documents are scored where
    they are read, in one pass without a shuffle. Null and empty texts have
    zero statistics and get a score like any other, very long ones are whole;
    rows with a null id are scored and never learnt from; repeated rows are
    each scored. Without labels every score is 0.5. An empty table gives no
    rows. Label, language, source and id are no inputs; other columns
    are left out, whatever their names. Returns doc_id, held_out, score, predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, id_col=id_col, text_col=text_col, **learning))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(matrix(b.column(1).to_pylist())), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """The rows of docs that score `cut` or more, as they are: each is judged by its own text.

    Rows of one id, or of a null one, are judged apart; all else is as in `classify`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, id_col=id_col, text_col=text_col, **learning))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(matrix(b.column(at).to_pylist())) >= cut))

    return docs.mapInArrow(run, docs.schema)
