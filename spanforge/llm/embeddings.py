"""Embedding near-duplicates: int8 tile products with rigorous error bounds, then full precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import stored
from spanforge.llm.graph import components


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as float32, scale, error bound) of unit rows.

    error is the Euclidean norm of what rounding took from the row, so that
    |x.y - s_x s_y q_x.q_y| <= e_x + e_y + e_x e_y for unit rows x and y.
    Products of int8 codes are summed in float32, which is exact below 2**24,
    that is for up to 1040 dimensions; beyond, they are summed in float64.
    """
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-12) + 1e-15
    return codes.astype(np.float32 if x.shape[1] <= 1040 else np.float64), scale, error


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, chunk: int = 65536):
    """Yield (rows of a, rows of b) with cosine >= threshold in double precision; i < j if same."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    (qa, sa, ea), (qb, sb, eb) = quantise(ua), quantise(ub)
    approx = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    approx += ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :]
    i, j = np.nonzero(approx >= threshold - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    for k in range(0, len(i), chunk):
        p, q = i[k : k + chunk], j[k : k + chunk]
        cos = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
        hit = cos >= threshold
        if hit.any():
            yield p[hit], q[hit]


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _join_all(forest: Forest, p: np.ndarray, q: np.ndarray) -> None:
    find, up = forest.find, forest.up
    for a, b in zip(p.tolist(), q.tolist(), strict=True):
        if up[a] != up[b]:
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label with cosine >= threshold; one row for each row given.

    Equal vectors of a label are first folded into one representative with
    its count, so a large group of copies costs one row. Representatives are
    dealt by hash into tiles of about `tile` rows; every two tiles of a label
    are multiplied as int8 codes, pairs that the error bounds can't exclude
    are computed again in double precision. A pair of tiles returns a count
    for each representative and a spanning forest of its links, never pairs.
    Vectors of floats travel as floats, a tile of n vectors as one row; a label
    of k tiles sends each k times, as all its vectors are compared.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows whose label is null, link with nothing; so do vectors of unlike
    length. A null id is a row with component null; rows with a repeated id
    count as several vectors. An empty table gives no rows; other columns are
    left out. Returns vec_id, n_links, component_id, kept.
    """
    e = F.col(vector_col)
    narrow = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kept, number = ("array<float>", np.float32) if narrow else ("array<double>", np.float64)
    usable = F.col(label_col).isNotNull() & e.isNotNull() & (F.size(e) > 0)
    usable = usable & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), e.cast(kept).alias("e"), F.coalesce(usable, F.lit(False)).alias("ok"))
    reps = rows.where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = reps.withColumn("key", F.xxhash64("label", "e")).withColumn("dim", F.size("e"))
    reps = stored(reps, "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    put = reps.join(sizes, ["label", "dim"]).withColumn("t", F.pmod("key", F.col("tiles")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m = np.array(pdf["e"].tolist(), dtype=number)
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "tiles": [first["tiles"]], "t": [first["t"]], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    kind = rows.schema["label"].dataType.simpleString()
    packed = put.groupBy("label", "dim", "t").applyInPandas(pack, f"label {kind}, dim int, tiles int, t int, keys binary, copies binary, m binary")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j")))
    met = packed.withColumn("pair", F.explode(pair))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        load = lambda r: (np.frombuffer(r["keys"], np.int64), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["m"], number).astype(np.float64).reshape(-1, r["dim"]))
        ka, ca, a = load(pdf.iloc[0])
        kb, cb, b = load(pdf.iloc[-1])
        same = len(pdf) == 1
        i, j = pdf.iloc[0]["pair"]["i"], pdf.iloc[0]["pair"]["j"]
        keys, count = (ka, np.zeros(len(ka), np.int64)) if i == j else (np.concatenate([ka, kb]), np.zeros(len(ka) + len(kb), np.int64))
        forest = Forest(len(keys))
        if i == j or not same:  # a tile whose partner is empty meets nobody
            for p, q in tile_links(a, b, threshold, i == j):
                shift = 0 if i == j else len(ka)
                np.add.at(count, p, cb[q])
                np.add.at(count, q + shift, ca[p])
                _join_all(forest, p, q + shift)
        roots = np.array([forest.find(x) for x in range(len(keys))], dtype=np.int64)
        hit = count > 0
        return pd.DataFrame({"key": keys[hit], "root": keys[roots[hit]], "links": count[hit]})

    found = stored(met.groupBy("label", "dim", "pair").applyInPandas(compare, "key long, root long, links long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found, "key", "root")
    named = reps.select("key", "rep", "copies").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    known = named.join(smallest, "c").join(links, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", F.when(F.col("ok"), F.xxhash64("label", "e")).alias("key")).join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
