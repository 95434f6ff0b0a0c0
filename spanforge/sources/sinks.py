"""Writers: label rows, cases, manifests, lexicons, weights, digests."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import labels


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_cases(rows: DataFrame, path: str) -> None:
    """Tab-separated cases of (text, spans)."""
    rows.select(F.concat_ws("\t", "text", labels.encode(F.col("spans")))).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Rows with a split, a folder each, as JSON lines."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_lexicon(words: DataFrame, path: str) -> None:
    """Sorted distinct words without those that start with `#`, one a line."""
    words.select("word").where(~F.col("word").startswith("#")).distinct().orderBy("word").write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, path: str, about: dict) -> None:
    """The weight table as Parquet, and a file that tells about it."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    note = weights.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True, ensure_ascii=False),)], "value string")
    note.coalesce(1).write.mode("overwrite").text(f"{path}/about")


def manifest(rows: DataFrame, **about) -> DataFrame:
    """One row: counts of rows and groups, and of entities by type as JSON."""
    n = rows.agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"))
    kinds = rows.select(F.explode("spans").alias("s")).groupBy(F.col("s.type").alias("type")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    return n.join(kinds, F.lit(True)).select("rows", "groups", F.to_json("types").alias("types"), *[F.lit(v).alias(k) for k, v in about.items()])


def digest(path: str) -> str:
    """SHA-256 of a local file."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def write_digest(path: str) -> str:
    """A side file `<path>.sha256`: digest, two spaces, name."""
    name = path.rsplit("/", 1)[-1]
    with open(f"{path}.sha256", "w", encoding="utf-8") as f:
        f.write(f"{digest(path)}  {name}\n")
    return f"{path}.sha256"


#: Header of the packed weight table: mark, version, number of records.
MARK, VERSION = b"SFWGTS01", 1


def pack_weights(weights: DataFrame, path: str) -> int:
    """A local little-endian file of (feature, five float32) records sorted by feature; streams through the driver."""
    n = weights.count()
    with open(path, "wb") as f:
        f.write(struct.pack("<8sIQ", MARK, VERSION, n))
        for r in weights.orderBy("feature").select("feature", "o", "b", "m", "e", "s").toLocalIterator():
            name = r.feature.encode()
            f.write(struct.pack("<H", len(name)) + name + struct.pack("<5f", *(x / 1_000_000 for x in r[1:])))
    return n


def unpack_weights(path: str) -> list[tuple]:
    """Read and check such a file: mark, version, order, finite weights, exact length."""
    import math

    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 20:
        raise ValueError("truncated")
    mark, version, n = struct.unpack_from("<8sIQ", raw)
    if mark != MARK or version != VERSION:
        raise ValueError("not a weight table of this version")
    at, out = 20, []
    try:
        for _ in range(n):
            (k,) = struct.unpack_from("<H", raw, at)
            name = raw[at + 2 : at + 2 + k].decode()
            w = struct.unpack_from("<5f", raw, at + 2 + k)
            at += 2 + k + 20
            if out and out[-1][0] >= name or not all(map(math.isfinite, w)):
                raise ValueError(f"bad record {name!r}")
            out.append((name, *w))
    except struct.error as e:
        raise ValueError("truncated") from e
    if at != len(raw):
        raise ValueError("bytes left over")
    return out
