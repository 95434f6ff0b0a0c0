"""Blocks of documents that ask, by hash buckets, about what other blocks hold.

A block is what a task holds at once: some documents as positions into a list
of their distinct words. Blocks send sorted hashes to buckets, where those of
all blocks meet, and get an answer of one item for each hash. Each block
asks once about a hash, however often it occurs in it, so that no key is hot;
lists travel compressed. The number of buckets follows the number of words, so
that what meets in one has a bound at every size of the input; on very large
inputs a block has few items for each bucket, and lists come near plain rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import WORD

#: Word positions in a block: one document or so many. Positions of the corpus for each bucket.
BLOCK_WORDS, BUCKET_WORDS = 1 << 20, 1 << 21
BLOCK = "block string, words binary, words_size int, at binary, at_size int, ids array<bigint>, counts array<int>, rows binary, gaps binary, gaps_size int, gap_at binary, gap_at_size int"
#: The columns of a block that its questions need; the others wait for the answer.
ASKING = ["block", "words", "words_size", "at", "at_size", "ids", "counts"]
_ARROW = pa.schema([
    ("block", pa.string()), ("words", pa.binary()), ("words_size", pa.int32()), ("at", pa.binary()), ("at_size", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
    ("rows", pa.binary()), ("gaps", pa.binary()), ("gaps_size", pa.int32()), ("gap_at", pa.binary()), ("gap_at_size", pa.int32()),
])


_CODEC = pa.Codec("zstd", compression_level=3)


def squeeze(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True) if raw else b""


def stretch(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack(x: np.ndarray) -> tuple[bytes, int]:
    """Compress integers byte plane by byte plane; sorted ones as steps."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    raw = planes.tobytes()
    return squeeze(raw), len(raw)


def unpack(blob: bytes, size: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(stretch(blob, size), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(x: np.ndarray) -> tuple[bytes, int]:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes, size: int, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(blob, size, dtype), dtype=dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def buckets_of(made: DataFrame) -> int:
    """A power of two, about a bucket for BUCKET_WORDS positions of all blocks, 32 at least."""
    n = made.select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return 1 << max(5, (n // BUCKET_WORDS).bit_length())


class Block:
    """A block as arrays: words, at (position -> word), ids, first (start of each document)."""

    def __init__(self, row: dict):
        self.name = row["block"]
        raw = stretch(row["words"], row["words_size"])
        self.words = raw.decode("utf-8", "surrogatepass").split(" ") if raw else []
        self.at = unpack(row["at"], row["at_size"], np.uint32)
        self.ids, self._row = row["ids"], row
        self.counts = np.array(row["counts"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def rows(self) -> pa.Array | None:
        """What was carried along with each document."""
        raw = self._row.get("rows")
        return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks() if raw else None

    def texts(self, wanted) -> dict[int, str]:
        """The texts of some documents as they were, from words and what stood between them."""
        r = self._row
        gaps = json.loads(stretch(r["gaps"], r["gaps_size"])) if r["gaps_size"] else []
        at = unpack(r["gap_at"], r["gap_at_size"], np.uint32)
        out = {}
        for i in wanted:
            a, b = int(self.first[i]), int(self.first[i + 1])
            parts = [""] * (2 * (b - a) + 1)
            parts[0::2] = [gaps[g] for g in at[a + i : b + i + 1].tolist()]
            parts[1::2] = [self.words[k] for k in self.at[a:b].tolist()]
            out[i] = "".join(parts)
        return out

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words), np.uint64, len(self.words))

    def numbers(self) -> np.ndarray:
        """Document ids as integers; null is above all others."""
        return np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)

    def doc(self) -> np.ndarray:
        """Index of the document of each position."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _bytes(rows: list[pa.Array]) -> bytes:
    """Rows of one type as an Arrow stream."""
    whole = pa.concat_arrays(rows)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("row", whole.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([whole], names=["row"]))
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, id_col: str, text_col: str, carried: Column | None = None, lower: bool = False, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """Documents as blocks.

    carried: what each row takes along, of any type. lower: A-Z as a-z. whole:
    keep what stands between the words too, for `Block.texts`.
    """
    find, between = re.compile(WORD).findall, re.compile(WORD).split
    table = {c: c + 32 for c in range(65, 91)}
    taken = [carried.alias("_row")] if carried is not None else []
    along = bool(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, 0
        known: dict[str, int] = {}
        rows, ids, at = [], [], []
        gaps: dict[str, int] = {}
        gap_at = []

        def flush():
            nonlocal made, held, known, rows, ids, at, gaps, gap_at
            raw = " ".join(known).encode("utf-8", "surrogatepass")  # no word holds a space
            flat, size = pack(np.concatenate(at).astype(np.uint32)) if at else (b"", 0)
            names = json.dumps(list(gaps)).encode() if whole else b""
            spots, spots_size = pack(np.concatenate(gap_at).astype(np.uint32)) if gap_at else (b"", 0)
            out = pa.RecordBatch.from_pylist([{
                "block": f"{task}-{made}", "words": squeeze(raw), "words_size": len(raw), "at": flat, "at_size": size, "ids": ids, "counts": [len(x) for x in at],
                "rows": _bytes(rows) if along else None, "gaps": squeeze(names), "gaps_size": len(names), "gap_at": spots, "gap_at_size": spots_size,
            }], schema=_ARROW)
            made, held, known, rows, ids, at, gaps, gap_at = made + 1, 0, {}, [], [], [], {}, []
            return out

        for b in batches:
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                text = text.as_py() or ""
                found = find(text.translate(table) if lower else text)
                n = len(found)
                at.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.uint32, n))
                if whole:
                    gap_at.append(np.fromiter((gaps.setdefault(g, len(gaps)) for g in between(text)), np.uint32, n + 1))
                if along:
                    rows.append(b.column(2).slice(k, 1))
                ids.append(doc)
                held += n + 8
                if held >= block_words:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *taken).mapInArrow(run, BLOCK)


#: What is sent to buckets: sorted hashes, and one more array or bits.
ASK = "bucket int, block string, hashes binary, hashes_size int, extra binary, extra_size int"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("hashes", pa.binary()), ("hashes_size", pa.int32()), ("extra", pa.binary()), ("extra_size", pa.int32())])
ANSWER = "block string, bucket int, data binary, size int"
_ANSWER = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("data", pa.binary()), ("size", pa.int32())])


def questions(name: str, hashes: np.ndarray, extra: np.ndarray, buckets: int) -> list[dict]:
    """Requests of a block for sorted distinct hashes; buckets are ranges of the hash."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    ends = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for k in range(buckets):
        a, b = ends[k], ends[k + 1]
        if b > a:
            h, hs = pack_sorted(hashes[a:b])
            e, es = pack(extra[a:b])
            out.append({"bucket": k, "block": name, "hashes": h, "hashes_size": hs, "extra": e, "extra_size": es})
    return out


def asked(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ASK)


def answered(requests: DataFrame, judge: Callable, extra_dtype, answer_dtype) -> DataFrame:
    """judge(inverse, extra, n) -> answer per request item, given the hash number of each item."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        lists = [unpack_sorted(r["hashes"], r["hashes_size"]) for r in rows]
        extra = np.concatenate([unpack(r["extra"], r["extra_size"], extra_dtype) for r in rows])
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        said = judge(inverse, extra, len(distinct)).astype(answer_dtype)
        out, start = [], 0
        for r, x in zip(rows, lists, strict=True):
            data, size = pack(said[start : start + len(x)])
            out.append({"block": r["block"], "bucket": r["bucket"], "data": data, "size": size})
            start += len(x)
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return requests.groupBy("bucket").applyInArrow(run, ANSWER)


def read_answers(t: pa.Table, dtype) -> np.ndarray:
    """Answers of a block in the order of its sorted hashes."""
    rows = t.sort_by("bucket").to_pylist() if t.num_rows else []
    return np.concatenate([unpack(r["data"], r["size"], dtype) for r in rows]) if rows else np.zeros(0, dtype)
