"""Byte-level BPE through a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level BPE cuts text before its merges (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """Symbols that stand for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Coder:
    """Splits texts into words and encodes words; built in each Python worker from the JSON."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True) or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer
        self.known: dict[str, bool] = {}
        back = byte_of_symbol()
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in p) if all(c in back for c in p) else p.encode() for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def _agrees(self, c: str) -> bool:
        """Whether both libraries put a character into the same class; newer letters differ."""
        if c not in self.known:
            probe = f"a{c}1{c}.{c} {c}"
            self.known[c] = [m.span() for m in self.spans(probe)] == [o for _, o in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return self.known[c]

    def _words(self, text: str) -> list[str]:
        if text.isascii() or all(map(self._agrees, set(text))):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.added else self._words(part))]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words, each encoded once."""
        plain = [w for w in words if w not in self.added]
        ids = dict(zip(plain, (e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)), strict=True))
        return [ids[w] if w in ids else [self.added[w]] for w in words]


def _pack(strings: list[str]) -> bytes:
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    return pa.compress(np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw), codec="zstd", asbytes=True)


def _open(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


def _unpack(blob: bytes, size: int) -> list[str]:
    raw = _open(blob, size)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: key: "w<bucket>" asks for words, "b<block>" holds the positions or, in answers, the ids.
_ASKED = "key string, block string, part int, data binary, size int, ids array<string>, counts array<int>"


def asked(docs: DataFrame, coder_of, block_bytes: int, buckets: int) -> DataFrame:
    """Blocks of documents: their distinct words by bucket, and each text as word positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, made = coder_of(), TaskContext.get().partitionId(), 0
        known, ids, at, held = Numbering(), [], [], 0

        def flush():
            nonlocal made
            block = f"{task}-{made}"
            made += 1
            words = list(known)
            place = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words]
            order = sorted(range(len(words)), key=lambda i: (place[i], words[i]))
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            flat = rank[np.concatenate(at)] if words else np.zeros(0, np.uint32)
            rows, start = [], 0
            for k in range(1, len(order) + 1):
                if k == len(order) or place[order[k]] != place[order[start]]:
                    mine = [words[i] for i in order[start:k]]
                    size = 4 + 4 * len(mine) + sum(len(w.encode("utf-8", "surrogatepass")) for w in mine)
                    rows.append({"key": f"w{place[order[start]]}", "block": block, "part": place[order[start]], "data": _pack(mine), "size": size, "ids": None, "counts": None})
                    start = k
            packed = pa.compress(flat.tobytes(), codec="zstd", asbytes=True) if len(flat) else b""
            rows.append({"key": f"b{block}", "block": block, "part": -1, "data": packed, "size": flat.nbytes, "ids": list(ids), "counts": [len(x) for x in at]})
            known.clear()
            ids.clear()
            at.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("block", pa.string()), ("part", pa.int32()), ("data", pa.binary()), ("size", pa.int32()), ("ids", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = coder.words(text.as_py())
                ids.append(None if doc is None else str(doc))
                at.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                held += 4 * len(found) + 16
                if held >= block_bytes:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, _ASKED)


#: Distinct words whose ids a bucket keeps at hand while its requests stream by.
KEPT_WORDS = 1 << 20


def encode_decode(docs: DataFrame, vocabulary: str | None = None, block_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every whole text.

    Texts are split into words in blocks of documents that a task holds at
    once (`block_bytes` of word positions, or one document). A block asks
    for each of its distinct words; requests meet by a hash of the word, where
    each distinct word of the corpus is encoded once, and the ids
    go back to the blocks, which join them to their words by position and
    decode through the id-to-piece table of the vocabulary. A word that is
    everywhere is asked for once a block, so no key is hot; requests, answers
    and positions are compressed lists, and whole texts are never shuffled.
    There is a bucket for `bucket_bytes` of text; its requests stream by, and
    only its distinct words are held (beyond KEPT_WORDS they are encoded anew).
    Rows are sorted within their partitions, so that a block that is made again
    after a lost executor is the same block, whatever order its rows come in.

    A null text counts as an empty one (no tokens); null and repeated ids are
    rows by themselves; very long texts are whole, one is a block; an empty table
    gives no rows; other columns are left out, whatever their names. Ids must be
    integers. The vocabulary's path is read on the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # of a fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // bucket_bytes))
    cache: list[Coder] = []

    def coder_of() -> Coder:
        if not cache:
            cache.append(Coder(shared.value))
        return cache[0]

    requests = asked(rows.sortWithinPartitions("doc_id", F.xxhash64("text")), coder_of, block_bytes, buckets)
    answer_kind = pa.schema([("key", pa.string()), ("part", pa.int32()), ("data", pa.binary()), ("size", pa.int32())])

    def answer(asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in asks:
            rows = []
            for x in batch.to_pylist():
                if x["part"] < 0:  # a block, which asks for nothing
                    continue
                words = _unpack(x["data"], x["size"])
                if len(known) > KEPT_WORDS:
                    known = {}
                new = [w for w in words if w not in known]
                known.update(zip(new, coder_of().encode(new), strict=True))
                ids = [known[w] for w in words]
                count = [len(i) for i in ids]
                raw = np.fromiter(chain([len(ids)], count, chain.from_iterable(ids)), np.uint32, 1 + len(ids) + sum(count)).tobytes()
                rows.append({"key": f"b{x['block']}", "part": x["part"], "data": pa.compress(raw, codec="zstd", asbytes=True), "size": len(raw)})
            yield pa.RecordBatch.from_pylist(rows, schema=answer_kind)

    answers = requests.groupBy("key").applyInArrow(answer, "key string, part int, data binary, size int")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, text_of, bytes_of, count, rows = coder_of().pieces, [], [], [], []
        for row in left.to_pylist():
            if row["part"] >= 0:  # a request, which has been answered
                continue
            for one in right.select(["part", "data", "size"]).sort_by("part").to_pylist():
                raw = np.frombuffer(_open(one["data"], one["size"]), np.uint32).tolist()
                n, at = raw[0], raw[0] + 1
                for k in raw[1 : n + 1]:
                    ids = raw[at : at + k]
                    at += k
                    text_of.append(",".join(map(str, ids)))
                    bytes_of.append(b"".join([pieces[i] for i in ids]))  # the id-to-piece join
                    count.append(k)
            flat = np.frombuffer(_open(row["data"], row["size"]), np.uint32) if row["size"] else np.zeros(0, np.uint32)
            counts, start = np.array(count, np.int64), 0
            for doc, n in zip(row["ids"], row["counts"], strict=True):
                at = flat[start : start + n]
                start += n
                own = at.tolist()
                ids = hashlib.sha256(",".join(map(text_of.__getitem__, own)).encode()).hexdigest()
                text = b"".join(map(bytes_of.__getitem__, own)).decode("utf-8", "replace")
                rows.append({"doc_id": None if doc is None else int(doc), "n_tokens": int(counts[at].sum()) if n else 0, "ids_sha256": ids, "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return requests.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
