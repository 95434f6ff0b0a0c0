"""Substring dedup: passages of words that an earlier document or a reference has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import exchange
from spanforge.llm.common import stored
from spanforge.llm.exchange import Block


class SuffixAutomaton:
    """All substrings of some sequences of symbols, in states and moves linear in their length."""

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        last = 0
        moves, link, length = self.moves, self.link, self.length
        for c in sequence:
            there = moves[last].get(c)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            made = None
            if there is None:
                made = len(moves)
                moves.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in moves[p]:
                    moves[p][c] = made
                    p = link[p]
                if p < 0:
                    last = made
                    continue
                there = moves[p][c]
                if length[there] == length[p] + 1:
                    link[made] = there
                    last = made
                    continue
            else:
                p = last
            copy = len(moves)
            moves.append(dict(moves[there]))
            length.append(length[p] + 1)
            link.append(link[there])
            link[there] = copy
            while p >= 0 and moves[p].get(c) == there:
                moves[p][c] = copy
                p = link[p]
            if made is None:
                last = copy
            else:
                link[made] = copy
                last = made

    def matching(self, sequence) -> list[int]:
        """Matching statistics: length of the longest known substring that ends at each symbol."""
        moves, link, length = self.moves, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in moves[state]:
                state = link[state]
                n = length[state]
            if c in moves[state]:
                state = moves[state][c]
                n += 1
            out.append(n)
        return out


def _covered(ends: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Symbols in a span of `lengths` that ends at `ends`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ends + 1 - lengths, 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def strip_reference(docs: DataFrame, reference: DataFrame, threshold: int = 13, shard_words: int = 1 << 18, most_words: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """Remove maximal spans of `threshold` or more words that a reference text has.

    The reference is split into shards of about `shard_words` words; each
    shard's suffix automaton is built where it is used, from a broadcast of
    its texts, and documents stream through it for their matching statistics.
    A reference above `most_words` words is refused: this is for benchmarks
    and the like; `remove_repeats` is for a corpus against itself.
    Null texts have no words. Returns doc_id, n_words, n_removed, kept.
    """
    import re

    from spanforge.llm.common import WORD, n_words

    find = re.compile(WORD).findall
    size = reference.agg(F.sum(n_words(F.col(reference_col)))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words; at most {most_words} can be broadcast")
    shards: list[list[str]] = [[]]
    held = 0
    for r in reference.select(reference_col).where(F.col(reference_col).isNotNull()).distinct().toLocalIterator():
        if held >= shard_words:
            shards.append([])
            held = 0
        shards[-1].append(r[0])
        held += len(find(r[0]))
    shared = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for texts in shared.value:
            a = SuffixAutomaton()
            for t in texts:
                a.add(find(t))
            automata.append(a)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = find(text or "")
                gone = np.zeros(len(w), bool)
                for a in automata:
                    m = np.array(a.matching(w), np.int64)
                    ends = np.flatnonzero(m >= threshold)
                    gone |= _covered(ends, m[ends], len(w)) if len(w) else gone
                out.append({"doc_id": doc, "n_words": len(w), "n_removed": int(gone.sum()), "kept": " ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


#: An anchor that more documents have is common: its windows are sieved, too.
COMMON = 64
#: Words of a shingle among which a window's anchor is the one of the smallest hash.
SHINGLE = 6
_BASE = np.uint64(0x100000001B3)


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position on (shorter by k - 1)."""
    n = max(0, len(h) - k + 1)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = x * _BASE + h[j : j + n]
    return exchange.mix(x)


class Windows:
    """A block's windows of `width` words: those inside one document, and their anchors."""

    def __init__(self, block: Block, width: int):
        self.block, self.width = block, width
        h = exchange.mix(block.hashes())[block.at] if len(block.words) else np.zeros(0, np.uint64)
        doc = block.doc()
        n = max(0, len(h) - width + 1)
        self.start = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.start] if n else self.start
        self.symbols = h

    def anchors(self) -> np.ndarray:
        """For each window the smallest of its shingles' hashes, spread again."""
        shingle = min(SHINGLE, self.width)
        x = _rolling(self.symbols, shingle)
        span, low, k = self.width - shingle + 1, x, 1
        while k < span:
            step = min(k, span - k)
            low = np.minimum(low[: len(low) - step], low[step:])
            k += step
        return exchange.mix(low[self.start]) if len(self.start) else np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        return _rolling(self.symbols, self.width)[self.start] if len(self.start) else np.zeros(0, np.uint64)


def _holders(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many documents have each (255 for more)."""
    if not len(keys):
        return keys, np.zeros(0, np.uint8)
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    pair = fresh | np.concatenate([[True], d[1:] != d[:-1]])
    first = np.flatnonzero(fresh)
    return k[first], np.minimum(np.add.reduceat(pair.astype(np.int64), first), 255).astype(np.uint8)


def _pieces(w: Windows, own: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of runs of neighbouring windows with one anchor, among `own`."""
    if not len(own):
        return own, own
    start, a, d = w.start[own], anchors[own], w.doc[own]
    new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    first = np.flatnonzero(new)
    return own[first], np.diff(np.concatenate([first, [len(own)]]))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Stretches:
    """A block's distinct pieces of shared windows, by shard of the reference."""

    def __init__(self, w: Windows, own: np.ndarray, buckets: int):
        anchors = w.anchors()
        self.first, self.n = _pieces(w, own, anchors)
        size = self.n + w.width - 1
        shard = (anchors[self.first] >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if len(own) else self.first
        flat = w.symbols[_spread(w.start[self.first], size)] if len(own) else np.zeros(0, np.uint64)
        # A piece's name: a polynomial over its symbols.
        power = np.cumprod(np.full(int(size.max(initial=1)), _BASE, np.uint64))
        place = _spread(np.zeros(len(size), np.int64), size)
        ends = np.cumsum(size)
        names = np.add.reduceat(exchange.mix(flat) * power[place], ends - size) if len(own) else np.zeros(0, np.uint64)
        order = np.lexsort((w.block.numbers()[w.doc[self.first]], names, size, shard)) if len(own) else self.first
        k = np.stack([shard[order], size[order], names[order].view(np.int64)]) if len(own) else np.zeros((3, 0), np.int64)
        fresh = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]) if len(own) else np.zeros(0, bool)
        self.kept = order[fresh]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.shard, self.size = shard[self.kept], size[self.kept]
        self.low = w.block.numbers()[w.doc[self.first[self.kept]]] if len(own) else self.first
        self.symbols = flat[_spread((ends - size)[self.kept], self.size)] if len(own) else flat

    def requests(self, name: str) -> list[dict]:
        """A row a shard: symbols as numbers into a list, sizes, and smallest ids."""
        out, ends = [], np.concatenate([[0], np.cumsum(self.size)])
        cuts = np.flatnonzero(np.concatenate([[True], self.shard[1:] != self.shard[:-1]])) if len(self.shard) else self.shard
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.shard)], strict=False):
            words, at = np.unique(self.symbols[ends[a] : ends[b]], return_inverse=True)
            raw = b"".join([np.array([b - a, len(words)], np.uint32).tobytes(), self.low[a:b].tobytes(), words.tobytes(), self.size[a:b].astype(np.uint32).tobytes(), at.astype(np.uint16 if len(words) < 65536 else np.uint32).tobytes()])
            out.append({"shard": int(self.shard[a]), "block": name, "data": exchange.squeeze(raw), "size": len(raw)})
        return out


def _read_pieces(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest ids, sizes, symbols) of a request."""
    n, k = np.frombuffer(raw, np.uint32, 2).tolist()
    low = np.frombuffer(raw, np.int64, n, 8)
    words = np.frombuffer(raw, np.uint64, k, 8 + 8 * n)
    size = np.frombuffer(raw, np.uint32, n, 8 + 8 * n + 8 * k).astype(np.int64)
    at = np.frombuffer(raw, np.uint16 if k < 65536 else np.uint32, int(size.sum()), 8 + 12 * n + 8 * k)
    return low, size, words[at]


def _match_shard(t: pa.Table, width: int) -> pa.Table:
    """Stream the pieces of a shard, by id, through the automaton of those before; it grows by what is new.

    The answer to a block has a byte a window: whether the longest match with
    documents of smaller id that ends there is `width` words or more.
    """
    rows = t.sort_by("block").to_pylist()
    parts = [_read_pieces(exchange.stretch(r["data"], r["size"]), width) for r in rows]
    low, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, number = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    ends = np.cumsum(size)
    begin = ends - size
    n = size - width + 1
    to = np.cumsum(n) - n
    hit = np.zeros(int(n.sum()), np.uint8)
    automaton, waiting, at_id = SuffixAutomaton(), [], None
    for k in np.lexsort((begin, low)).tolist():
        if low[k] != at_id:
            for piece in waiting:
                automaton.add(piece)
            waiting, at_id = [], low[k]
        piece = number[begin[k] : ends[k]].tolist()
        found = [m >= width for m in automaton.matching(piece)[width - 1 :]]
        hit[to[k] : to[k] + n[k]] = found
        if not all(found):
            waiting.append(piece)
    out, done = [], 0
    for r, p in zip(rows, parts, strict=True):
        m = int((p[1] - width + 1).sum())
        data, length = exchange.pack(hit[done : done + m])
        out.append({"block": r["block"], "bucket": r["shard"], "data": data, "size": length})
        done += m
    return pa.Table.from_pylist(out, schema=exchange._ANSWER)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", carried: Column | None = None, block_words: int = exchange.BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """Remove each word in a window of `width` words that also starts in a document of smaller id.

    Windows are judged on the input, by the matching statistics of suffix
    automata of shards of the corpus. What goes to a shard is sieved first;
    the sieves let through all that could match, and decide nothing.

    1. Anchors: the smallest hash of a window's shingles, which equal windows
       share. Blocks ask which of theirs other documents have. Runs of windows
       of one such anchor are the pieces that go on.
    2. Of a common anchor (COMMON documents or more) only those windows go on
       whose hash another document has: else what stands around a passage
       that a third of all documents have would meet in one shard.
    3. The shards of the reference are the ranges of the anchors. A shard's
       automaton holds the pieces of smaller ids; documents stream through it
       in the order of their id for their matching statistics, and a
       window is covered where these reach `width`.

    The automata aren't broadcast: the reference is the corpus itself, so a
    shard's automaton is built where its pieces meet, and only documents with
    pieces of that shard come. A block sends a piece once, however often it
    has it, so a passage in every document costs a few items for each block.

    A null text has no words; a text shorter than a window loses none. Rows
    of equal id don't remove each other's words; a null id counts as the
    largest. Repeated rows are each judged. An empty table gives no rows; other
    columns are left out, but for `carried`. Very long texts are whole: one is a
    block. Returns doc_id, n_words, n_removed, kept_sha256, kept (the text as it
    was if no word is removed, else the kept words joined by a space; null unless
    `keep_text`) and row (carried), if there is one.
    """
    import hashlib

    whole = stored(exchange.blocks(docs, id_col, text_col, carried, block_words=block_words, whole=keep_text), "blocks")
    made = whole.select(*exchange.ASKING)
    buckets = exchange.buckets_of(made)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                w = Windows(Block(row), width)
                a = w.anchors()
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (w.doc[1:] != w.doc[:-1])]) if len(a) else np.zeros(0, bool)
                yield from exchange.asked(exchange.questions(w.block.name, *_holders(a[new], w.doc[new]), buckets)).to_batches()

    def shared(inverse, holders, n):
        """0: one document has it, 1: some have, 2: so many that it is common."""
        n = np.bincount(inverse, weights=holders, minlength=n)
        return ((n > 1).astype(np.uint8) + (n > COMMON))[inverse]

    anchors = stored(exchange.answered(made.mapInArrow(ask_anchors, exchange.ASK), shared, np.uint8, np.uint8), "anchors")

    def told(said: pa.Table, which: int) -> pa.Table:
        return said.filter(pa.compute.equal(said["which"], which))

    def suspects(w: Windows, said: pa.Table) -> np.ndarray:
        """For each window 0, 1 or 2 as for its anchor."""
        a = w.anchors()
        known = exchange.read_answers(told(said, 0), np.uint8)
        return known[np.searchsorted(np.unique(a), a)] if len(a) else np.zeros(0, np.uint8)

    def ask_windows(t: pa.Table, said: pa.Table) -> pa.Table:
        rows = []
        for row in t.to_pylist():
            w = Windows(Block(row), width)
            own = np.flatnonzero(suspects(w, said) == 2)
            rows += exchange.questions(w.block.name, *_holders(w.hashes()[own], w.doc[own]), buckets)
        return exchange.asked(rows)

    mark = lambda df, which: df.select("*", F.lit(which).alias("which"))
    requests = made.groupBy("block").cogroup(mark(anchors, 0).groupBy("block")).applyInArrow(ask_windows, exchange.ASK)
    windows = stored(exchange.answered(requests, shared, np.uint8, np.uint8), "windows")
    both = mark(anchors, 0).union(mark(windows, 1))

    def repeated(w: Windows, said: pa.Table) -> np.ndarray:
        """Indices of the windows that another document may have."""
        found = suspects(w, said)
        common = np.flatnonzero(found == 2)
        if len(common):
            h = w.hashes()[common]
            known = exchange.read_answers(told(said, 1), np.uint8)
            found[common] = known[np.searchsorted(np.unique(h), h)]
        return np.flatnonzero(found)

    def send(t: pa.Table, said: pa.Table) -> pa.Table:
        rows = []
        for row in t.to_pylist():
            w = Windows(Block(row), width)
            rows += Stretches(w, repeated(w, said), buckets).requests(w.block.name)
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("block", pa.string()), ("data", pa.binary()), ("size", pa.int32())]))

    def match(t: pa.Table) -> pa.Table:
        return _match_shard(t, width)

    pieces = made.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(send, "shard int, block string, data binary, size int")
    matched = stored(pieces.groupBy("shard").applyInArrow(match, exchange.ANSWER), "matched")
    out_kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    taken = docs.select(carried.alias("row")).schema.fields if carried is not None else []
    along = bool(taken)

    def judge(t: pa.Table, said: pa.Table) -> pa.Table:
        parts = []
        for row in t.to_pylist():
            rows = []
            w = Windows(Block(row), width)
            b = w.block
            s = Stretches(w, repeated(w, said), buckets)
            found = exchange.read_answers(told(said, 2), np.uint8).astype(bool)
            # A run stands for its equals; those of larger ids in the block are covered whole.
            n = s.size - width + 1
            at = np.cumsum(n) - n
            later = np.repeat(b.numbers()[w.doc[s.first]] > s.low[s.of], s.n) if len(s.first) else np.zeros(0, bool)
            mine = found[_spread(at[s.of], s.n)] if len(s.first) else later
            starts = _spread(w.start[s.first], s.n) if len(s.first) else s.first
            hit = starts[mine | later]
            gone = _covered(hit + width - 1, np.full(len(hit), width), len(b.at)) if len(b.at) else np.zeros(0, bool)
            names = np.array(b.words, dtype=object)
            cut = np.add.reduceat(np.append(gone, False).astype(np.int64), b.first[:-1]) * (b.counts > 0) if len(b.counts) else b.counts
            texts = b.texts(np.flatnonzero(cut == 0).tolist()) if keep_text else {}
            for i, doc in enumerate(b.ids):
                own = slice(b.first[i], b.first[i + 1])
                kept = " ".join(names[b.at[own][~gone[own]]].tolist()) if b.counts[i] else ""
                rows.append({"doc_id": doc, "n_words": int(b.counts[i]), "n_removed": int(gone[own].sum()), "kept_sha256": hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), "kept": texts.get(i, kept) if keep_text else None})
            part = pa.Table.from_pylist(rows, schema=out_kind)
            parts.append(part.append_column("row", b.rows()) if along else part)
        return pa.concat_tables(parts)

    every = both.union(mark(matched, 2))
    shape = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()), *taken])
    return whole.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(judge, shape)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with the kept words as text where words were removed; rows of which no word is left go.

    Other rows, null and empty texts among them, stay as they are, and so do
    all other columns, whatever their type and name; only `size_col`, if
    there is one, is the new text's length where words were removed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("_no_text"))
    out = remove_repeats(docs, id_col=id_col, text_col=text_col, carried=row, keep_text=True)
    cut = F.col("n_removed") > 0
    new = {text_col: F.when(~F.col("row._no_text"), F.col("kept"))}
    if size_col in docs.columns:
        new[size_col] = F.when(cut, F.length("kept").cast(docs.schema[size_col].dataType)).otherwise(F.col(f"row.`{size_col}`"))
    return out.where("n_words = 0 or n_removed < n_words").select(*[new.get(c, F.col(f"row.`{c}`") if c != text_col else None).alias(c) for c in docs.columns])
