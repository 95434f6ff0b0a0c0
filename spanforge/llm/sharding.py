"""Sharding by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import stored

#: Bits of the order key that the first look resolves, and each closer look adds.
FIRST_BITS, MORE_BITS = 12, 8


def _widest(segments: list[tuple], capacity: int) -> list[int]:
    """Greedy cuts (as running sums) if every segment of several groups could be cut anywhere."""
    cuts, room, done = [], capacity, 0
    for _, total, count, _ in segments:
        if count == 1:
            if total > room:
                cuts.append(done)
                room = capacity
            room -= total
            done += total
            continue
        while total > room:
            done += room
            total -= room
            cuts.append(done)
            room = capacity
        room -= total
        done += total
    return cuts


def _narrow(segments: list[tuple], capacity: int) -> list[int] | None:
    """Greedy cuts if no segment can be cut; None if one doesn't fit."""
    cuts, room, done = [], capacity, 0
    for _, total, _, _ in segments:
        if total > capacity:
            return None
        if total > room:
            cuts.append(done)
            room = capacity
        room -= total
        done += total
    return cuts


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first key of each shard after the first) for groups(key long, bytes long).

    Groups stand in the order of their key; each shard takes a run of them.
    The capacity is the smallest for which a greedy run needs no more than
    `shards` runs. The driver holds sums over ranges of keys only: 2**12 at
    first, and after that 2**8 parts of each range in which a cut could fall
    for a capacity that is still possible. It stops when all such ranges are
    single groups, so that the answer equals a greedy check over every group.
    """

    def look(shift: int, inside: list[int] | None, above: int) -> list[tuple]:
        df = groups
        if inside is not None:
            wanted = df.sparkSession.createDataFrame([(x,) for x in inside], "p long")
            df = df.join(F.broadcast(wanted), F.shiftright("key", above) == F.col("p"), "left_semi")
        rows = df.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.min("key").alias("k")).collect()
        return sorted((r.k, int(r.s), int(r.n), shift) for r in rows)

    shift = 64 - FIRST_BITS
    segments = look(shift, None, 0)
    total = sum(s[1] for s in segments)
    if not segments:
        return 0, []
    while True:
        low = max([1, math.ceil(total / shards), *(s[1] for s in segments if s[2] == 1)])
        low = _smallest(lambda c: len(_widest(segments, c)) < shards, low, max(total, low))
        fits = lambda c: (cut := _narrow(segments, c)) is not None and len(cut) < shards
        high = _smallest(fits, low, max(total, low))
        last = _widest(segments, high)
        first, done, room = [], 0, low
        for _, size, _, _ in segments:  # the earliest that a cut could come, segment by segment
            if size > room:
                first.append(done)
                room = low
            room = max(0, room - size)
            done += size
        first = first[: shards - 1] + [done] * (shards - 1 - len(first))
        last = last[: shards - 1] + [total] * (shards - 1 - len(last))
        spans = list(zip(first, last, strict=True))
        closer, start = [], 0
        for seg in segments:
            end = start + seg[1]
            if seg[2] > 1 and (seg[1] > low or any(a < end and start < b or a == b and start < a < end for a, b in spans)):
                closer.append(seg)
            start = end
        if not closer or low == high and all(x in {0, *_ends(segments)} for x in _widest(segments, high)):
            break
        finer = []
        for old in sorted({s[3] for s in closer}):
            new = max(0, old - MORE_BITS)
            finer += look(new, [s[0] >> old for s in closer if s[3] == old], old)
        gone = {(s[0], s[3]) for s in closer}
        segments = sorted([s for s in segments if (s[0], s[3]) not in gone] + finer)
    cuts, starts, done = set(_narrow(segments, high)), [], 0
    for seg in segments:
        if done in cuts and done:
            starts.append(seg[0])
        done += seg[1]
    return high, starts


def _ends(segments: list[tuple]) -> list[int]:
    ends, done = [], 0
    for s in segments:
        done += s[1]
        ends.append(done)
    return ends


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes (law `bytes`).

    Size: UTF-8 bytes of the text plus `overhead`. Rows of equal text are one
    atomic group; groups are ordered by a 64-bit hash of the text and cut by
    `minimax_cuts`. Returns the key columns, size, text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard (null: this law has
    none). A null text counts as an empty one; null or repeated ids are rows
    like others; an empty table gives no rows; other columns are left out, so
    that clashing names do no harm. Texts are never shuffled. A group larger
    than a fair share fills a shard of its own: no cut can mend that.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    n = groups.agg(F.sum("n")).first()[0] or 0
    _, starts = minimax_cuts(groups, shards)
    at = F.lit(0)
    for k in starts:
        at = at + (F.col("key") >= F.lit(k)).cast("int")
    # Slots: cells of a shard by a hash of the id, so that a group of equal texts is spread.
    cells = max(1, math.isqrt(n // shards))
    rows = rows.select("doc_id", "size", "text_crc32", at.alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)).alias("cell"))
    before = (
        rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    )
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("in_cell", slot).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("in_cell") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
