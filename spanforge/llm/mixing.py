"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import n_words, stored


def apportion(parties: DataFrame, by: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: seats go one by one to the highest quotient votes / (2k + 1).

    `parties` has votes (double), the group columns `by`, `seats` (long, equal
    in a group) and `party` (orders ties). A party is sure of the seats well
    below its share; only quotients around its share compete. The highest
    quotients differ from the shares by a common factor of 1 +- n / (2 seats),
    so the margin below holds all of them. Returns parties with `won`.
    """
    group = Window.partitionBy(*by)
    p = parties.withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count("*").over(group))
    share = F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(0.0)
    p = p.withColumn("_share", share).withColumn("_margin", F.ceil(F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0) * F.col("_n") / 2) + 2)
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.floor("_share") - F.col("_margin")).cast("long"))
    p = p.withColumn("_left", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_sure").over(group)).otherwise(0))
    q = p.where(F.col(votes) > 0).select("*", F.explode(F.sequence(F.col("_sure"), (F.floor("_share") + F.col("_margin") + 1).cast("long"))).alias("_k"))
    q = q.withColumn("_rank", F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), F.col("party"))))
    won = q.where("_rank <= _left").groupBy(*by, "party").agg(F.count("*").alias("_more"))
    keys = [*by, "party"]
    kept = p.select(*parties.columns, "_sure")
    joined = kept.join(won, [kept[k].eqNullSafe(won[k]) for k in keys], "left").select(*[kept[c] for c in parties.columns], (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("won"))
    return joined


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of sources(source, source_size): by weight, at most `limit` times the size.

    Weights repeat over the sources in order of code points, null last. What
    a source can't take is shared out again by weight. Sorted by size over
    weight, the first source whose share stays under its limit fixes the
    price per weight; that is the fixed point of the repeated sharing.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    up = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("_ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("_spent", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).withColumn("_at", F.row_number().over(up))
    s = s.withColumn("_price", (F.sum("source_size").over(whole) * F.lit(float(total_share)) - F.col("_spent")) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    price = F.min_by(F.when(F.col("_ratio") >= F.col("_price"), F.col("_price")), F.when(F.col("_ratio") >= F.col("_price"), F.col("_at"))).over(whole)
    return s.withColumn("_final", price).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("_final") * F.col("weight"), F.col("cap"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _copies(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with `copies`: whole documents in place of the words that are taken of them.

    A document comes as often as it is taken whole, and once more if the
    running sum of the rest, as shares of documents, passes a whole number
    there (so with the rest as its chance). The sum runs over a cell from its
    largest document down, from an offset that is seeded by source and spread
    over its cells: the words of a cell's copies differ from those taken by less
    than its largest document. A document without words has its source's
    share, or one copy in a source without words.
    """
    n = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    down = Window.partitionBy("source", "cell").orderBy(F.desc("size"), F.xxhash64(F.lit(seed + 2), "doc_id", "_th"), "doc_id", "_th", "taken")
    at = F.pmod(F.xxhash64(F.lit(seed + 3), "source"), F.lit(1 << 20)) / (1 << 20) + F.col("cell") * 0.6180339887498949
    r = rows.withColumn("_whole", F.floor(n)).withColumn("_rest", n - F.col("_whole")).withColumn("_from", at - F.floor(at))
    r = r.withColumn("_sum", F.sum("_rest").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    more = F.floor(F.col("_from") + F.col("_sum")) - F.floor(F.col("_from") + F.coalesce(F.lag("_sum").over(down), F.lit(0.0)))
    return r.withColumn("copies", (F.col("_whole") + more).cast("int"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, limit: int = 2, block: int = 512, least_blocks: int = 1000, few_blocks: int = 32, cell_words: int = 1 << 18, fan: int = 8192, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False,
) -> DataFrame:
    """Words that a mix takes from every document, so that sources come near their targets.

    A source's documents are dealt by a seeded hash of id and text into cells of
    about `cell_words` words (the shards of the apportionment), and each cell
    is a seeded stream of words cut into equal blocks. There are total / block
    blocks, and `least_blocks` for each source at least. Sainte-Laguë gives each
    source its blocks by target; one that wins less than `few_blocks` is
    apportioned word by word instead, so that it comes near its target however
    large the others are. It then gives each group of `fan` cells of a source, and
    each cell of a group, its quota by size. A cell takes whole passes over its
    stream and, for the rest of its quota, blocks spread evenly from a seeded
    offset. No document is taken more than `limit` times.

    Returns doc_id, size, source_size, target, taken. With `keep` also `row`,
    the columns of `docs` as a struct, and `copies`, for who takes whole
    documents (see `_copies`). Null text: size 0, taken 0. A null source is a
    source, the last one. Null ids are dealt by their texts. Repeated rows count
    each by itself; rows equal in id and text are interchangeable. Very long
    texts are whole. Columns of `docs` may have any names. An empty table gives no rows.
    """
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_th"), *extra)
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = source_targets(sizes, weights, total_share, limit)
    whole = Window.partitionBy(F.lit(0))
    goal = goal.withColumn("_total", F.sum("target").over(whole)).withColumn("party", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    goal = goal.withColumn("blocks", F.greatest(F.ceil(F.col("_total") / block), F.lit(least_blocks) * F.count("*").over(whole)).cast("long")).withColumn("_one", F.lit(0))
    few = F.col("won") < few_blocks
    goal = apportion(goal, ["_one"], "target", "blocks").select(
        "source", "source_size", "target", F.when(few, F.round("target").cast("long")).otherwise(F.col("won")).alias("source_blocks"),
        F.when(few, F.lit(1.0)).otherwise(F.col("_total") / F.col("blocks")).alias("block_words"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / cell_words)).cast("int").alias("cells"),
    )
    goal = stored(goal, "goal")
    dealt = rows.join(goal.select(F.col("source").alias("_s"), "cells"), _same(F.col("source"), F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_th"), F.col("cells")).cast("int"))
    in_cells = stored(dealt.groupBy("source", "cell").agg(F.sum("size").alias("cell_words")), "cells")
    quota = in_cells.join(goal.withColumnRenamed("source", "_s"), _same(F.col("source"), F.col("_s"))).drop("_s")
    quota = quota.withColumn("votes", F.col("cell_words").cast("double")).withColumn("_sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))).withColumn("_group", F.floor(F.col("cell") / fan).cast("int"))
    groups = quota.groupBy("_sk", F.col("_group").alias("party")).agg(F.sum("votes").alias("votes"), F.first("source_blocks").alias("source_blocks"))
    groups = apportion(groups, ["_sk"], "votes", "source_blocks").select("_sk", F.col("party").alias("_group"), F.col("won").alias("group_blocks"))
    quota = apportion(quota.join(groups, ["_sk", "_group"]).withColumn("party", F.col("cell")), ["_sk", "_group"], "votes", "group_blocks")
    w = F.greatest("cell_words", F.lit(1))
    quota = quota.withColumn("_wanted", F.col("won") * F.col("block_words")).withColumn("passes", F.least(F.floor(F.col("_wanted") / w), F.lit(limit)).cast("long"))
    quota = quota.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("cell_words") / F.greatest("block_words", F.lit(1e-9)))).cast("long"))
    part = F.when(F.col("passes") >= limit, 0).otherwise(F.least("n_blocks", F.round((F.col("_wanted") - F.col("passes") * w) / w * F.col("n_blocks")).cast("long")))
    quota = quota.withColumn("part", part.cast("long")).withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), "_sk", "cell"), F.col("n_blocks")))
    quota = quota.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "source_size", "target", "cell_words", "passes", "part", "n_blocks", "offset")
    out = dealt.join(quota, _same(F.col("source"), F.col("_s")) & (F.col("cell") == F.col("_c")))
    stream = Window.partitionBy("source", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_th"), "doc_id", "_th", "size")
    out = out.withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_end") - F.col("size"))
    cut = lambda j: F.floor(j * F.col("cell_words") / F.col("n_blocks"))
    picked = lambda j: F.floor(((j + 1) * F.col("part") + F.col("offset")) / F.col("n_blocks")) > F.floor((j * F.col("part") + F.col("offset")) / F.col("n_blocks"))
    j0 = F.greatest(F.lit(0), F.floor(F.col("_from") * F.col("n_blocks") / w) - 1)
    j1 = F.least(F.col("n_blocks") - 1, F.floor(F.col("_end") * F.col("n_blocks") / w) + 1)
    overlap = F.aggregate(
        F.sequence(j0.cast("long"), j1.cast("long")), F.lit(0).cast("long"),
        lambda acc, j: acc + F.when(picked(j), F.greatest(F.lit(0), F.least(F.col("_end"), cut(j + 1)) - F.greatest(F.col("_from"), cut(j)))).otherwise(0).cast("long"),
    )
    taken = (F.col("passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("part") > 0), overlap).otherwise(0)).cast("long")
    if keep:
        return _copies(out.withColumn("taken", taken), seed).select("doc_id", "size", "source_size", "target", "taken", "copies", "row")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
