"""Group-safe splits, their statistics and leaks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SPLITS = (("train", 0.8), ("dev", 0.1), ("test", 0.1))


def by_group(rows: DataFrame, source: str = "source", group: str = "group_id") -> DataFrame:
    """(source, group_id, n, split): groups of a source go whole, largest first, where room is left most.

    Each goes to the split whose filled share would be least, ties in the
    order of SPLITS. Rows are counted before groups meet; what meets is a
    row a group of a source, which this sequential rule needs in one place.
    """
    n = rows.groupBy(source, group).agg(F.count("*").alias("n")).withColumn("_h", F.sha2(F.col(group), 256))
    kind = T.StructType([n.schema[source], n.schema[group], T.StructField("n", T.LongType()), T.StructField("split", T.StringType())])
    names = [s for s, _ in SPLITS]

    def put(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("_h", "ascending")])
        sizes = t["n"].to_pylist()
        target = [max(1.0, sum(sizes) * r) for _, r in SPLITS]
        filled, to = [0] * len(SPLITS), []
        others = range(1, len(SPLITS))
        for size in sizes:
            best, least = 0, (filled[0] + size) / target[0]
            for i in others:
                share = (filled[i] + size) / target[i]
                if share < least:  # the first of equals stays
                    best, least = i, share
            filled[best] += size
            to.append(names[best])
        return t.drop_columns(["_h"]).append_column("split", pa.array(to, pa.string()))

    return n.select(source, group, "n", "_h").groupBy(source).applyInArrow(put, kind)


def surfaces(words: DataFrame, limit: int, seed: int) -> DataFrame:
    """80 / 10 / 10 of a seeded order of distinct words; what one task numbers is `limit` words."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("word")), 256)
    top = words.select("word").distinct().orderBy(h, "word").limit(limit)
    r = top.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(h, "word")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return r.select("word", F.when(F.col("i") < F.floor(F.col("n") * 0.8), "train").when(F.col("i") < F.floor(F.col("n") * 0.9), "dev").otherwise("test").alias("split"))


def statistics(rows: DataFrame) -> DataFrame:
    """Sentences, groups, characters and entities of each split of (split, group_id, text, spans)."""
    return rows.groupBy("split").agg(F.count("*").alias("sentences"), F.countDistinct("group_id").alias("groups"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("spans")).alias("entities"))


def type_counts(rows: DataFrame) -> DataFrame:
    """Entities by split and type, with totals (null)."""
    return rows.select("split", F.explode("spans").alias("s")).rollup("split", F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


def leaks(rows: DataFrame) -> DataFrame:
    """Groups that stand in several splits."""
    return rows.groupBy("group_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """(text, split, origin, conflict): first, and what of `more` has a new text; conflict: the text is in another split."""
    seen = first.groupBy("text").agg(F.min("split").alias("_split"))
    fresh = more.join(seen, "text", "left").where("_split is null or _split <> split")
    return first.select("text", "split", F.lit("first").alias("origin"), F.lit(False).alias("conflict")).unionByName(
        fresh.select("text", "split", F.lit("more").alias("origin"), F.col("_split").isNotNull().alias("conflict"))
    )
