"""Sentences: split, normalise, bound, filter, de-duplicate, sample, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx


def sentences(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id", "source"), least: int = 8, most: int = 120) -> DataFrame:
    """One row a sentence of `least` to `most` characters, in the order of `pos`."""
    column = F.col(text) if isinstance(text, str) else text
    out = docs.select(*keep, F.posexplode(tx.pieces(column)).alias("pos", "text"))
    return out.where(F.length("text").between(least, most))


def in_category(docs: DataFrame, pattern: str, column: str = "category") -> DataFrame:
    """Rows whose category matches the pattern somewhere; an empty pattern keeps all."""
    return docs.where(F.coalesce(F.col(column).cast("string"), F.lit("")).rlike(pattern)) if pattern else docs


def distinct_sentences(found: DataFrame, scope: str, group: str = "doc_id") -> DataFrame:
    """The first of equal texts, by group and position, with stable ids.

    A minimum combines before the shuffle, so a text that is everywhere is
    one row a task.
    """
    first = found.groupBy("text").agg(F.min(F.struct(group, "pos")).alias("at"))
    return first.select(tx.stable_id(F.col("text")).alias("sid"), tx.stable_id(F.concat(F.lit(scope + ":"), F.col(f"at.{group}").cast("string"))).alias("group_id"), "text")


def sample(rows: DataFrame, limit: int, seed: int = 41, key: str = "sid") -> DataFrame:
    """A seeded sample: the rows of the smallest hashes, the same on any cluster."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key).limit(limit)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def backfill_groups(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels with the group of the row of the same id; unmatched on either side are told."""
    r = rows.select(F.col("id").alias("_id"), F.col("group_id").alias("_group"))
    out = labels.drop("group_id").join(r, F.col("id") == F.col("_id"), "full")
    side = F.when(F.col("id").isNull(), "row only").when(F.col("_id").isNull(), "label only").otherwise("both")
    return out.withColumn("matched", side).withColumn("id", F.coalesce("id", "_id")).withColumnRenamed("_group", "group_id").drop("_id")


def keep_order(wanted: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows for those keys that exist, in the order of `wanted`."""
    return wanted.select(key, order).join(rows.drop(order), key).orderBy(order)


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Number of the batch of each row from a gapless order that starts at 0."""
    return rows.withColumn("batch", F.floor(F.col(order) / size).cast("long"))


def first_words(lines: DataFrame, limit: int, least: int = 2, most: int = 12) -> DataFrame:
    """The first `limit` distinct usable words by line; fewer are an error to the caller (`short`)."""
    word = F.element_at(F.split(tx.strip(F.col("value")), " "), 1)
    found = lines.select("line", word.alias("word")).where(F.length("word").between(least, most) & ~F.col("word").startswith("#"))
    return found.groupBy("word").agg(F.min("line").alias("line")).orderBy("line").limit(limit)
