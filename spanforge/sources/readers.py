"""Readers: corpora, label rows, cases, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx
from spanforge.operators import labels


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines of text files, numbered within each file from 1.

    A file is one row while its lines are numbered: for word lists and
    cases. A byte order mark goes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    split = F.split(F.regexp_replace("t", "^﻿", ""), "\r\n|\r|\n")
    return files.select("path", F.posexplode(split).alias("i", "value")).select("path", (F.col("i") + 1).cast("long").alias("line"), "value")


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    """The first rows in the order in which they are read."""
    return rows if n is None else rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")


def corpus_json(spark: SparkSession, path: str, fields: tuple[str, ...] = ("title", "desc", "answer"), scan_rows: int | None = None) -> DataFrame:
    """Rows (id, category, text) of JSON lines; fields are joined by a full stop."""
    columns = ", ".join(f"`{c}` string" for c in dict.fromkeys(("id", "category", *fields)))
    df = _first(spark.read.schema(columns).json(path), scan_rows)
    return df.select("id", "category", tx.join_fields(*[F.col(f) for f in fields]).alias("text"))


def corpus_csv(spark: SparkSession, path: str, fields: tuple[str, ...] = ("headline", "content"), scan_rows: int | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", escape='"')
    df = _first(df, scan_rows)
    at = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.select(at("id").alias("id"), at("category").alias("category"), tx.join_fields(*[at(f) for f in fields]).alias("text"))


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Label rows with `source`, the file that they come from."""
    return spark.read.schema(schema.LABEL).json(path).withColumn("source", F.col("_metadata.file_path"))


def last_labels(numbered: DataFrame) -> DataFrame:
    """Of rows (line, id, ...) of one id the last, at the place of the first."""
    others = [c for c in numbered.columns if c not in ("id", "line")]
    g = numbered.groupBy("id").agg(F.min("line").alias("line"), F.max(F.struct("line", *others)).alias("last"))
    return g.select("id", "line", *[F.col(f"last.{c}").alias(c) for c in others])


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, ...) of a label file, to take the last of each id."""
    parsed = lines(spark, path).where(F.trim("value") != "").select("line", F.from_json("value", schema.LABEL).alias("r"))
    return parsed.select("line", "r.*")


def cases_json(spark: SparkSession, path: str) -> DataFrame:
    """Case rows (group_id, source, text, spans, ok): spans are sorted, known, in bounds and disjoint."""
    df = spark.read.schema(schema.CASE).json(path)
    spans = F.transform("spans", lambda s: F.struct(s[0].cast("int").alias("start"), s[1].cast("int").alias("end"), s[2].alias("type")))
    df = df.withColumn("spans", spans)
    sound = F.forall("spans", lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")) & s["type"].isin(*schema.ENTITY_TYPES), F.lit(False)))
    ordered = F.aggregate("spans", F.lit(0), lambda c, s: F.when((c >= 0) & (s["start"] >= c), s["end"]).otherwise(-1)) >= 0
    return df.withColumn("ok", F.coalesce(sound & ordered & (F.col("text") != ""), F.lit(False)))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Label rows of several files; an id or a text that occurs twice is an error."""
    rows = label_rows(spark, path)
    labels.require_none(labels.duplicates(rows, "id", "text"), "repeated")
    return rows


def cases_strict(spark: SparkSession, path: str) -> DataFrame:
    """`cases_tsv`, but a case whose spans aren't known, in bounds, in order and disjoint is an error."""
    sound = F.forall("spans", lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")) & s["type"].isin(*schema.ENTITY_TYPES), F.lit(False)))
    ordered = F.aggregate("spans", F.lit(0), lambda c, s: F.when((c >= 0) & (s["start"] >= c), s["end"]).otherwise(-1)) >= 0
    told = F.raise_error(F.concat(F.lit("bad case in line "), F.col("line").cast("string"), F.lit(" of "), F.col("path")))
    return cases_tsv(spark, path).withColumn("spans", F.when(sound & ordered & (F.col("text") != ""), F.col("spans")).otherwise(told))


def cases_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text, spans) of tab-separated cases; `#` lines are comments, a dash is no span."""
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = F.split("value", "\t", 2)
    return rows.select("path", "line", part[0].alias("text"), labels.decode(F.coalesce(F.get(part, F.lit(1)), F.lit("-"))).alias("spans"))


def cases_for_merge(cases: DataFrame, split: str) -> DataFrame:
    """(group_id, text, encoded): each case is a group of its own, named by its content."""
    encoded = labels.encode(F.col("spans"))
    name = tx.stable_id(F.concat(F.col("text"), F.lit("\0"), encoded), 20)
    return cases.select(F.concat(F.lit(f"case-{split}-"), name).alias("group_id"), "text", encoded.alias("encoded"))


def frequency_words(rows: DataFrame) -> DataFrame:
    """(word, freq) of lines `word freq`; a missing or bad frequency is 0."""
    part = F.split(tx.strip(F.col("value")), " ")
    return rows.where(tx.strip(F.col("value")) != "").select(part[0].alias("word"), F.coalesce(F.get(part, F.lit(1)).try_cast("long"), F.lit(0)).alias("freq"))


def scored_words(rows: DataFrame, hash_words: bool = False) -> DataFrame:
    """(word, score) of lines `word [score]`; 1.0 if there is none; words above 65,535 bytes go."""
    part = F.split(tx.strip(F.col("value")), " ")
    usable = (tx.strip(F.col("value")) != "") & (F.octet_length(part[0]) <= 65535) & (F.lit(hash_words) | ~F.col("value").startswith("#"))
    return rows.where(usable).select(part[0].alias("word"), F.coalesce(F.get(part, F.lit(1)).try_cast("float"), F.lit(1.0)).cast("float").alias("score"))
