"""Manifests: hashes of files, references between manifests, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, sha256) of files; a file is read by one task."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def referenced(labels: DataFrame, inputs: DataFrame) -> DataFrame:
    """labels (path, sha256) that a manifest's inputs (path, sha256) name with the same hash."""
    return labels.join(inputs.select("path", "sha256"), ["path", "sha256"], "left_semi")


def unreferenced(labels: DataFrame, inputs: DataFrame) -> DataFrame:
    """labels that no input names, or with another hash: (path, sha256, fault)."""
    known = inputs.select("path", F.lit(True).alias("_known")).distinct()
    left = labels.join(inputs.select("path", "sha256"), ["path", "sha256"], "left_anti").join(known, "path", "left")
    return left.select("path", "sha256", F.when(F.col("_known"), "other hash").otherwise("not named").alias("fault"))


def names(*lists: DataFrame) -> DataFrame:
    """The file names (name) of several source lists, each once."""
    out = lists[0].select("name")
    for more in lists[1:]:
        out = out.unionByName(more.select("name"))
    return out.distinct()


def licences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Faults of the gate (name, fault): a text (name, sha256, text) is missing, has another hash, or lacks its marker.

    wanted: (name, sha256 or null, marker).
    """
    w = wanted.select("name", F.col("sha256").alias("_sha"), "marker").join(texts.select("name", "sha256", "text"), "name", "left")
    fault = F.when(F.col("text").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "other hash").when(~F.col("text").contains(F.col("marker")), "no marker")
    return w.select("name", fault.alias("fault")).where("fault is not null")
