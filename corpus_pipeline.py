"""Corpus pipeline: quality, near duplicates, substring duplicates, mixing, tokens.

Stages take documents with any further columns, whatever their names, and
return the same columns (the last one token counts). Null ids are rows like
others; null and empty texts are scored, are copies of each other, lose no
words, come by their source's share, and have no tokens. Very long texts are
whole. Equal and repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, jaccard, mixing, quality, substrings
from spanforge.llm.common import stored, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each judged by its own text; null ids are judged too."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go."""
    return substrings.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in whole copies, so many that the words of a source's cells meet what the mix takes."""
    taken = mixing.mix(docs, keep=True)
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed corpus."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", unlike),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenised),
]

#: The classifier and the tokenizer can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
