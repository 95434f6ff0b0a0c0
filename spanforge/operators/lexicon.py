"""Lexicons: counting, matching, scored candidates, features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx

#: A lexicon of at most so many words is broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 200_000


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WORDS else df


def tokens_of_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Rows of each line's tokens in order."""
    return lines.select(F.filter(F.split(tx.strip(F.col(text)), " "), lambda w: w != "").alias("tokens"))


def build(lines: DataFrame, text: str = "text") -> DataFrame:
    """Words that occur more often than as two neighbouring tokens written together: (word, n)."""
    rows = tokens_of_lines(lines, text)
    n = rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    joined = F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(1))), lambda a, b: F.concat(a, b))
    compounds = rows.where(F.size("tokens") > 1).select(F.explode(joined).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    return n.join(compounds, "word", "left").where(F.coalesce("c", F.lit(0)) < F.col("n")).select("word", "n")


def bounded(words: DataFrame, most: int, least: int = 2) -> DataFrame:
    return words.where(F.length("word").between(least, most))


def frequent_surfaces(entities: DataFrame, least_count: int, most: int = 12) -> DataFrame:
    """Entity surfaces seen `least_count` times or more; 0 gives none."""
    counted = bounded(entities.withColumnRenamed("surface", "word"), most).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.lit(least_count) > 0) & (F.col("n") >= least_count))


def match(sentences: DataFrame, words: DataFrame, most: int = 12, keep: tuple[str, ...] = ("sid", "text")) -> DataFrame:
    """All places of all lexicon words of 2 to `most` characters, overlapping ones too.

    Starts whose two characters begin no word are dropped first, and only
    lengths that words of that beginning have are looked up; the lexicon is
    broadcast only if it is small enough.
    """
    lex = bounded(words.select("word").distinct(), most)
    head = F.substring("word", 1, 2)
    rows, n_heads = lex.agg(F.count("*"), F.count_distinct(head)).first()
    heads = lex.groupBy(head.alias("_head")).agg(F.collect_set(F.length("word")).alias("_lengths"))
    starts = sentences.where(F.length("text") >= 2).select(*keep, F.explode(F.sequence(F.lit(0), F.length("text") - 2)).alias("start"))
    near = starts.withColumn("_head", F.substring(F.col("text"), F.col("start") + 1, F.lit(2))).join(_side(heads, n_heads), "_head")
    spans = near.select(*keep, "start", F.explode(F.filter("_lengths", lambda n: F.col("start") + n <= F.length("text"))).alias("_n"))
    spans = spans.select(*keep, "start", (F.col("start") + F.col("_n")).alias("end"), F.substring(F.col("text"), F.col("start") + 1, F.col("_n")).alias("word"))
    return spans.join(_side(lex, rows), "word").select(*keep, "start", "end", "word")


def scored_candidates(sentences: DataFrame, words: DataFrame, least: int = 2, most: int = 12, per_char: float = 60.0, penalty: float = 10.0) -> DataFrame:
    """Matches that cut no ASCII run, scored by word score and length; words may have `score`."""
    lex = words if "score" in words.columns else words.withColumn("score", F.lit(0.0))
    found = match(sentences, lex, most).where((F.col("end") - F.col("start") >= least) & ~tx.ascii_cut(F.col("text"), F.col("start"), F.col("end")))
    return found.join(lex.groupBy("word").agg(F.max("score").alias("score")), "word").withColumn("score", F.col("score") + F.lit(per_char) * (F.col("end") - F.col("start")) - F.lit(penalty))


def features(matches: DataFrame, prefix: str = "lx") -> DataFrame:
    """(sid, pos, feature): role of each position in a match, plain and with its length bucket."""
    n = F.col("end") - F.col("start")
    pos = matches.select("sid", "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    role = _role(F.col("pos"), F.col("start"), F.col("end"))
    both = F.array(F.concat(F.lit(prefix + "="), role), F.concat(F.lit(prefix + "="), role, F.lit(":"), tx.length_bucket(n)))
    return pos.select("sid", "pos", F.explode(both).alias("feature")).distinct()


def places(spans: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each place of each span (start, end) of texts of a size: its text, the place, start, end, and the span's rank of all."""
    own = spans.flatten()
    start, end = (own.field(k).to_numpy().astype(np.int64) for k in ("start", "end"))
    of = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
    low = np.maximum(start, 0)
    n = np.maximum(np.minimum(end, size[of]) - low, 0)
    rank = np.repeat(np.arange(len(n)), n)
    return of[rank], np.arange(n.sum()) - (np.cumsum(n) - n - low)[rank], start[rank], end[rank], rank


def _role(pos: Column, start: Column, end: Column) -> Column:
    return F.when(pos == start, "B").when(pos == end - 1, "E").otherwise("M")


def roles(matches: Column, pos: Column) -> Column:
    """The roles of a position in an array of matches (start, end), with their length buckets, each once."""
    own = F.filter(matches, lambda m: (m["start"] <= pos) & (pos < m["end"]))
    return F.array_sort(F.array_distinct(F.transform(own, lambda m: F.concat(_role(pos, m["start"], m["end"]), F.lit(":"), tx.length_bucket(m["end"] - m["start"])))))


def of_roles(found: Column, prefix: str = "lx") -> Column:
    """The features of `features` for a position of these roles."""
    name = lambda r: F.concat(F.lit(prefix + "="), r)
    return F.array_distinct(F.concat(F.transform(found, lambda r: name(F.substring_index(r, ":", 1))), F.transform(found, name)))


def masks(matches: DataFrame) -> DataFrame:
    """(sid, pos, mask): a bit for each role (B, M, E, S) and length (2, 3, 4, 5 or more) that a place has in a match."""
    n = F.col("end") - F.col("start")
    pos = matches.select("sid", n.alias("n"), "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    role = F.when(F.col("n") == 1, 3).when(F.col("pos") == F.col("start"), 0).when(F.col("pos") == F.col("end") - 1, 2).otherwise(1)
    bit = role * 4 + F.least(F.greatest(F.col("n"), F.lit(2)), F.lit(5)) - 2
    return pos.select("sid", "pos", F.expr("1").alias("one"), bit.alias("bit")).groupBy("sid", "pos").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("mask"))


def trie(words: DataFrame) -> DataFrame:
    """(prefix, word_id, score) of words (line, word, score): of equal words the last counts; null where no word ends."""
    last = words.groupBy("word").agg(F.max(F.struct("line", "score")).alias("last"))
    p = last.select("word", "last", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n")).select(F.expr("substring(word, 1, n)").alias("prefix"), F.when(F.col("n") == F.length("word"), F.col("last")).alias("last"))
    return p.groupBy("prefix").agg(F.first("last", ignorenulls=True).alias("last")).select("prefix", F.col("last.line").alias("word_id"), F.col("last.score").alias("score"))


def union(*lists: DataFrame) -> DataFrame:
    """The words of several lists once, without those that start with `#`."""
    out = lists[0].select("word")
    for more in lists[1:]:
        out = out.unionByName(more.select("word"))
    return out.where(~F.col("word").startswith("#")).distinct()


def without(words: DataFrame, reserved: DataFrame) -> DataFrame:
    """words but for the reserved ones (word)."""
    return words.join(reserved.select("word").distinct(), "word", "left_anti")


def prefixes(words: DataFrame) -> DataFrame:
    """The trie as a table: each prefix, and whether it is a word."""
    p = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    return p.groupBy(F.expr("substring(word, 1, n)").alias("prefix")).agg(F.max((F.col("n") == F.length("word")).cast("int")).alias("is_word"))
