"""Synthetic rows with gold spans: templates, combinations, negatives, constructed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx


def numbered(words: DataFrame, word: str = "word", by: list[str] | None = None) -> DataFrame:
    """words with `i`, their rank from 0 in code-point order (in each group of `by`).

    Without groups, words are counted by their first two characters, and
    ranked among those of the same two: no task numbers all.
    """
    if by:
        return words.withColumn("i", (F.row_number().over(Window.partitionBy(*by).orderBy(word)) - 1).cast("long"))
    head = words.withColumn("_head", F.substring(word, 1, 2))
    before = head.groupBy("_head").agg(F.count("*").alias("_n"))
    before = before.select("_head", (F.sum("_n").over(Window.orderBy("_head")) - F.col("_n")).alias("_before"))  # a row a beginning
    rank = F.row_number().over(Window.partitionBy("_head").orderBy(word)) - 1
    return head.withColumn("_rank", rank).join(before, "_head").withColumn("i", (F.col("_rank") + F.col("_before")).cast("long")).drop("_head", "_rank", "_before")


def from_templates(words: DataFrame, templates: list[str], kind: str, prefix: str, both: bool = True) -> DataFrame:
    """Rows (id, group_id, text, start, end, type) of words put into templates at `{word}`.

    With `both`, every word goes into every template; else word i goes into
    template i modulo their number. The start is the first place of the word.
    """
    spark = words.sparkSession
    t = F.broadcast(spark.createDataFrame(list(enumerate(templates)), "k long, template string"))
    met = words.join(t, F.lit(True), "inner") if both else words.join(t, F.pmod(F.col("i"), F.lit(len(templates))) == F.col("k"))
    text = F.replace(F.col("template"), F.lit("{word}"), F.col("word"))
    out = met.withColumn("text", text).withColumn("start", (F.instr(F.col("text"), F.col("word")) - 1).cast("int"))
    return out.select(
        tx.salted_id(prefix + "-text", F.col("text")).alias("id"), tx.salted_id(prefix + "-group", F.col("word")).alias("group_id"), "text",
        "start", (F.col("start") + F.length("word")).cast("int").alias("end"), F.lit(kind).alias("type"),
    )


def render(*parts: str | tuple[Column, str]) -> tuple[Column, Column]:
    """Text and spans of literal parts and (value, kind) parts, in order."""
    text, at, spans = F.lit(""), F.lit(0), []
    for part in parts:
        value = F.lit(part) if isinstance(part, str) else part[0]
        if not isinstance(part, str):
            spans.append(F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), F.lit(part[1]).alias("type")))
        text, at = F.concat(text, value), at + F.length(value)
    return text, F.array(*spans)


def combined(persons: DataFrame, places: DataFrame, orgs: DataFrame, limit: int, shape: list) -> DataFrame:
    """Rows that zip the three lists by rank; `shape` holds literals and PER, LOC, ORG."""
    p, l, o = (numbered(d).where(F.col("i") < limit).select("i", F.col("word").alias(k)) for d, k in ((persons, "PER"), (places, "LOC"), (orgs, "ORG")))
    text, spans = render(*[(F.col(x), x) if x in ("PER", "LOC", "ORG") else x for x in shape])
    return p.join(l, "i").join(o, "i").select("i", text.alias("text"), spans.alias("spans"))


def repeated(samples: DataFrame, times: int) -> DataFrame:
    """`times` rows that go round the samples (word, i) in order."""
    n = samples.count()
    if not n:
        return samples.select(F.lit(0).cast("long").alias("row"), "word").limit(0)
    rows = samples.sparkSession.range(times).select(F.col("id").alias("row"), F.pmod("id", F.lit(n)).alias("i"))
    return rows.join(F.broadcast(samples), "i").select("row", "word")


def strip_suffix(word: Column, suffixes: list[str], stem: int = 2) -> Column:
    """The word without the first suffix of the list that leaves `stem` characters."""
    cases = [F.when(word.endswith(s) & (F.length(word) >= len(s) + stem), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in suffixes]
    return F.coalesce(*cases, word)


def organisations(places: DataFrame, place_suffixes: list[str], org_suffixes: list[str], reserved: list[str], limit: int) -> DataFrame:
    """Names from stems of places (word, i) and the suffix of their rank; first wins, reserved go."""
    stem = strip_suffix(F.col("word"), place_suffixes)
    suffix = F.element_at(F.array(*[F.lit(s) for s in org_suffixes]), (F.pmod("i", F.lit(len(org_suffixes))) + 1).cast("int"))
    made = places.select("i", stem.alias("stem"), suffix.alias("suffix")).where(F.length("stem") >= 2).select("i", F.concat("stem", "suffix").alias("word"))
    return made.where(~F.col("word").isin(*reserved) if reserved else F.lit(True)).groupBy("word").agg(F.min("i").alias("i")).orderBy("i").limit(limit)


def nicknames(surnames: DataFrame, prefixes: list[str], reserved: DataFrame) -> DataFrame:
    """Each prefix with each surname (word), without the reserved."""
    p = F.explode(F.array(*[F.lit(x) for x in prefixes]))
    return surnames.select("word", p.alias("p")).select(F.concat("p", "word").alias("word")).join(reserved.select("word"), "word", "left_anti")


def is_person(word: Column, surnames: str, stop: list[str]) -> Column:
    return F.length(word).between(2, 4) & word.rlike(f"^{tx.HAN}+$") & F.substring(word, 1, 1).isin(*surnames) & ~word.isin(*stop)


def is_place(word: Column, suffixes: list[str], core: list[str], stop: list[str], bad_suffixes: list[str]) -> Column:
    ends = lambda s: word.endswith(s)
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    good = word.isin(*core) | any_of([ends(s) & (F.length(word) > len(s)) for s in suffixes])
    return F.length(word).between(2, 8) & word.rlike(f"^{tx.HAN}+$") & ~word.isin(*stop) & ~any_of([ends(s) for s in bad_suffixes]) & good
