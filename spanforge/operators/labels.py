"""Label rows: types, repair of offsets, overlaps, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx


def known_type(kind: Column) -> Column:
    """The kind after aliases; null for skipped and unknown ones."""
    alias = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in schema.TYPE_ALIASES.items()], kind)
    return F.when(kind.isin(*schema.SKIPPED_TYPES), None).when(alias.isin(*schema.ENTITY_TYPES), alias)


def occurrences(text: Column, value: Column) -> Column:
    """Starts of the non-overlapping occurrences of a value, from the left."""
    parts = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    return F.when(
        F.size(sizes) > 0,
        F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: (F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n) + (i - 1) * F.length(value)).cast("int")),
    ).otherwise(F.array().cast("array<int>"))


def nearest(starts: Column, to: Column) -> Column:
    """The start closest to a place; of two the smaller, without a place the first."""
    return F.when(to.isNull(), F.array_min(starts)).otherwise(F.array_min(F.transform(starts, lambda s: F.struct(F.abs(s - to).alias("d"), s.alias("s"))))["s"])


_SPANS = "array<struct<start:int,end:int,type:string,text:string>>"


def repair(rows: DataFrame) -> DataFrame:
    """Entities of (id, text, entities) with aliases, relocated offsets and no overlaps.

    In the order given: kinds are mapped, skipped or dropped; an entity whose
    offsets don't hold its value, or whose span is taken, moves to the
    nearest occurrence that is free, or goes. Then the longest win. Negative
    offsets never hold.
    """
    item = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), known_type(e["type"]).alias("type"), e["text"].alias("text"), occurrences(F.col("text"), e["text"]).alias("at")))
    usable = rows.withColumn("_in", F.filter(item, lambda e: e["type"].isNotNull() & (F.coalesce(e["text"], F.lit("")) != "")))

    def place(done, e):
        taken = lambda s: F.exists(done, lambda d: (d["start"] == s) & (d["end"] == s + F.length(e["text"])))
        fits = (e["start"] >= 0) & (tx.slice_of(F.col("text"), e["start"], e["end"]) == e["text"]) & (e["end"] - e["start"] == F.length(e["text"])) & ~taken(e["start"])
        free = F.filter(e["at"], lambda s: ~taken(s))
        start = F.when(F.coalesce(fits, F.lit(False)), e["start"]).otherwise(nearest(free, e["start"]))
        new = F.struct(start.cast("int").alias("start"), (start + F.length(e["text"])).cast("int").alias("end"), e["type"].alias("type"), e["text"].alias("text"))
        return F.when(start.isNull(), done).otherwise(F.concat(done, F.array(new)))

    moved = F.aggregate("_in", F.array().cast(_SPANS), place)
    return usable.withColumn("entities", disjoint(moved, [lambda s: -(s["end"] - s["start"]), lambda s: s["start"], lambda s: s["end"]])).drop("_in")


def disjoint(spans: Column, order: list) -> Column:
    """Greedy: in this order, spans that overlap none before; the rest go. Sorted by start."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[f(s).alias(f"k{i}") for i, f in enumerate(order)], s.alias("s"))))
    first = F.transform(keyed, lambda k: k["s"])
    # An empty array of the right type, without naming it.
    none = F.slice(first, 1, 0)
    kept = F.aggregate(first, none, lambda done, s: F.when(F.forall(done, lambda d: (s["end"] <= d["start"]) | (s["start"] >= d["end"])), F.concat(done, F.array(s))).otherwise(done))
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s")))), lambda k: k["s"])


#: Rules of a label row, each true where it holds.
def rules() -> dict[str, Column]:
    e = F.coalesce(F.col("entities"), F.array().cast(_SPANS))
    text = F.col("text")
    ordered = F.array_sort(F.transform(e, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return {
        "has_id": F.coalesce(F.col("id") != "", F.lit(False)),
        "has_text": F.coalesce(text != "", F.lit(False)),
        "one_line": ~F.coalesce(text.rlike("[\\t\\r\\n]"), F.lit(False)),
        "has_entities": F.col("entities").isNotNull(),
        "known_types": F.forall(e, lambda x: F.coalesce(x["type"].isin(*schema.ENTITY_TYPES), F.lit(False))),
        "in_bounds": F.forall(e, lambda x: F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(text)), F.lit(False))),
        "same_text": F.forall(e, lambda x: F.coalesce(tx.slice_of(text, x["start"], x["end"]) == x["text"], F.lit(False))),
        "no_overlap": F.size(F.filter(F.transform(ordered, lambda x, i: (i > 0) & (x["start"] < F.element_at(ordered, F.greatest(i, F.lit(1)))["end"])), lambda bad: bad)) == 0,
    }


def validate(rows: DataFrame) -> DataFrame:
    """rows with `failed`, the names of the rules that don't hold."""
    checks = [F.when(~ok, F.lit(name)) for name, ok in rules().items()]
    return rows.withColumn("failed", F.array_compact(F.array(*checks)))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n) of values that occur more than once."""
    out = None
    for k in keys:
        part = rows.groupBy(F.col(k).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(k).alias("key"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def complete(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Ids that are missing, unknown or repeated in an answer."""
    n = answered.groupBy("id").agg(F.count("*").alias("n"))
    a = asked.select(F.col("id").alias("_id")).distinct()
    both = a.join(n, F.col("_id") == F.col("id"), "full")
    fault = F.when(F.col("id").isNull(), "missing").when(F.col("_id").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select(F.coalesce("_id", "id").alias("id"), fault.alias("fault")).where("fault is not null")


def require_none(faults: DataFrame, what: str) -> None:
    """Raise if there is a row of faults, such as of `duplicates` or `complete`."""
    if bad := faults.limit(3).collect():
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in bad))


def encode(spans: Column) -> Column:
    """start:end:type joined by commas, or a dash."""
    return F.coalesce(F.nullif(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["type"])), ","), F.lit("")), F.lit("-"))


def decode(encoded: Column) -> Column:
    """The spans of an encoded list."""
    part = lambda p, i: F.element_at(F.split(p, ":"), i)
    some = F.filter(F.split(encoded, ","), lambda p: p != "-")
    return F.transform(some, lambda p: F.struct(part(p, 1).cast("int").alias("start"), part(p, 2).cast("int").alias("end"), part(p, 3).alias("type")))


def annotate(rows: DataFrame, annotator, batch: int = 8, retries: int = 2) -> DataFrame:
    """Run a pluggable annotator over Arrow batches: list of (id, text) -> {id: entities as JSON}.

    A failed batch is tried again up to `retries` times, then it raises. The
    library ships no network client; `annotator` must be picklable.
    """

    def run(parts):
        for pdf in parts:
            out = []
            for k in range(0, len(pdf), batch):
                own = list(zip(pdf["id"].iloc[k : k + batch], pdf["text"].iloc[k : k + batch], strict=True))
                for attempt in range(retries + 1):
                    try:
                        said = annotator(own)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                out += [(i, t, said.get(i, "[]")) for i, t in own]
            yield pd.DataFrame(out, columns=["id", "text", "entities_json"])

    found = rows.select("id", "text").mapInPandas(run, "id string, text string, entities_json string")
    return found.select("id", "text", F.from_json("entities_json", _SPANS).alias("entities"))
