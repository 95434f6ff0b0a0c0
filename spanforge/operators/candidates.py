"""Candidate spans of names by surnames, places and suffixes; Han text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import names as nm


def _any(cases: list[Column]) -> Column:
    return F.array_contains(F.array(*cases), True) if cases else F.lit(False)


def _all_han(c: Column) -> Column:
    return c.rlike(f"^{tx.HAN}+$")


def generate(rows: DataFrame, key: str = "sid", surnames: str = nm.SURNAMES) -> DataFrame:
    """(key, text, start, end, sources) of rows (key, text).

    Persons: a nickname prefix and surname; else a surname start that begins
    no stop word, two or three characters, four after a compound surname.
    Places: core places anywhere, and what ends in a place suffix.
    Organisations: what ends in an organisation suffix.
    """
    n = F.length("text")
    at = rows.where(n > 0).select(key, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    at = at.withColumn("rest", F.expr("substring(text, start + 1)")).withColumn("c", F.substring("rest", 1, 1)).withColumn("room", F.length("rest"))
    surname = F.col("c").isin(*surnames)
    nick = F.col("c").isin(*nm.NICKNAME_PREFIXES) & F.substring("rest", 2, 1).isin(*surnames)
    stopped = _any([F.col("rest").startswith(s) for s in nm.PERSON_STARTS])
    compound = F.substring("rest", 1, 2).isin(*nm.COMPOUND_SURNAMES)
    lengths = F.when(nick, F.array(F.lit(2))).when(surname & ~stopped, F.concat(F.array(F.lit(2), F.lit(3)), F.when(compound, F.array(F.lit(4))).otherwise(F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>"))
    span = lambda df, end, kind: df.select(key, "text", "start", end.cast("int").alias("end"), F.lit(kind).alias("kind"))
    persons = at.select("*", F.explode(lengths).alias("len")).where(F.col("len") <= F.col("room"))
    persons = span(persons, F.col("start") + F.col("len"), "PER")
    core = F.filter(F.array(*[F.when(F.col("rest").startswith(p), F.lit(len(p))) for p in nm.CORE_PLACES_MORE]), lambda x: x.isNotNull())
    core = at.select("*", F.explode(core).alias("len"))
    core = span(core, F.col("start") + F.col("len"), "LOC")

    def ending(suffixes: tuple[str, ...], least: int, most: int, stem: int, kind: str) -> DataFrame:
        sizes = F.filter(F.array(*[F.when(F.col("rest").startswith(s), F.lit(len(s))) for s in suffixes]), lambda x: x.isNotNull())
        ends = at.select(key, "text", "start", F.explode(sizes).alias("len")).withColumn("end", F.col("start") + F.col("len"))
        first = F.greatest(F.lit(least), F.col("len") + stem)
        whole = ends.where(first <= F.least(F.lit(most), F.col("end"))).select(key, "text", "end", F.explode(F.sequence(first, F.least(F.lit(most), F.col("end")))).alias("size"))
        return whole.select(key, "text", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(kind).alias("kind"))

    found = persons.unionByName(core).unionByName(ending(nm.PLACE_SUFFIXES, 2, 8, 1, "LOC")).unionByName(ending(nm.ALL_ORG_SUFFIXES, 2, 20, 2, "ORG"))
    v = F.expr("substring(text, start + 1, end - start)")
    bad_place = v.isin(*nm.PLACE_STOP_MORE) | _any([v.contains(x) for x in nm.PLACE_BAD_FRAGMENTS]) | _any([v.startswith(x) for x in nm.PLACE_BAD_PREFIXES])
    ok = _all_han(v) & ~((F.col("kind") == "LOC") & bad_place) & ~(F.col("kind").isin("LOC", "ORG") & F.substring(v, 1, 1).isin(*nm.BAD_STARTS)) & ~((F.col("kind") == "ORG") & v.isin(*nm.ORG_STOP))
    order = F.array(*[F.lit(k) for k in ("PER", "LOC", "ORG")])
    return found.where(ok).groupBy(key, "text", "start", "end").agg(F.collect_set("kind").alias("k")).select(key, "text", "start", "end", F.filter(order, lambda x: F.array_contains("k", x)).alias("sources"))


def longest_suffix(value: Column, suffixes: tuple[str, ...]) -> Column:
    """The longest suffix of the list that a value ends in, or a dash."""
    cases = [F.when(value.endswith(s), F.lit(s)) for s in sorted(suffixes, key=lambda s: (-len(s), s))]
    return F.coalesce(*cases, F.lit("-"))


def features(found: DataFrame) -> DataFrame:
    """candidates with `features`: length, sources, borders, cues, stems and suffixes."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    v = F.expr("substring(text, start + 1, end - start)")
    x = found.withColumn("v", v).withColumn("left", tx.char_at(text, start - 1)).withColumn("right", tx.char_at(text, end)).withColumn("before", F.expr("substring(text, 1, start)")).withColumn("after", F.expr("substring(text, end + 1)"))
    has = lambda k: F.array_contains("sources", k)
    out = [
        F.lit("bias"), F.concat(F.lit("length="), F.length("v").cast("string")), F.concat(F.lit("sources="), F.array_join("sources", "+")), F.concat(F.lit("first="), F.substring("v", 1, 1)), F.concat(F.lit("left1="), F.col("left")),
        F.concat(F.lit("right1="), F.col("right")), F.concat(F.lit("left_class="), tx.char_class(F.col("left"))), F.concat(F.lit("right_class="), tx.char_class(F.col("right"))), F.when(start == 0, F.lit("start=BOS")), F.when(end == F.length(text), F.lit("end=EOS")),
    ]
    cue = {}
    for k in ("PER", "LOC", "ORG"):
        left, right = _any([F.col("before").endswith(c) for c in nm.LEFT_CUES[k]]), _any([F.col("after").startswith(c) for c in nm.RIGHT_CUES[k]])
        cue[k] = (left, right)
        inside = _any([F.col("v").contains(c) for c in nm.LEFT_CUES[k] if len(c) > 1])
        out += [F.when(has(k) & left, F.lit(f"left_cue={k}")), F.when(has(k) & right, F.lit(f"right_cue={k}")), F.when(has(k) & inside, F.lit(f"contains_left_cue={k}")), F.when(has(k) & left & right, F.lit(f"both_cues={k}"))]
    for k, name, suffixes in (("LOC", "place", nm.PLACE_SUFFIXES), ("ORG", "org", nm.ALL_ORG_SUFFIXES)):
        s = longest_suffix(F.col("v"), suffixes)
        stem = F.when(s == "-", F.length("v")).otherwise(F.length("v") - F.length(s))
        out += [F.when(has(k), F.concat(F.lit(f"{name}_suffix="), s)), F.when(has(k), F.concat(F.lit(f"{name}_stem_length="), stem.cast("string")))]
    inner = sum((F.expr("substring(v, 1, length(v) - 1)").contains(s).cast("int") for s in nm.PLACE_SUFFIXES), F.lit(0))
    core = has("LOC") & F.col("v").isin(*nm.CORE_PLACES_MORE)
    out += [
        F.when(has("PER"), F.concat(F.lit("per_length="), F.length("v").cast("string"))), F.when(has("PER"), F.concat(F.lit("surname="), F.substring("v", 1, 1))), F.when(has("PER") & F.substring("v", 1, 1).isin(*nm.NICKNAME_PREFIXES), F.lit("nickname")),
        F.when(has("LOC"), F.concat(F.lit("internal_place_suffixes="), F.least(inner, F.lit(3)).cast("string"))), F.when(core, F.lit("core_place")), F.when(core & (start == 0), F.lit("core_place_at_bos")),
        F.when(core & cue["LOC"][0], F.lit("core_place_left_cue")), F.when(core & cue["LOC"][1], F.lit("core_place_right_cue")), *[F.when(has(k), F.lit(f"source={k}")) for k in ("PER", "LOC", "ORG")],
    ]
    return x.select(*found.columns, F.array_compact(F.array(*out)).alias("features"))


def decide(found: DataFrame, weights: DataFrame, margin: float = 1.0, key: str = "sid") -> DataFrame:
    """(key, spans): per candidate the best of its sources over NONE by more than `margin`, then the best disjoint ones."""
    from spanforge.operators.labels import disjoint

    x = found.select(key, "start", "end", "sources", F.explode("features").alias("feature")).join(weights, "feature", "left")
    score = x.groupBy(key, "start", "end", "sources").agg(*[F.sum(F.when(F.col("state") == k, F.round(F.col("weight") * 1_000_000).cast("long")).otherwise(0)).alias(k) for k in ("NONE", "PER", "LOC", "ORG")])
    best = F.array_sort(F.transform("sources", lambda s: F.struct((-F.when(s == "PER", F.col("PER")).when(s == "LOC", F.col("LOC")).otherwise(F.col("ORG"))).alias("k"), F.array_position("sources", s).alias("r"), s.alias("s"))))
    s = score.withColumn("b", F.element_at(best, 1)).withColumn("over", -F.col("b.k") - F.col("NONE")).where(F.col("over") > int(margin * 1_000_000))
    spans = F.collect_list(F.struct("start", "end", F.col("b.s").alias("type"), F.col("over").alias("over")))
    g = s.groupBy(key).agg(spans.alias("spans"))
    return g.select(key, disjoint(F.col("spans"), [lambda x: -x["over"], lambda x: -(x["end"] - x["start"]), lambda x: x["start"], lambda x: x["end"], lambda x: x["type"]]).alias("spans"))
