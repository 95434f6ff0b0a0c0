"""Tag sequences: spans to tags and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.operators import lexicon


def spans_to_tags(text: Column, spans: Column, typed: bool = True) -> Column:
    """One tag a character; spans are disjoint. An empty text has none."""

    def tag(i: Column) -> Column:
        own = F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
        s = F.element_at(own, 1)
        role = F.when(s["end"] - s["start"] == 1, "S").when(i == s["start"], "B").when(i == s["end"] - 1, "E").otherwise("M")
        return F.when(F.size(own) == 0, "O").otherwise(F.concat(role, F.lit("_"), s["type"]) if typed else role)

    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), tag))


def numbers(size: np.ndarray, spans: pa.ListArray, states: tuple[str, ...], typed: bool) -> np.ndarray:
    """The tags of `spans_to_tags` of texts of a size, as numbers of states; -1 if there is none."""
    of, i, start, end, rank = lexicon.places(spans, size)
    role = np.where(end - start == 1, 3, np.where(i == start, 0, np.where(i == end - 1, 2, 1)))
    kind = spans.flatten().field("type").dictionary_encode() if typed else None
    at, names = {s: k for k, s in enumerate(states)}, kind.dictionary.to_pylist() if typed else [None]
    state = np.array([[at.get(r if t is None else f"{r}_{t}", -1) for r in "BMES"] for t in names] + [[-1] * 4], np.int8)
    own = kind.indices.fill_null(len(names)).to_numpy()[rank] if typed else 0
    out = np.full(size.sum(), at["O"], np.int8)
    out[((np.cumsum(size) - size)[of] + i)[::-1]] = state[own, role][::-1]  # the first span of a place counts
    return out


def exploded(cases: DataFrame, key: str = "sid", typed: bool = True) -> DataFrame:
    """(key, pos, char, tag) of cases (key, text, spans)."""
    return cases.select(key, "text", F.posexplode(spans_to_tags(F.col("text"), F.col("spans"), typed)).alias("pos", "tag")).select(
        key, "pos", F.expr("substring(text, pos + 1, 1)").alias("char"), "tag"
    )


def _head(t: Column) -> Column:
    return F.substring(t, 1, 1)


def _kind(t: Column) -> Column:
    return F.when(F.length(t) > 2, F.substring(t, F.lit(3), F.length(t))).otherwise(F.lit("ENTITY"))


def legal(tags: Column, typed: bool = True) -> Column:
    """Whether a sequence obeys the state system."""
    states = schema.states(schema.ENTITY_TYPES if typed else None)
    n = F.size(tags)
    prev = lambda i: F.element_at(tags, F.greatest(i, F.lit(1)))
    follows = lambda a, b: F.when(_head(a).isin("B", "M"), _head(b).isin("M", "E") & (_kind(a) == _kind(b))).otherwise(_head(b).isin("O", "B", "S"))
    steps = F.transform(tags, lambda t, i: (i == 0) | follows(prev(i), t))
    known = F.forall(tags, lambda t: t.isin(*states))
    return (n == 0) | (known & F.forall(steps, lambda ok: ok) & _head(F.element_at(tags, 1)).isin("O", "B", "S") & _head(F.element_at(tags, -1)).isin("O", "E", "S"))


def tags_to_spans(tags: Column) -> Column:
    """Spans of the well-formed runs of a sequence: S, or B M* E of one type; others are skipped.

    For a legal sequence (see `legal`) these are all its spans.
    """
    n = F.size(tags)

    def close(t: Column, i: Column) -> Column:
        """End of the entity that starts at i, or null."""
        rest = F.slice(tags, i + 2, n)
        stop = F.array_min(F.filter(F.transform(rest, lambda r, j: F.when((_head(r) != "M") | (_kind(r) != _kind(t)), F.struct(j.alias("j"), r.alias("r")))), lambda x: x.isNotNull()))
        return F.when((_head(stop["r"]) == "E") & (_kind(stop["r"]) == _kind(t)), (i + stop["j"] + 2).cast("int"))

    at = F.transform(
        tags,
        lambda t, i: F.when(_head(t) == "S", F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), _kind(t).alias("type"))).when(_head(t) == "B", F.struct(i.cast("int").alias("start"), close(t, i).alias("end"), _kind(t).alias("type"))),
    )
    return F.filter(at, lambda s: s.isNotNull() & s["end"].isNotNull())


def strict_spans(tags: Column, typed: bool = True) -> Column:
    """The spans of a legal sequence; any other is an error."""
    told = F.raise_error(F.concat(F.lit("not a legal tag sequence: "), F.array_join(tags, " ")))
    return F.when(legal(tags, typed), tags_to_spans(tags)).otherwise(told)
