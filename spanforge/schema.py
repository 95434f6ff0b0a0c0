"""Record shapes, entity types and tag state systems."""

from __future__ import annotations

from pyspark.sql import types as T

SENTENCE = T.StructType([T.StructField("id", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField("text", T.StringType())])
ENTITY = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
LABEL = T.StructType(
    [*[T.StructField(c, T.StringType()) for c in ("id", "group_id", "text", "annotator", "source")], T.StructField("entities", T.ArrayType(ENTITY))]
)
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())])
CASE = T.StructType([*[T.StructField(c, T.StringType()) for c in ("group_id", "source", "text")], T.StructField("spans", T.ArrayType(T.ArrayType(T.StringType())))])

# The label vocabulary.
ENTITY_TYPES = (
    "PER", "LOC", "ORG", "FAC", "PRODUCT", "BRAND", "SOFTWARE", "HARDWARE", "MODEL", "DISEASE", "DRUG", "PATHOGEN", "GENE_PROTEIN", "CHEMICAL", "MATERIAL", "SPECIES", "EVENT", "WORK", "LAW", "TECH",
)
TYPE_ALIASES = {"PERSON": "PER", "LOCATION": "LOC", "ORGANIZATION": "ORG", "FACILITY": "FAC", "POLICY": "LAW", "STRATEGY": "LAW", "STANDARD": "LAW"}
SKIPPED_TYPES = ("DATE", "TIME", "MONEY", "PERCENT", "QUANTITY")
LEGACY_TYPES = ("PER", "LOC", "ORG")


def states(types: tuple[str, ...] | None = None) -> list[str]:
    """Tag states: O B M E S, or O and four for each type."""
    return ["O", *"BMES"] if types is None else ["O", *(f"{p}_{t}" for t in types for p in "BMES")]


def _split(state: str) -> tuple[str, str]:
    head, _, kind = state.partition("_")
    return head, kind


def may_follow(a: str, b: str) -> bool:
    """Whether tag b may stand right after tag a."""
    (pa, ka), (pb, kb) = _split(a), _split(b)
    return pb in "ME" and ka == kb if pa in "BM" else pb in "OBS"


def may_start(s: str) -> bool:
    return _split(s)[0] in "OBS"


def may_end(s: str) -> bool:
    return _split(s)[0] in "OES"
