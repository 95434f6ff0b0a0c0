"""Prompts for annotators: instructions and a batch of rows as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema

#: Our own wording; pass another builder for another.
LABEL = "Label the named entities of each row. Answer with JSON only: {\"rows\": [{\"id\", \"text\", \"entities\": [{\"start\", \"end\", \"type\", \"text\"}]}]}. Offsets are code points, half-open; spans don't overlap; the text stays as it is. Types: "
REVIEW = "Review the entities of each row: drop what is no name, mend types and borders, add what is missing. Answer with JSON only, in the form of the input. Types: "


def labelling(batch: Column) -> Column:
    """A prompt for an array of rows (id, text)."""
    return F.concat(F.lit(LABEL + ", ".join(schema.ENTITY_TYPES) + ".\nRows: "), F.to_json(batch))


def reviewing(batch: Column) -> Column:
    """A prompt for an array of labelled rows (id, text, entities)."""
    return F.concat(F.lit(REVIEW + ", ".join(schema.ENTITY_TYPES) + ".\nRows: "), F.to_json(batch))


def prompts(rows: DataFrame, size: int = 8, builder: Callable[[Column], Column] = labelling, batch: str = "batch", order: str = "id", columns: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """(batch, n, prompt) of rows that have the number of their batch (see `corpus.batches`).

    builder: any function of an array of rows to a prompt. A batch holds `size`
    rows at most by its number, so what is gathered is small.
    """
    item = F.struct(*columns)
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("r")))), lambda x: x["r"])
    return rows.groupBy(batch).agg(F.count("*").alias("n"), own.alias("_rows")).select(batch, "n", builder(F.col("_rows")).alias("prompt"))


def snapshot(made: DataFrame, path: str, batch: str = "batch") -> None:
    """Write the prompt of the first batch as text."""
    made.orderBy(batch).limit(1).select("prompt").coalesce(1).write.mode("overwrite").text(path)
