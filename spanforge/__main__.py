"""Command line: python -m spanforge COMMAND ...; run it with spark-submit on a cluster."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import corpus, evaluate, features, labels, perceptron, split, tags, viterbi
from spanforge.sources import readers, sinks


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sentences of a corpus, filtered, de-duplicated and sampled."""
    fields = tuple(a.text_fields.split(",")) if a.text_fields else None
    read = readers.corpus_csv if a.input.endswith(".csv") else readers.corpus_json
    rows = read(spark, a.input, *([fields] if fields else []), scan_rows=a.scan_rows)
    rows = corpus.in_category(rows, a.category_pattern)
    found = corpus.sentences(rows, keep=("id",), least=a.min_chars, most=a.max_chars)
    done = spark.read.json(a.resume).select(F.col("id").alias("sid")) if a.resume else None
    out = corpus.distinct_sentences(found, a.input, "id")
    out = corpus.pending(out, done, "sid") if done is not None else out
    sinks.write_json(corpus.sample(out, a.limit, a.seed).withColumnRenamed("sid", "id"), a.out)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Label rows to repaired, valid, group-safe splits and a manifest."""
    rows = labels.repair(readers.label_rows(spark, a.input)).withColumn("group_id", F.coalesce("group_id", "id"))
    bad = labels.validate(rows).where(F.size("failed") > 0)
    if n := bad.count():
        bad.write.mode("overwrite").json(f"{a.out}/invalid")
        print(f"{n} invalid rows are in {a.out}/invalid", file=sys.stderr)
    good = labels.validate(rows).where(F.size("failed") == 0).drop("failed")
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type")))
    cases = good.select("id", "group_id", "source", "text", spans.alias("spans"))
    put = cases.join(split.by_group(cases), ["source", "group_id"]).select("id", "group_id", "source", "text", "spans", "split")
    sinks.write_splits(put, f"{a.out}/cases")
    sinks.write_json(sinks.manifest(put), f"{a.out}/manifest")


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Two sets of splits; conflicts (a text in two splits) are an error."""
    read = lambda p: spark.read.json(p).select("text", "split")
    out = split.merged(read(a.first), read(a.more))
    if out.where("conflict").limit(1).count():
        raise SystemExit("a text is in two splits")
    sinks.write_splits(out.drop("conflict"), a.out)


def _cases(spark: SparkSession, path: str, which: str) -> DataFrame:
    kind = "id string, group_id string, source string, text string, spans array<struct<start:int,end:int,type:string>>, split string"
    return spark.read.schema(kind).json(path).where(F.col("split") == which).withColumnRenamed("id", "sid")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A generic perceptron from the train split."""
    rows = _cases(spark, a.data, "train")
    cases = perceptron.training_cases(features.char_features(rows), tags.exploded(rows, typed=False))
    fit = perceptron.train_exact(cases, a.epochs, a.seed, a.min_abs) if a.exact else perceptron.train_mixed(cases, a.shards, a.epochs, a.seed, a.min_abs)
    sinks.write_weights(fit, a.out, {"epochs": a.epochs, "seed": a.seed, "min_abs": a.min_abs, "data": a.data})


def _tagged(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    w = spark.read.parquet(f"{path}/weights").withColumn("weight", F.round(F.col("weight") * 1_000_000).cast("long"))
    moves = {(r.feature[2:], r.state): r.weight for r in w.where(F.col("feature").startswith("T=")).collect()}
    em = features.emissions(features.char_features(rows), features.wide(w.where(~F.col("feature").startswith("T="))))
    return viterbi.decode(features.score_rows(em), moves)


def quality(spark: SparkSession, a: argparse.Namespace) -> None:
    """Exact-span scores of a split against a floor, and leaks between splits."""
    rows = _cases(spark, a.data, a.split)
    found = _tagged(spark, a.model, rows).select("sid", F.inline(tags.tags_to_spans(F.split("tags", ""))))
    gold = rows.select("sid", F.inline("spans")).withColumn("type", F.lit("ENTITY"))
    x = evaluate.extended(rows, gold, found)
    print(json.dumps(x.first().asDict()))
    kind = "group_id string, split string"
    leaks = split.leaks(spark.read.schema(kind).json(a.data)).count()
    if leaks or not evaluate.passed(evaluate.gates(x, [("f1", ">=", a.min_f1)])):
        raise SystemExit(f"failed: f1 below {a.min_f1}, or {leaks} groups in several splits")


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """A packed weight file and its digest."""
    w = spark.read.parquet(f"{a.model}/weights").withColumn("weight", F.round(F.col("weight") * 1_000_000).cast("long"))
    print(sinks.pack_weights(features.wide(w), a.out), sinks.write_digest(a.out))


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read a packed weight file and refuse faults."""
    n = len(sinks.unpack_weights(a.input))
    if n < a.min_features:
        raise SystemExit(f"{n} features")
    print(n)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanforge")
    sub = p.add_subparsers(required=True)

    def command(f, *options: tuple):
        c = sub.add_parser(f.__name__, help=f.__doc__)
        for name, default in options:
            kind = {"type": type(default)} if default is not None and not isinstance(default, (bool, type)) else {}
            kind = {"action": "store_true"} if isinstance(default, bool) else kind | ({"required": True} if default is str else {"default": default})
            c.add_argument(f"--{name}", **kind)
        c.set_defaults(run=f)

    command(sample, ("input", str), ("out", str), ("limit", 200), ("scan-rows", 5000), ("min-chars", 8), ("max-chars", 120), ("seed", 41), ("text-fields", ""), ("category-pattern", ""), ("resume", ""))
    command(build, ("input", str), ("out", str))
    command(merge, ("first", str), ("more", str), ("out", str))
    command(train, ("data", str), ("out", str), ("epochs", 20), ("seed", 23), ("min-abs", 0.05), ("shards", 8), ("exact", False))
    command(quality, ("model", str), ("data", str), ("split", "dev"), ("min-f1", 0.49))
    command(export, ("model", str), ("out", str))
    command(check, ("input", str), ("min-features", 1))
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("spanforge").getOrCreate(), a)


if __name__ == "__main__":
    main()
