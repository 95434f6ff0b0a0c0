"""Streams of texts: incremental annotation and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators import corpus, labels


def annotate_stream(texts: DataFrame, annotator, out_dir: str, checkpoint: str, batch: int = 8, retries: int = 2) -> StreamingQuery:
    """Annotate each new id once: a micro-batch is held against what is written, then appended.

    A batch that is replayed after a failure finds its ids done, so results
    are written once. `texts` is a streaming frame (id, text).
    """

    def step(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(["id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = corpus.pending(fresh, spark.read.schema("id string").parquet(out_dir), "id")
        labels.annotate(fresh, annotator, batch, retries).write.mode("append").parquet(out_dir)

    return texts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidates_stream(texts: DataFrame, function: str):
    """Candidates of a streaming frame (id, text) by a registered table function."""
    texts.createOrReplaceTempView("_stream_texts")
    return texts.sparkSession.sql(f"select t.id, c.* from _stream_texts t, lateral {function}(t.text) c")
