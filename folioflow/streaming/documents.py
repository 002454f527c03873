"""Documents as a stream of files: each micro-batch goes through the same plan as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folioflow.functions.backends import BACKENDS
from folioflow.plans.translate import translate_segments
from folioflow.sources import files


def translate_stream(spark: SparkSession, path: str, out: str, checkpoint: str, backend: str = "echo") -> StreamingQuery:
    """Translates the segments of new files and appends them under ``out``; the structure of Markdown and HTML is checked as in a batch.

    Order within a document needs windows, which streams don't have; a document is whole in its micro-batch, so the batch plan
    holds. A batch that is run again overwrites its own folder, which makes the sink exactly-once.
    """

    def batch(df: DataFrame, number: int) -> None:
        found = files.segments(df)
        done = translate_segments(found, ["path", "document_format", "seg_no", "type"], BACKENDS[backend], form="document_format")
        done.withColumn("errors", F.array_join("errors", "; ")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(segments: DataFrame) -> DataFrame:
    """Segments per document so far, for an update-mode sink."""
    return segments.groupBy("path").agg(F.count(F.lit(1)).alias("segments"))
