"""Streams of papers and of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.store import Table


def deduplicated(papers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of papers (at least doi, source, source_id, seen_at) with one row an id within the watermark."""
    keyed = papers.withColumn("id", T.paper_id(T.normalize_doi(F.col("doi")), F.col("source"), F.col("source_id")))
    return keyed.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["id"])


def upserting(stream: DataFrame, table: Table, checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch goes into the keyed table."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.put(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def request_counts(requests: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests by window and type. requests: ts, event_type."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
