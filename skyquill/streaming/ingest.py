"""Streams into versioned tables, windowed aggregates, and polling syncs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyquill.sources.companion import sync
from skyquill.sources.fs import FileSystem
from skyquill.sources.table import Table


def write_stream(stream: DataFrame, path: str, checkpoint: str, name: str, partition_by: list[str] | None = None, available_now: bool = True, interval: str | None = None, **options) -> StreamingQuery:
    """Appends each batch once: the log keeps the last batch number of ``name``, so a replayed batch is not written again."""

    def each(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path).write(batch, "append", partition_by=partition_by, txn=(name, number), **options)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval or "10 seconds")
    return writer.start()


def windowed(stream: DataFrame, time_column: str, width: str, *aggregates, slide: str | None = None, keys: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows with a watermark; works on streams and tables."""
    df = stream.withWatermark(time_column, late) if stream.isStreaming else stream
    return df.groupBy(F.window(time_column, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), *aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *[F.col(a._jc.toString().split(" AS ")[-1]) for a in aggregates])


def sessions(stream: DataFrame, time_column: str, gap: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    df = stream.withWatermark(time_column, late) if stream.isStreaming else stream
    return df.groupBy(F.session_window(time_column, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def poll_sync(spark: SparkSession, source: str, index: str, modes: dict[str, str], interval_seconds: float = 60, rounds: int | None = None, max_errors: int = 10, **options) -> list[dict]:
    """Syncs again whenever the source's listing changed. Pauses double with each error in a row, up to ``max_errors``."""
    last, errors, out, n = None, 0, [], 0
    while rounds is None or n < rounds:
        n += 1
        try:
            probe = hash(tuple(FileSystem(spark, source).files()))
            if probe != last:
                out.append(sync(spark, source, index, modes, **options))
                last = probe
            errors = 0
        except Exception:
            errors += 1
            if errors >= max_errors:
                raise
        if rounds is None or n < rounds:
            time.sleep(interval_seconds * 2**errors)
    return out
