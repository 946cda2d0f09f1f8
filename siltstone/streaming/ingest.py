"""Continuous ingest with Structured Streaming: new files of a folder become versions of a table, and rolling churn. [INC-1, INC-5]"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, *, transform: Callable[[DataFrame], DataFrame] = lambda d: d, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Append ``transform`` of every new file of ``source`` to the Parquet table ``target``, each file exactly once."""
    rows = transform(spark.readStream.format(fmt).schema(schema).load(source))
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rolling_churn(events: DataFrame, *, ts: str, key: str, value: str, window: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sum of ``value`` per key over sliding windows; events later than ``late`` behind the newest are dropped by the watermark."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), F.col(key))
    return grouped.agg(F.sum(value).alias("churn")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "churn")


def latest_by_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For ``foreachBatch``: one row a key, the newest."""
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row"))
    return newest.select("row.*")
