"""Optional: the stateless metrics over a stream, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.operators import metrics as M
from quaestor.sources.jsonl import parse


def read_items(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream over a folder of JSON-lines files; malformed lines are skipped."""
    return parse(spark.readStream.format("text").load(folder), schema)


def evaluate(items: DataFrame, key: str = "q_id", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """Long metric rows per micro-batch. All of these metrics look at one row only, so there is no state."""
    return M.evaluate(items, key, names, text)


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` behind the newest are dropped by the watermark."""
    x = events.withWatermark(ts, late).groupBy(F.window(ts, size), kind)
    return x.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
