"""The steps that a stream can do: flags row by row, repeated deliveries within a watermark, sessions by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import silver

#: A stream's watermark starts at 1970 and rows before it are late from the first batch on; event times are moved up by 400 years (whole days) while windows form.
_MOVE = 146_097 * 86_400_000_000


def _moved(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("_moved_ts", F.timestamp_micros(F.unix_micros("event_ts") + _MOVE)).withWatermark("_moved_ts", watermark)


def _back(col: str) -> Column:
    return F.timestamp_micros(F.unix_micros(col) - _MOVE)


def flagged(events: DataFrame, lateness_hours: float = silver.LATENESS_HOURS) -> DataFrame:
    """Quarantine reason, sku and lateness; stateless, the same as in batch."""
    return silver.apply_watermark(silver.resolve_drift(silver.with_quarantine_reason(events)), lateness_hours)


def first_delivery(events: DataFrame, within: str = "5 days") -> DataFrame:
    """One row per event_id: the first that the stream processed, which needn't be the first ingested. Use `merge_first` for that."""
    return events.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(["event_id"])


def merge_first(batch: DataFrame, path: str) -> None:
    """For foreachBatch: append a batch's first arrivals; `read_first` gives the earliest of all batches, as in batch."""
    silver.deduplicate(batch).write.mode("append").parquet(path)


def read_first(spark, path: str) -> DataFrame:
    return silver.deduplicate(spark.read.parquet(path))


def session_windows(events: DataFrame, gap: str = "30 minutes", watermark: str = "3 days") -> DataFrame:
    """visitor_id, session_start, session_end, events: the same boundaries as the batch rule of a gap over the timeout."""
    out = _moved(events, watermark).groupBy("visitor_id", F.session_window("_moved_ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return out.select("visitor_id", _back("session_window.start").alias("session_start"), _back("session_window.end").alias("session_end"), "events")


def daily_visitors(events: DataFrame, watermark: str = "3 days") -> DataFrame:
    """Approximate distinct visitors by day; exact ones need batch."""
    out = _moved(events, watermark).groupBy(F.window("_moved_ts", "1 day")).agg(F.approx_count_distinct("visitor_id").alias("visitors"), F.count(F.lit(1)).alias("events"))
    return out.select(F.struct(_back("window.start").alias("start"), _back("window.end").alias("end")).alias("window"), "visitors", "events")
