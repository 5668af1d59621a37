"""Parquet and JSON sources and sinks, and the bronze view over a plain events table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas

#: The day of event_ts by which silver is laid out.
DAY_COLUMN = "event_day"
#: Sessions, devices, clocks and faults derived from an events table by integer arithmetic; runs in Spark and DuckDB as it stands.
BRONZE_SQL = """
e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value FROM {events}),
e1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM e),
e2 AS (SELECT *, CAST(floor(rn / 16e0) AS BIGINT) AS sidx, rn % 16 AS k FROM e1),
e3 AS (SELECT *, min(ts) OVER (PARTITION BY user_id, sidx) AS s0,
  CASE WHEN user_id % 14 = 0 THEN 3 * k WHEN user_id % 7 = 0 THEN k + CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END
       WHEN user_id % 22 = 11 THEN k ELSE 40 * k + (event_id * 7919) % 37 END
  + CASE WHEN user_id % 7 <> 0 AND sidx % 4 = 1 AND k >= 10 THEN 2400 ELSE 0 END AS off_s FROM e2),
e4 AS (SELECT *, s0 + off_s * INTERVAL '1' SECOND AS true_ts,
  CASE WHEN user_id % 7 = 0 OR user_id % 22 = 11 THEN 'page_view' WHEN event_type = 'purchase' THEN 'purchase'
       WHEN event_type = 'signup' THEN 'begin_checkout' WHEN event_type = 'click' THEN 'add_to_cart'
       WHEN event_type = 'error' THEN 'search' ELSE 'page_view' END AS event_name,
  CASE WHEN event_type IN ('view', 'click') THEN 'MG-' || CAST(event_id % 18 AS VARCHAR(20)) END AS pid FROM e3),
e5 AS (SELECT *, (user_id % 8 = 0 AND true_ts >= TIMESTAMP '2024-01-19 00:00:00') AS drifted,
  CASE WHEN user_id % 5 = 0 THEN 'plus' WHEN user_id % 5 <= 2 THEN 'basic' ELSE 'guest' END AS tier FROM e4),
e6 AS (SELECT e5.*, 0 AS copy FROM e5 UNION ALL SELECT e5.*, 1 AS copy FROM e5 WHERE event_id % 67 = 0
  UNION ALL SELECT e5.*, 2 AS copy FROM e5 WHERE event_id % 201 = 0),
bronze AS (SELECT CAST(event_id AS VARCHAR(20)) AS event_id,
  CAST(user_id AS VARCHAR(20)) || '-' || CAST(sidx AS VARCHAR(20)) AS session_id, 'v' || CAST(user_id AS VARCHAR(20)) AS visitor_id,
  CASE WHEN tier <> 'guest' THEN 'Mv' || CAST(user_id AS VARCHAR(20)) END AS member_id,
  CASE WHEN user_id % 37 = 1 THEN true_ts - 20455 * INTERVAL '1' DAY WHEN user_id % 41 = 2 THEN true_ts + 4380 * INTERVAL '1' DAY ELSE true_ts END AS event_ts,
  event_name,
  CASE event_name WHEN 'search' THEN 'search' WHEN 'begin_checkout' THEN 'checkout' WHEN 'purchase' THEN 'confirmation' ELSE 'product' END AS page_type,
  CASE WHEN NOT drifted THEN pid END AS product_id, CASE WHEN drifted THEN pid END AS item_id,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 'household' WHEN 1 THEN 'pantry' WHEN 2 THEN 'fresh' WHEN 3 THEN 'electronics' WHEN 4 THEN 'outdoor' ELSE 'pharmacy' END END AS category,
  CASE WHEN event_name = 'search' THEN 'tp' END AS search_term,
  CASE user_id % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'desktop' WHEN 2 THEN 'mobile_web' ELSE 'tablet' END AS device,
  tier AS membership_tier, CASE WHEN drifted THEN '2.4.0' ELSE '2.3.0' END AS app_version, CASE WHEN drifted THEN '2.4.0' ELSE '2.3.0' END AS schema_version,
  CASE WHEN event_name = 'purchase' THEN 'MO-' || CAST(event_id AS VARCHAR(20)) END AS order_id, CASE WHEN event_name = 'purchase' THEN value END AS order_total,
  true_ts + (1 + event_id % 4) * INTERVAL '1' SECOND + CASE WHEN user_id % 4 = 0 AND sidx % 3 = 0 AND k >= 8 THEN 1 + (user_id * 13 + sidx * 7) % 80 ELSE 0 END * INTERVAL '1' HOUR
    + copy * (1 + event_id % 240) * INTERVAL '1' SECOND AS ingested_at,
  true_ts AS _true_ts, user_id % 7 = 0 AS _is_bot, copy > 0 AS _is_duplicate FROM e6)
"""


def bronze_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bronze table derived from an events table."""
    return spark.sql("WITH " + BRONZE_SQL + " SELECT * FROM bronze", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """A bronze table by its schema; columns that a file lacks are null."""
    return spark.read.schema(schemas.BRONZE).parquet(path)


def write_bronze(df: DataFrame, path: str) -> None:
    """Rows in ranges of their arrival, so that a reader can skip files by it; no order over all of them."""
    df.repartitionByRange("ingested_at").sortWithinPartitions("ingested_at").write.mode("overwrite").parquet(path)


def write_silver(df: DataFrame, path: str) -> None:
    """Silver by day; the semantic layer filters event_day beside event_ts, so a range of days reads its folders alone."""
    days = df.withColumn(DAY_COLUMN, F.to_date("event_date"))
    # a day's rows meet in few tasks, else every task writes a file for every day; large days are split
    days.hint("rebalance", DAY_COLUMN).write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Written also when empty, so that no older file stays."""
    df.write.mode("overwrite").parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document, by Spark's file systems."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document; {} where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def modified(spark: SparkSession, path: str) -> str | None:
    """When a file or folder was last written, in UTC."""
    from datetime import datetime, timezone

    fs, p = _file(spark, path)
    return datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() / 1000, timezone.utc).isoformat() if fs.exists(p) else None
