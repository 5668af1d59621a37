"""Evaluation of silver against ground truth and against time. May read truth columns; the pipeline never imports it."""

from __future__ import annotations

import inspect
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def bot_scorecard(silver: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn by session, precision, recall, f1 (0 where undefined)."""
    flag = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    s = silver.groupBy("session_id").agg(flag("is_suspected_bot", "p"), flag("_is_bot", "t"))
    p, t = F.col("p"), F.col("t")
    cells = {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}
    out = s.agg(*(F.count_if(c).alias(n) for n, c in cells.items()))
    tp, precision, recall = F.col("tp"), F.col("precision"), F.col("recall")
    out = out.withColumns({"precision": _ratio(tp, tp + F.col("fp")), "recall": _ratio(tp, tp + F.col("fn"))})
    return out.withColumn("f1", _ratio(2 * precision * recall, precision + recall))


def scorecard_text(score: dict) -> str:
    """The scorecard in words; an f1 over 0.75 is good."""
    head = f"sessions caught {score['tp']}, wrongly flagged {score['fp']}, missed {score['fn']}, left alone {score['tn']}"
    verdict = "good enough to filter by default" if score["f1"] > 0.75 else "tune it before anyone filters by it"
    return f"{head}\nprecision {score['precision']:.3f}, recall {score['recall']:.3f}, F1 {score['f1']:.3f}: {verdict}"


def restatement(silver: DataFrame, report_hour: int = 6, min_sessions: int = 50, last_days: int | None = 8) -> DataFrame:
    """Per day what a report at report_hour the next morning saw, and what the day came to. One pass, no join.

    Purchases per session here count purchase events over all sessions, bots
    and late rows included; it is neither of the governed conversion rates.
    """
    early = F.coalesce(F.col("ingested_at") <= F.col("event_date") + F.expr("interval 1 day") + F.make_dt_interval(F.lit(0), F.lit(report_hour)), F.lit(False))
    bought = F.col("event_name") == "purchase"
    out = silver.filter("event_date is not null").groupBy(F.to_date("event_date").alias("day")).agg(
        F.count_if(early).alias("events_early"),
        F.count(F.lit(1)).alias("events_final"),
        F.count_distinct(F.when(early, F.col("derived_session_id"))).alias("sessions_early"),
        F.count_distinct("derived_session_id").alias("sessions_final"),
        F.count_if(early & bought).alias("purchases_early"),
        F.count_if(bought).alias("purchases_final"),
    )
    out = out.filter(F.col("sessions_final") > min_sessions)
    rate = lambda x: F.col(f"purchases_{x}") / F.greatest(F.col(f"sessions_{x}"), F.lit(1))
    out = out.withColumns({"conv_early": rate("early"), "conv_final": rate("final")})
    before, after = F.col("conv_early"), F.col("conv_final")
    out = out.withColumn("conv_moved", (after - before) / F.when(before == 0, 1.0).otherwise(before))
    return out if last_days is None else out.orderBy(F.desc("day")).limit(last_days)


def restatement_text(rows: list[dict]) -> str:
    """A line for each day: what was reported early and what the day came to."""

    def line(r: dict) -> str:
        counts = [f"{name} {r[f'{name}_early']} -> {r[f'{name}_final']}" for name in ("sessions", "purchases")]
        return "  ".join([f"{r['day']:%a %m-%d}", *counts, f"{r['conv_early']:.2%} -> {r['conv_final']:.2%}", f"{r['conv_moved']:+.2%}"])

    return "\n".join(line(r) for r in sorted(rows, key=lambda r: r["day"]))


def summary(events: DataFrame) -> DataFrame:
    """One row about a bronze table: sizes, faults, bot shares, lag percentiles and span."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in events.columns else F.lit(0).cast("long")
    lag = (F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6
    out = events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("visitor_id").alias("visitors"),
        F.count_if(F.col("event_name") == "purchase").alias("purchases"),
        flag("_is_duplicate").alias("duplicates"),
        flag("_was_buffered").alias("buffered"),
        flag("_drifted").alias("drifted"),
        flag("_bot_spoofed").alias("spoofed"),
        F.count_distinct(F.when(F.col("_is_bot"), F.col("session_id"))).alias("bot_sessions"),
        F.count_if("_is_bot").alias("bot_events"),
        F.percentile(lag, F.lit(0.5)).alias("lag_p50"),
        F.percentile(lag, F.lit(0.95)).alias("lag_p95"),
        F.max(lag).alias("lag_max"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )
    return out.withColumns({"bot_share_sessions": _ratio(F.col("bot_sessions"), F.col("sessions")), "bot_share_events": _ratio(F.col("bot_events"), F.col("rows"))})


def lag_histogram(events: DataFrame, edges: int = 70, low: float = 0.05) -> DataFrame:
    """bin, buffered, rows over logarithmic bins of the arrival lag, from low to the largest lag (10 s at least)."""
    lag = F.greatest(F.lit(low), (F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6)
    buffered = F.coalesce(F.col("_was_buffered"), F.lit(False)) if "_was_buffered" in events.columns else F.lit(False)
    rows = events.select(lag.alias("lag"), buffered.alias("buffered")).filter("lag is not null")
    top = rows.agg(F.greatest(F.max("lag"), F.lit(10.0)).alias("top"))
    share = F.ln(F.col("lag") / low) / F.ln(F.col("top") / low)
    bin_ = F.least(F.lit(edges - 2), F.floor(F.round(share, 9) * (edges - 1)))
    return rows.crossJoin(F.broadcast(top)).groupBy(bin_.alias("bin"), "buffered").agg(F.count(F.lit(1)).alias("rows"))


def lag_facts(events: DataFrame, late_hours: float = 1.0) -> DataFrame:
    lag = (F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6
    return events.agg(F.count_if(lag > late_hours * 3600).alias("late"), F.max(lag).alias("lag_max"), F.median(lag).alias("lag_median"))


def traffic_by_hour(events: DataFrame) -> DataFrame:
    """hour, sessions, is_peak; rows with an absurd year are left out."""
    real = events.filter("event_ts > timestamp '2020-01-01 00:00:00' and event_ts < timestamp '2030-01-01 00:00:00'")
    out = real.groupBy(F.hour("event_ts").alias("hour")).agg(F.count_distinct("session_id").alias("sessions"))
    peak = out.agg(F.max_by("hour", F.struct("sessions", -F.col("hour"))).alias("peak"))
    return out.crossJoin(F.broadcast(peak)).select("hour", "sessions", (F.col("hour") == F.col("peak")).alias("is_peak"))  # one row


def bot_share(events: DataFrame) -> DataFrame:
    s = events.groupBy("session_id").agg(F.bool_or("_is_bot").alias("bot"), F.count(F.lit(1)).alias("n"))
    return s.agg((F.count_if("bot") / F.count(F.lit(1))).alias("share_sessions"), (F.sum(F.when(F.col("bot"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share_events"))


def dwell_overlap(silver: DataFrame, min_depth: int = 8, edges: int = 62, low: float = 0.03, high: float = 200.0) -> DataFrame:
    """bin, is_bot, sessions over logarithmic bins of the median gap of sessions of min_depth events or more."""
    from pyspark.sql import Window

    gap = (F.unix_micros("event_ts") - F.lag(F.unix_micros("event_ts")).over(Window.partitionBy("session_id").orderBy("event_ts"))) / 1e6
    s = silver.withColumn("_gap", gap).groupBy("session_id").agg(F.median("_gap").alias("m"), F.count(F.lit(1)).alias("depth"), F.bool_or("_is_bot").alias("is_bot"))
    share = F.ln(F.greatest(F.col("m"), F.lit(low)) / low) / F.ln(F.lit(high / low))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(edges - 2), F.floor(F.round(share, 9) * (edges - 1))))
    return s.filter((F.col("depth") >= min_depth) & F.col("m").isNotNull()).groupBy(bin_.alias("bin"), "is_bot").agg(F.count(F.lit(1)).alias("sessions"))


def truth_free(pipeline, bronze: DataFrame, truth: tuple[str, ...], judged: tuple[str, ...]) -> bool:
    """Whether a pipeline's judgments are the same when the truth columns are taken away."""
    a = pipeline(bronze).select("event_id", *judged)
    b = pipeline(bronze.drop(*truth)).select("event_id", *judged)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def truth_in_source(module, truth: tuple[str, ...]) -> list[str]:
    """The truth columns that a module's source names; a pipeline module must name none."""
    words = set(re.findall(r"\w+", inspect.getsource(module)))
    return [c for c in truth if c in words]
