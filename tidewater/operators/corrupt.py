"""Delivery and client faults, put into clean events on purpose; each is a narrow function of seed and ids unless it says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.uniform import between, normal, pick, seconds, uniform
from tidewater.sources.world import DEVICES, DRIFTED_VERSION


@dataclass(frozen=True)
class Chaos:
    """How much of each fault; a rate of 0 leaves it out (for drift: the adoption rate). The defaults are fixed values."""

    duplicate_rate: float = 0.015
    lag_low: float = 0.4
    lag_high: float = 12.0
    skewed_device_rate: float = 0.06
    absurd_clock_rate: float = 0.004
    spoof_rate: float = 0.75
    offline_rate: float = 0.10
    flush_hours: tuple[float, float] = (1.0, 80.0)
    drop_rate: float = 0.018
    trailing_drop_rate: float = 0.055
    drift_at: float = 0.62
    drift_adoption: float = 0.55
    seed: int = 4242


def skew_clocks(df: DataFrame, c: Chaos) -> DataFrame:
    """Keep the true time and shift event_ts by an offset of the visitor: absurd, a normal number of minutes, or none."""
    u = lambda salt: uniform(c.seed, salt, F.col("visitor_id"))
    days = pick(u("absurd"), {"-20455": 1, "-3650": 1, "4380": 1}).cast("double") * 86400
    offset = F.when(u("skew") < c.absurd_clock_rate, days).when(u("skew") < c.skewed_device_rate, F.round(normal(u("skew-a"), u("skew-b")) * 240, 3)).otherwise(0.0)
    return df.withColumn("_true_ts", F.col("event_ts")).withColumn("event_ts", F.timestamp_micros(F.unix_micros("event_ts") + F.round(offset * 1e6).cast("long")))


def drift_schema(df: DataFrame, c: Chaos) -> DataFrame:
    """After a part of the time span, some visitors' app sends item_id instead of product_id. One small aggregate."""
    lo, hi = F.unix_micros("lo"), F.unix_micros("hi")
    span = df.agg(F.min("_true_ts").alias("lo"), F.max("_true_ts").alias("hi"))
    span = span.select(F.timestamp_micros((lo + (hi - lo) * F.lit(c.drift_at)).cast("long")).alias("_cut"))
    adopts = uniform(c.seed, "drift", F.col("visitor_id")) < c.drift_adoption
    hit = F.coalesce((F.col("device") == "app") & (F.col("_true_ts") >= F.col("_cut")) & adopts, F.lit(False))
    out = df.crossJoin(F.broadcast(span)).withColumn("_hit", hit)  # one row
    new = lambda col: F.when(F.col("_hit"), F.lit(DRIFTED_VERSION)).otherwise(F.col(col))
    return out.withColumns({
        "item_id": F.when(F.col("_hit"), F.col("product_id")),
        "product_id": F.when(~F.col("_hit"), F.col("product_id")),
        "app_version": new("app_version"),
        "schema_version": new("schema_version"),
        "_drifted": F.when(F.col("_hit"), True),
    }).drop("_hit", "_cut")


def spoof_bots(df: DataFrame, c: Chaos) -> DataFrame:
    """Some bot sessions pose as people: a device drawn for each event, tier guest."""
    hit = F.coalesce(F.col("_is_bot") & (uniform(c.seed, "spoof", F.col("session_id")) < c.spoof_rate), F.lit(False))
    device = pick(uniform(c.seed, "spoof-device", F.col("event_id")), {"desktop": 0.8, "mobile_web": 0.2})
    return df.withColumns({
        "device": F.when(hit, device).otherwise(F.col("device")),
        "membership_tier": F.when(hit, "guest").otherwise(F.col("membership_tier")),
        "_bot_spoofed": F.when(hit, True),
    })


def stamp_ingestion(df: DataFrame, c: Chaos) -> DataFrame:
    """The server's clock: true time plus a long-tailed lag."""
    lag = F.least(F.lit(c.lag_high), c.lag_low * F.pow(1 / F.greatest(uniform(c.seed, "lag", F.col("event_id")), F.lit(0.02)), F.lit(0.55)))
    return df.withColumn("ingested_at", F.col("_true_ts") + seconds(lag))


def buffer_offline(df: DataFrame, c: Chaos) -> DataFrame:
    """The tails of some sessions that began on a buffering device come hours later, all by one delay. Shuffles by session."""
    able = [k for k, v in DEVICES.items() if v[2]]
    s = Window.partitionBy("session_id").orderBy("_true_ts", "event_id")
    every = Window.partitionBy("session_id")
    u = lambda salt: uniform(c.seed, salt, F.col("session_id"))
    out = df.withColumns({"_k": F.row_number().over(s) - 1, "_n": F.count(F.lit(1)).over(every), "_d": F.first("device").over(s)})
    cut = 1 + F.floor(u("cut") * (F.col("_n") - 1))
    hit = F.coalesce(F.col("_d").isin(able) & (F.col("_n") >= 3) & (u("offline") < c.offline_rate) & (F.col("_k") >= cut), F.lit(False))
    late = F.col("ingested_at") + seconds(between(u("flush"), *c.flush_hours) * 3600)
    return out.withColumns({"ingested_at": F.when(hit, late).otherwise(F.col("ingested_at")), "_was_buffered": F.when(hit, True)}).drop("_k", "_n", "_d")


def deliver_at_least_once(df: DataFrame, c: Chaos) -> DataFrame:
    """A geometric number of copies, with the same event_id and a later ingested_at."""
    copies = F.floor(F.ln(F.greatest(uniform(c.seed, "copies", F.col("event_id")), F.lit(2.0**-33))) / F.ln(F.lit(c.duplicate_rate))).cast("int") if c.duplicate_rate > 0 else F.lit(0)
    out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies)))
    again = F.col("ingested_at") + seconds(between(uniform(c.seed, "again", F.col("event_id"), F.col("_copy")), 0.2, 240.0))
    return out.withColumns({"ingested_at": F.when(F.col("_copy") > 0, again).otherwise(F.col("ingested_at")), "_is_duplicate": F.when(F.col("_copy") > 0, True)})


def with_drops(df: DataFrame, c: Chaos) -> DataFrame:
    """df with _lost: rows whose beacon never came, most often a session's last. Shuffles by session."""
    copy = F.col("_copy") if "_copy" in df.columns else F.lit(0)
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_true_ts"), F.desc("event_id"), F.desc(copy))) == 1
    return df.withColumn("_lost", uniform(c.seed, "drop", F.col("event_id"), copy) < F.when(last, c.trailing_drop_rate).otherwise(c.drop_rate))


def drop_beacons(df: DataFrame, c: Chaos) -> DataFrame:
    return with_drops(df, c).filter("not _lost").drop("_lost")


def loss_ledger(df: DataFrame, c: Chaos) -> DataFrame:
    """One row: dropped, dropped_purchases, kept."""
    lost = F.col("_lost")
    return with_drops(df, c).agg(F.count_if(lost).alias("dropped"), F.count_if(lost & (F.col("event_name") == "purchase")).alias("dropped_purchases"), F.count_if(~lost).alias("kept"))


def corrupt(df: DataFrame, c: Chaos = Chaos()) -> DataFrame:
    """All faults in their order: clocks, drift, spoofing, stamping, buffering, duplicates, losses."""
    for step in (skew_clocks, drift_schema, spoof_bots, stamp_ingestion, buffer_offline, deliver_at_least_once, drop_beacons):
        df = step(df, c)
    return df.drop("_copy")
