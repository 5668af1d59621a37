"""From bronze to silver: quarantine, first arrival, drift, bots, sessions, lateness. Judgment columns never read ground truth."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.sources import tables

#: The shop's launch, how far a client's clock may be ahead, and the bot rule's bounds.
LAUNCH, AHEAD = "2019-01-01 00:00:00", "6 hours"
FAST_MEDIAN, FAST_DEPTH, EVEN_STDEV, EVEN_DEPTH, MISSING = 1.6, 10, 0.9, 14, 999.0
TIMEOUT_MINUTES, LATENESS_HOURS = 30, 72.0
#: Parts over which rows without a session or a visitor are spread.
LOOSE = 4096


@dataclass
class Manifest:
    """What each step did to a run; one record per run."""

    rows_in: int = 0
    rows_out: int = 0
    quarantined_timestamps: int = 0
    duplicates_removed: int = 0
    drifted_rows_recovered: int = 0
    bot_events_flagged: int = 0
    bot_sessions_flagged: int = 0
    sessions_derived: int = 0
    events_after_watermark: int = 0
    notes: list[str] = field(default_factory=list)

    def rate(self, n: int) -> float:
        return n / self.rows_in if self.rows_in else 0.0

    def as_dict(self) -> dict:
        return asdict(self)


def _before() -> Column:
    return F.col("event_ts") < F.lit(LAUNCH).cast("timestamp")


def _after() -> Column:
    return F.col("event_ts") > F.col("ingested_at") + F.expr(f"interval {AHEAD}")


def with_quarantine_reason(df: DataFrame) -> DataFrame:
    """quarantine_reason: before_launch, future_dated or null. A row without a time is clean."""
    return df.withColumn("quarantine_reason", F.when(_before(), "before_launch").when(_after(), "future_dated"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined); nothing is lost. Both read df, so cache it where both are used."""
    judged = with_quarantine_reason(df)
    return judged.filter("quarantine_reason is null").drop("quarantine_reason"), judged.filter("quarantine_reason is not null")


def deduplicate(df: DataFrame) -> DataFrame:
    """The row of each event_id that came first; rows without an id count as one. Ties by the other columns.

    One shuffle, of rows that are already the first of their part: a repeated
    or missing id is no task's burden.
    """
    rest = sorted(set(df.columns) - {"event_id", "ingested_at"})
    first = F.min(F.struct(F.col("ingested_at").isNull().alias("none"), F.col("ingested_at"), *rest)).alias("first")
    fields = [F.col("event_id") if c == "event_id" else F.col("first")[c].alias(c) for c in df.columns]
    return df.groupBy("event_id").agg(first).select(*fields)


def resolve_drift(df: DataFrame) -> DataFrame:
    """sku from whichever of the two names a row uses; item_id is added where the table lacks it."""
    if "item_id" not in df.columns:
        df = df.withColumn("item_id", F.lit(None).cast("string"))
    return df.withColumn("sku", F.coalesce("product_id", "item_id"))


def rescued() -> Column:
    return F.col("product_id").isNull() & F.col("item_id").isNotNull()


def _suspect(median: Column, stdev: Column, depth: Column, carted: Column) -> Column:
    fast = (median < FAST_MEDIAN) & (depth >= FAST_DEPTH)
    even = (stdev < EVEN_STDEV) & (depth >= EVEN_DEPTH)
    return (fast | even) & ~carted


def _carted() -> Column:
    return F.coalesce(F.bool_or(F.col("event_name").isin("add_to_cart", "purchase")), F.lit(False))


def _gap(session: WindowSpec) -> Column:
    return (F.unix_micros("event_ts") - F.lag(F.unix_micros("event_ts")).over(session.orderBy("event_ts"))) / 1e6


def _own(key: str) -> Column:
    """The key; rows that lack it get one of many parts instead, as none of them needs another."""
    return F.coalesce(F.col(key), F.concat(F.lit("\0"), F.pmod(F.xxhash64("event_id", "event_ts"), F.lit(LOOSE)).cast("string")))


def bot_features(df: DataFrame) -> DataFrame:
    """One row per session: median_gap, gap_stdev (seconds; 999 where undefined), depth, carted, suspect. One shuffle."""
    out = df.filter("session_id is not null").withColumn("_gap", _gap(Window.partitionBy("session_id"))).groupBy("session_id").agg(
        F.coalesce(F.median("_gap"), F.lit(MISSING)).alias("median_gap"),
        F.coalesce(F.stddev_samp("_gap"), F.lit(MISSING)).alias("gap_stdev"),
        F.count(F.lit(1)).alias("depth"),
        _carted().alias("carted"),
    )
    return out.withColumn("suspect", _suspect(*map(F.col, ("median_gap", "gap_stdev", "depth", "carted"))))


def classify_bots(df: DataFrame) -> DataFrame:
    """is_suspected_bot of the row's session; false without a session. One shuffle and no join: the features are windows over the session."""
    session = Window.partitionBy("_session")
    out = df.withColumn("_session", _own("session_id")).withColumn("_gap", _gap(session))
    median, stdev = (F.coalesce(x, F.lit(MISSING)) for x in (F.median("_gap").over(session), F.stddev_samp("_gap").over(session)))
    carted = F.coalesce(F.bool_or(F.col("event_name").isin("add_to_cart", "purchase")).over(session), F.lit(False))
    flags = out.withColumns({"_median": median, "_stdev": stdev, "_depth": F.count(F.lit(1)).over(session), "_carted": carted})
    suspect = F.col("session_id").isNotNull() & _suspect(*map(F.col, ("_median", "_stdev", "_depth", "_carted")))
    return flags.withColumn("is_suspected_bot", suspect).select(*df.columns, "is_suspected_bot")


def sessionize(df: DataFrame, timeout_minutes: float = TIMEOUT_MINUTES) -> DataFrame:
    """derived_session_id: visitor and start second of a run of events without a gap over the timeout; null without a visitor. One shuffle."""
    order = Window.partitionBy("_visitor").orderBy("event_ts", "event_id")
    before = F.lag("event_ts").over(order)
    new = before.isNull() | (F.unix_micros("event_ts") - F.unix_micros(before) > int(timeout_minutes * 60_000_000))
    start = F.last(F.when(F.col("_new"), F.col("event_ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_visitor", _own("visitor_id")).withColumn("_new", new).withColumn("_start", start)
    name = F.concat(F.col("visitor_id"), F.lit(":"), F.unix_seconds("_start").cast("string"))
    return out.withColumn("derived_session_id", F.when(F.col("visitor_id").isNotNull(), name)).drop("_visitor", "_new", "_start")


def apply_watermark(df: DataFrame, lateness_hours: float = LATENESS_HOURS) -> DataFrame:
    """event_date, lateness and arrived_after_watermark; a flag, every row stays."""
    micros = F.unix_micros("ingested_at") - F.unix_micros("event_ts")
    late = micros > int(lateness_hours * 3_600_000_000)
    return df.withColumns({
        "event_date": F.date_trunc("day", "event_ts"),
        "lateness": F.col("ingested_at") - F.col("event_ts"),
        "lateness_seconds": micros / 1e6,
        "arrived_after_watermark": F.coalesce(late, F.lit(False)),
    })


def to_silver(clean: DataFrame, timeout_minutes: float = TIMEOUT_MINUTES, lateness_hours: float = LATENESS_HOURS) -> DataFrame:
    """All judgments on rows that passed quarantine."""
    return apply_watermark(sessionize(classify_bots(resolve_drift(deduplicate(clean))), timeout_minutes), lateness_hours)


def _counters() -> list[Column]:
    """The manifest's counters over silver."""
    return [
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(rescued()).alias("drifted_rows_recovered"),
        F.count_if("is_suspected_bot").alias("bot_events_flagged"),
        F.count_distinct(F.when(F.col("is_suspected_bot"), F.col("session_id"))).alias("bot_sessions_flagged"),
        F.count_distinct("derived_session_id").alias("sessions_derived"),
        F.count_if("arrived_after_watermark").alias("events_after_watermark"),
    ]


def manifest_counts(bronze: DataFrame, timeout_minutes: float = TIMEOUT_MINUTES, lateness_hours: float = LATENESS_HOURS) -> DataFrame:
    """The manifest's counters in one row."""
    judged = with_quarantine_reason(bronze)
    head = judged.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("quarantine_reason").isNotNull()).alias("quarantined_timestamps"))
    silver = to_silver(judged.filter("quarantine_reason is null").drop("quarantine_reason"), timeout_minutes, lateness_hours)
    tail = silver.agg(*_counters())
    return head.crossJoin(tail).withColumn("duplicates_removed", F.col("rows_in") - F.col("quarantined_timestamps") - F.col("rows_out"))


def _notes(m: Manifest, silver: DataFrame, quarantined: DataFrame, client_sessions: int, timeout_minutes: float, lateness_hours: float) -> list[str]:
    """What the steps found, in words; reads only rows that a step has marked."""
    both = quarantined.agg(F.count_if(_before()), F.count_if(_after())).first()
    clean = m.rows_in - m.quarantined_timestamps
    notes = [
        f"{both[0]} events before launch and {both[1]} dated past their arrival were quarantined",
        f"{m.duplicates_removed} repeated deliveries removed ({m.duplicates_removed / clean if clean else 0:.2%} of clean rows)",
    ]
    if m.drifted_rows_recovered:
        d = silver.filter(rescued()).agg(F.sort_array(F.collect_set("app_version")), F.min("event_ts")).first()
        notes.append(f"{m.drifted_rows_recovered} rows named the product item_id, in versions {', '.join(d[0])} since {d[1]}")
    moved = f"{m.sessions_derived / client_sessions - 1:+.1%}" if client_sessions else "no client sessions"
    notes.append(f"{m.sessions_derived} sessions derived with a timeout of {timeout_minutes:g} minutes; clients named {client_sessions} ({moved}), by another definition")
    if m.events_after_watermark:
        days = silver.filter("arrived_after_watermark").groupBy(F.to_date("event_date").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
        by_day = ", ".join(f"{r.day} {r.n}" for r in days)
        notes.append(f"{m.events_after_watermark} events came more than {lateness_hours:g} hours late; they are flagged and left out of closed days by default: {by_day}")
    return notes


def run_pipeline(bronze: DataFrame, timeout_minutes: float = TIMEOUT_MINUTES, lateness_hours: float = LATENESS_HOURS) -> tuple[DataFrame, DataFrame, Manifest]:
    """(silver, quarantined, manifest with notes) without writing anything: the manifest and each frame run the plan. `write_pipeline` runs it once."""
    clean, bad = quarantine(bronze)
    silver = to_silver(clean, timeout_minutes, lateness_hours)
    m = Manifest(**manifest_counts(bronze, timeout_minutes, lateness_hours).first().asDict())
    client = silver.agg(F.count_distinct("session_id")).first()[0]
    m.notes = _notes(m, silver, bad, client, timeout_minutes, lateness_hours)
    return silver, bad, m


def write_pipeline(
    bronze: DataFrame, silver_path: str, quarantine_path: str, timeout_minutes: float = TIMEOUT_MINUTES, lateness_hours: float = LATENESS_HOURS
) -> tuple[DataFrame, DataFrame, Manifest]:
    """(silver, quarantined, manifest with notes), both frames read from the tables that this writes.

    The judgments run once, in the write of silver; all counters are then
    counted on the few columns of the written tables that they need. (Counts
    observed in passing would count a lost executor's rows twice.)
    """
    spark = bronze.sparkSession
    clean, bad = quarantine(bronze)
    tables.write_quarantine(bad, quarantine_path)
    tables.write_silver(to_silver(clean, timeout_minutes, lateness_hours), silver_path)
    silver, bad = spark.read.parquet(silver_path), spark.read.parquet(quarantine_path)
    row = silver.agg(*_counters(), F.count_distinct("session_id").alias("client")).first().asDict()
    client = row.pop("client")
    m = Manifest(rows_in=bronze.count(), quarantined_timestamps=bad.count(), **row)
    m.duplicates_removed = m.rows_in - m.quarantined_timestamps - m.rows_out
    m.notes = _notes(m, silver, bad, client, timeout_minutes, lateness_hours)
    return silver, bad, m
