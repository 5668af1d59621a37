"""One query for each operator on events, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.uniform import uniform
from tidewater.operators import corrupt as C
from tidewater.operators import quality as Q
from tidewater.operators import silver as S
from tidewater.plans.semantic import Engine, MetricSpec, compile_spec, load_layer
from tidewater.sources.generate import generate_events
from tidewater.sources.generate_sql import events_sql
from tidewater.sources.tables import BRONZE_SQL, bronze_view

LAYER = load_layer()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The same chain of judgments, written for another engine.
CHAIN = "WITH " + BRONZE_SQL.replace("{events}", "events") + """,
q AS (SELECT *, CASE WHEN event_ts < TIMESTAMP '2019-01-01 00:00:00' THEN 'before_launch' WHEN event_ts > ingested_at + INTERVAL '6' HOUR THEN 'future_dated' END AS quarantine_reason FROM bronze),
clean AS (SELECT * FROM q WHERE quarantine_reason IS NULL),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS LAST) AS n FROM clean) WHERE n = 1),
dr AS (SELECT *, coalesce(product_id, item_id) AS sku FROM dd),
gaps AS (SELECT *, date_diff('microsecond', lag(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts), event_ts) / 1e6 AS gap FROM dr),
feat AS (SELECT session_id, coalesce(median(gap), 999.0) AS median_gap, coalesce(stddev_samp(gap), 999.0) AS gap_stdev, count(*) AS depth, bool_or(event_name IN ('add_to_cart', 'purchase')) AS carted FROM gaps GROUP BY session_id),
bots AS (SELECT *, ((median_gap < 1.6 AND depth >= 10) OR (gap_stdev < 0.9 AND depth >= 14)) AND NOT carted AS suspect FROM feat),
sb AS (SELECT dr.*, coalesce(bots.suspect, false) AS is_suspected_bot FROM dr LEFT JOIN bots USING (session_id)),
{sessions}
silver_events AS (SELECT *, date_trunc('day', event_ts) AS event_date, date_diff('microsecond', event_ts, ingested_at) / 1e6 AS lateness_seconds, date_diff('microsecond', event_ts, ingested_at) > 259200000000 AS arrived_after_watermark FROM se)
"""
SESSIONS = """n1 AS (SELECT *, CASE WHEN lag(event_ts) OVER w IS NULL OR date_diff('microsecond', lag(event_ts) OVER w, event_ts) > {minutes} THEN 1 ELSE 0 END AS fresh FROM sb WINDOW w AS (PARTITION BY visitor_id ORDER BY event_ts, event_id)),
n2 AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS ordinal FROM n1),
se AS (SELECT *, visitor_id || ':' || CAST(CAST(floor(epoch_us(min(event_ts) OVER (PARTITION BY visitor_id, ordinal)) / 1000000) AS BIGINT) AS VARCHAR) AS derived_session_id FROM n2),"""


def chain(minutes: int = 30) -> str:
    return CHAIN.replace("{sessions}", SESSIONS.replace("{minutes}", str(minutes * 60_000_000)))


def query(sql: str | None = None, minutes: int = 30):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = chain(minutes) + sql
        return f

    return add


def clean(spark, d):
    return S.quarantine(bronze_view(spark, d))[0]


def silver(spark, d, minutes=S.TIMEOUT_MINUTES):
    return S.to_silver(clean(spark, d), minutes)


us = lambda c: F.unix_micros(c)


@query("SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events, count(DISTINCT session_id) AS n_sessions, count(DISTINCT visitor_id) AS n_visitors, epoch_us(min(event_ts)) AS first_us, epoch_us(max(event_ts)) AS last_us FROM bronze")
def bronze_profile(spark, d):
    return bronze_view(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("visitor_id").alias("n_visitors"), us(F.min("event_ts")).alias("first_us"), us(F.max("event_ts")).alias("last_us"))


@query("SELECT event_id, epoch_us(ingested_at) AS ingested_us, quarantine_reason FROM q")
def quarantine_split(spark, d):
    return S.with_quarantine_reason(bronze_view(spark, d)).select("event_id", us("ingested_at").alias("ingested_us"), "quarantine_reason")


@query("SELECT event_id, epoch_us(event_ts) AS event_us, epoch_us(ingested_at) AS ingested_us, quarantine_reason FROM q WHERE quarantine_reason IS NOT NULL")
def quarantine_rows(spark, d):
    return S.quarantine(bronze_view(spark, d))[1].select("event_id", us("event_ts").alias("event_us"), us("ingested_at").alias("ingested_us"), "quarantine_reason")


@query("SELECT quarantine_reason, count(*) AS n FROM q GROUP BY quarantine_reason")
def quarantine_counts(spark, d):
    return S.with_quarantine_reason(bronze_view(spark, d)).groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, session_id, epoch_us(ingested_at) AS ingested_us FROM dd")
def dedup_first_seen(spark, d):
    return S.deduplicate(clean(spark, d)).select("event_id", "session_id", us("ingested_at").alias("ingested_us"))


@query("SELECT (SELECT count(*) FROM clean) AS rows_in, (SELECT count(*) FROM dd) AS rows_out, round(1 - (SELECT count(*) FROM dd) / CAST((SELECT count(*) FROM clean) AS DOUBLE), 6) AS rate")
def dedup_rate(spark, d):
    rows = clean(spark, d)
    both = rows.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(S.deduplicate(rows).agg(F.count(F.lit(1)).alias("rows_out")))
    return both.withColumn("rate", F.round(1 - F.col("rows_out") / F.col("rows_in"), 6))


@query("SELECT event_id, product_id, item_id, sku FROM dr")
def drift_sku(spark, d):
    return S.resolve_drift(S.deduplicate(clean(spark, d))).select("event_id", "product_id", "item_id", "sku")


@query("SELECT count(*) AS rescued, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT app_version AS v FROM dr WHERE product_id IS NULL AND item_id IS NOT NULL)) AS versions, epoch_us(min(event_ts)) AS first_us FROM dr WHERE product_id IS NULL AND item_id IS NOT NULL")
def drift_report(spark, d):
    rows = S.resolve_drift(S.deduplicate(clean(spark, d))).filter(S.rescued())
    return rows.agg(F.count(F.lit(1)).alias("rescued"), F.array_join(F.sort_array(F.collect_set("app_version")), ",").alias("versions"), us(F.min("event_ts")).alias("first_us"))


@query("SELECT session_id, round(median_gap, 6) AS median_gap, round(gap_stdev, 6) AS gap_stdev, depth, carted FROM feat")
def bot_features(spark, d):
    return S.bot_features(S.deduplicate(clean(spark, d))).select("session_id", F.round("median_gap", 6).alias("median_gap"), F.round("gap_stdev", 6).alias("gap_stdev"), "depth", "carted")


@query("SELECT session_id, depth FROM bots WHERE suspect")
def bot_sessions(spark, d):
    return S.bot_features(S.deduplicate(clean(spark, d))).filter("suspect").select("session_id", "depth")


@query("SELECT event_id, is_suspected_bot FROM sb")
def bot_events(spark, d):
    return S.classify_bots(S.deduplicate(clean(spark, d))).select("event_id", "is_suspected_bot")


def _sessionized(minutes):
    def f(spark, d):
        return S.sessionize(S.deduplicate(clean(spark, d)), minutes).select("event_id", "visitor_id", "derived_session_id")

    f.__name__ = f"sessionize_{minutes}m"
    query("SELECT event_id, visitor_id, derived_session_id FROM se", minutes)(f)


for _m in (5, 30, 120):
    _sessionized(_m)


@query("SELECT count(DISTINCT derived_session_id) AS derived, count(DISTINCT session_id) AS client FROM se")
def session_vs_client(spark, d):
    return S.sessionize(S.deduplicate(clean(spark, d))).agg(F.count_distinct("derived_session_id").alias("derived"), F.count_distinct("session_id").alias("client"))


@query("SELECT event_id, epoch_us(event_date) AS day_us, round(lateness_seconds, 6) AS lateness_seconds, arrived_after_watermark FROM silver_events")
def watermark_flags(spark, d):
    return S.apply_watermark(S.deduplicate(clean(spark, d))).select("event_id", us("event_date").alias("day_us"), F.round("lateness_seconds", 6).alias("lateness_seconds"), "arrived_after_watermark")


@query("SELECT CAST(event_date AS DATE) AS day, count(*) AS late FROM silver_events WHERE arrived_after_watermark GROUP BY 1")
def late_by_day(spark, d):
    return S.apply_watermark(S.deduplicate(clean(spark, d))).filter("arrived_after_watermark").groupBy(F.to_date("event_date").alias("day")).agg(F.count(F.lit(1)).alias("late"))


@query("SELECT event_id, sku, is_suspected_bot, derived_session_id, epoch_us(event_date) AS day_us, round(lateness_seconds, 6) AS lateness_seconds, arrived_after_watermark FROM silver_events")
def silver_full(spark, d):
    return silver(spark, d).select("event_id", "sku", "is_suspected_bot", "derived_session_id", us("event_date").alias("day_us"), F.round("lateness_seconds", 6).alias("lateness_seconds"), "arrived_after_watermark")


@query("""SELECT (SELECT count(*) FROM bronze) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM q WHERE quarantine_reason IS NOT NULL) AS quarantined_timestamps, (SELECT count(*) FROM clean) - count(*) AS duplicates_removed,
count(*) FILTER (WHERE product_id IS NULL AND item_id IS NOT NULL) AS drifted_rows_recovered, count(*) FILTER (WHERE is_suspected_bot) AS bot_events_flagged, count(DISTINCT CASE WHEN is_suspected_bot THEN session_id END) AS bot_sessions_flagged,
count(DISTINCT derived_session_id) AS sessions_derived, count(*) FILTER (WHERE arrived_after_watermark) AS events_after_watermark FROM silver_events""")
def manifest(spark, d):
    return S.manifest_counts(bronze_view(spark, d))


def _literal(q):
    sql = q.sql
    for a in q.args:
        sql = sql.replace("?", "'" + str(a).replace("'", "''") + "'", 1)
    return sql


def _metric(name, spec):
    def f(spark, d):
        return Engine(silver(spark, d), LAYER).frame(spec).withColumn("value", F.round(F.col("value").cast("double"), 6))

    f.__name__ = name
    QUERIES[name] = f
    cols = ", ".join([*spec.dimensions, "round(CAST(value AS DOUBLE), 6) AS value"])
    SQL[name] = f"{chain()} SELECT {cols} FROM ({_literal(compile_spec(spec, LAYER))})"


for _k in LAYER["metrics"]:
    _metric(f"metric_{_k}", MetricSpec(_k))
    for _d in LAYER["dimensions"]:
        _metric(f"metric_{_k}_by_{_d}", MetricSpec(_k, (_d,)))
_metric("metric_waived_bots", MetricSpec("pageviews", waive_default_filters=("exclude_bots",)))
_metric("metric_waived_all", MetricSpec("pageviews", waive_default_filters=("exclude_bots", "closed_days_only")))
_metric("metric_date_range_inclusive", MetricSpec("sessions", ("event_date",), start_date="2024-01-05", end_date="2024-01-12"))
_metric("metric_filtered", MetricSpec("revenue", filters={"device": "app", "membership_tier": "plus"}))
_metric("metric_two_dims_limit", MetricSpec("orders", ("device", "category"), limit=7))


@query("""SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM (
SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn FROM (SELECT session_id, bool_or(is_suspected_bot) AS p, bool_or(_is_bot) AS t FROM silver_events GROUP BY session_id))""")
def bot_scorecard(spark, d):
    return Q.bot_scorecard(silver(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_RESTATED = """r AS (SELECT CAST(event_date AS DATE) AS day, *, ingested_at <= event_date + INTERVAL 1 DAY + INTERVAL 6 HOUR AS early FROM silver_events),
r2 AS (SELECT day, count(*) FILTER (WHERE early) AS events_early, count(*) AS events_final, count(DISTINCT CASE WHEN early THEN derived_session_id END) AS sessions_early, count(DISTINCT derived_session_id) AS sessions_final,
count(*) FILTER (WHERE early AND event_name = 'purchase') AS purchases_early, count(*) FILTER (WHERE event_name = 'purchase') AS purchases_final FROM r GROUP BY day HAVING count(DISTINCT derived_session_id) > 5),
r3 AS (SELECT *, purchases_early / CAST(greatest(sessions_early, 1) AS DOUBLE) AS ce, purchases_final / CAST(greatest(sessions_final, 1) AS DOUBLE) AS cf FROM r2)
SELECT day, events_early, events_final, sessions_early, sessions_final, purchases_early, purchases_final, round(ce, 6) AS conv_early, round(cf, 6) AS conv_final, round((cf - ce) / CASE WHEN ce = 0 THEN 1 ELSE ce END, 6) AS conv_moved FROM r3"""


def _round_conv(df):
    return df.withColumns({c: F.round(c, 6) for c in ("conv_early", "conv_final", "conv_moved")})


def restatement(spark, d):
    return _round_conv(Q.restatement(silver(spark, d), min_sessions=5))


def restatement_series(spark, d):
    return _round_conv(Q.restatement(silver(spark, d), min_sessions=5, last_days=None))


QUERIES |= {"restatement": restatement, "restatement_series": restatement_series}
SQL |= {"restatement": chain() + ", " + _RESTATED + " ORDER BY day DESC LIMIT 8", "restatement_series": chain() + ", " + _RESTATED}


@query("""SELECT count(*) AS n_rows, count(DISTINCT event_id) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS visitors, count(*) FILTER (WHERE event_name = 'purchase') AS purchases, count(*) FILTER (WHERE _is_duplicate) AS duplicates,
count(DISTINCT CASE WHEN _is_bot THEN session_id END) AS bot_sessions, count(*) FILTER (WHERE _is_bot) AS bot_events, round(quantile_cont(date_diff('microsecond', _true_ts, ingested_at) / 1e6, 0.5), 6) AS lag_p50, round(quantile_cont(date_diff('microsecond', _true_ts, ingested_at) / 1e6, 0.95), 6) AS lag_p95,
round(max(date_diff('microsecond', _true_ts, ingested_at)) / 1e6, 6) AS lag_max, epoch_us(min(event_ts)) AS first_us, epoch_us(max(event_ts)) AS last_us, round(count(*) FILTER (WHERE _is_bot) / CAST(count(*) AS DOUBLE), 6) AS bot_share_events, round(count(DISTINCT CASE WHEN _is_bot THEN session_id END) / CAST(count(DISTINCT session_id) AS DOUBLE), 6) AS bot_share_sessions FROM bronze""")
def bronze_summary(spark, d):
    out = Q.summary(bronze_view(spark, d))
    return out.select(F.col("rows").alias("n_rows"), "events", "sessions", "visitors", "purchases", "duplicates", "bot_sessions", "bot_events", *(F.round(c, 6).alias(c) for c in ("lag_p50", "lag_p95", "lag_max", "bot_share_events", "bot_share_sessions")), us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("""SELECT CAST(least(68, floor(round(ln(lag / 0.05) / ln(top / 0.05), 9) * 69)) AS BIGINT) AS bin, false AS buffered, count(*) AS n FROM (SELECT greatest(0.05, date_diff('microsecond', _true_ts, ingested_at) / 1e6) AS lag FROM bronze),
(SELECT greatest(10.0, max(greatest(0.05, date_diff('microsecond', _true_ts, ingested_at) / 1e6))) AS top FROM bronze) GROUP BY 1""")
def lag_histogram(spark, d):
    return Q.lag_histogram(bronze_view(spark, d)).select(F.col("bin").cast("long").alias("bin"), "buffered", F.col("rows").alias("n"))


@query("SELECT count(*) FILTER (WHERE lag > 3600) AS late, round(max(lag), 6) AS lag_max, round(median(lag), 6) AS lag_median FROM (SELECT date_diff('microsecond', _true_ts, ingested_at) / 1e6 AS lag FROM bronze)")
def lag_facts(spark, d):
    return Q.lag_facts(bronze_view(spark, d)).withColumns({c: F.round(c, 6) for c in ("lag_max", "lag_median")})


@query("SELECT hour, sessions, hour = (SELECT hour FROM th ORDER BY sessions DESC, hour LIMIT 1) AS is_peak FROM th".replace("th", "(SELECT CAST(hour(event_ts) AS INTEGER) AS hour, count(DISTINCT session_id) AS sessions FROM bronze WHERE event_ts > TIMESTAMP '2020-01-01' AND event_ts < TIMESTAMP '2030-01-01' GROUP BY 1)"))
def traffic_by_hour(spark, d):
    return Q.traffic_by_hour(bronze_view(spark, d))


@query("SELECT round(count(*) FILTER (WHERE b) / CAST(count(*) AS DOUBLE), 6) AS share_sessions, round(coalesce(sum(n) FILTER (WHERE b), 0) / CAST(sum(n) AS DOUBLE), 6) AS share_events FROM (SELECT session_id, bool_or(_is_bot) AS b, count(*) AS n FROM bronze GROUP BY session_id)")
def bot_share(spark, d):
    return Q.bot_share(bronze_view(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("share_sessions", "share_events")))


@query("SELECT CAST(greatest(0, least(60, floor(round(ln(greatest(m, 0.03) / 0.03) / ln(200.0 / 0.03), 9) * 61))) AS BIGINT) AS bin, is_bot, count(*) AS sessions FROM (SELECT session_id, median(gap) AS m, count(*) AS depth, bool_or(_is_bot) AS is_bot FROM gaps GROUP BY session_id) WHERE depth >= 8 AND m IS NOT NULL GROUP BY 1, 2")
def dwell_overlap(spark, d):
    return Q.dwell_overlap(silver(spark, d)).select(F.col("bin").cast("long").alias("bin"), "is_bot", "sessions")


def _by_day(x):
    return _literal(compile_spec(MetricSpec(f"conversion_rate_{x}", ("event_date",), limit=10_000), LAYER)).replace("AS value", f"AS by_{x}")


@query(f", a AS ({_by_day('sessions')}), b AS ({_by_day('visitors')}), ab AS (SELECT a.event_date, by_sessions, by_visitors FROM a JOIN b ON a.event_date = b.event_date) SELECT event_date, round(by_sessions, 6) AS by_sessions, round(by_visitors, 6) AS by_visitors FROM ab WHERE event_date > (SELECT min(event_date) FROM ab) AND event_date < (SELECT max(event_date) FROM ab)")
def two_conversions(spark, d):
    return Engine(silver(spark, d), LAYER).two_conversions().select("event_date", F.round("by_sessions", 6).alias("by_sessions"), F.round("by_visitors", 6).alias("by_visitors"))


@query("SELECT step, name, value FROM (SELECT 0 AS step, 'raw' AS name, count(*) AS value FROM silver_events WHERE event_name = 'page_view' UNION ALL SELECT 1, 'without_bots', count(*) FROM silver_events WHERE event_name = 'page_view' AND NOT is_suspected_bot UNION ALL SELECT 2, 'default', count(*) FROM silver_events WHERE event_name = 'page_view' AND NOT is_suspected_bot AND NOT arrived_after_watermark)")
def filter_waterfall(spark, d):
    return Engine(silver(spark, d), LAYER).filter_waterfall()


def fault_free(spark, d):
    """The bronze view's events before any fault."""
    b = bronze_view(spark, d).filter("not _is_duplicate")
    return b.withColumns({"event_ts": F.col("_true_ts"), "product_id": F.coalesce("product_id", "item_id"), "app_version": F.lit("2.3.0"), "schema_version": F.lit("2.3.0"), "_persona": F.lit(None).cast("string")}).drop("item_id", "ingested_at", "_true_ts", "_is_duplicate")


_U = "(CAST('0x' || substr(md5('4242:{salt}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"


def _u(salt, key):
    return _U.replace("{salt}", salt).replace("{key}", key)


_FREE = ", ff AS (SELECT * REPLACE (_true_ts AS event_ts, coalesce(product_id, item_id) AS product_id) FROM bronze WHERE NOT _is_duplicate) "


@query(_FREE + f"SELECT event_id, CAST(floor(ln(greatest(u, 1 / 8589934592.0)) / ln(0.015)) AS BIGINT) AS copies FROM (SELECT event_id, {_u('copies', 'event_id')} AS u FROM ff) WHERE floor(ln(greatest(u, 1 / 8589934592.0)) / ln(0.015)) > 0")
def corrupt_duplicate(spark, d):
    rows = C.deliver_at_least_once(C.stamp_ingestion(fault_free(spark, d).withColumn("_true_ts", F.col("event_ts")), C.Chaos()), C.Chaos())
    return rows.filter("_copy > 0").groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


@query(_FREE + f"""SELECT event_id, CAST(round(CASE WHEN u < 0.004 THEN CASE WHEN a < 1 / 3.0 THEN -20455 WHEN a < 2 / 3.0 THEN -3650 ELSE 4380 END * 86400.0
WHEN u < 0.06 THEN round(sqrt(-2 * ln(greatest(x, 1 / 8589934592.0))) * cos(2 * pi() * y) * 240, 3) ELSE 0 END * 1000) AS BIGINT) AS offset_ms FROM (SELECT event_id, {_u('skew', 'visitor_id')} AS u, {_u('absurd', 'visitor_id')} AS a, {_u('skew-a', 'visitor_id')} AS x, {_u('skew-b', 'visitor_id')} AS y FROM ff)""")
def corrupt_skew(spark, d):
    return C.skew_clocks(fault_free(spark, d), C.Chaos()).select("event_id", F.floor((F.unix_micros("event_ts") - F.unix_micros("_true_ts") + 500) / 1000).cast("long").alias("offset_ms"))


@query(_FREE + f""", sp AS (SELECT epoch_us(min(event_ts)) AS lo, epoch_us(max(event_ts)) AS hi FROM ff), h AS (SELECT ff.*, device = 'app' AND epoch_us(event_ts) >= CAST(floor(lo + (hi - lo) * 0.62e0) AS BIGINT) AND {_u('drift', 'visitor_id')} < 0.55 AS hit FROM ff, sp)
SELECT event_id, CASE WHEN NOT hit THEN product_id END AS product_id, CASE WHEN hit THEN product_id END AS item_id, CASE WHEN hit THEN '2.4.0' ELSE '2.3.0' END AS app_version FROM h""")
def corrupt_drift(spark, d):
    return C.drift_schema(fault_free(spark, d).withColumn("_true_ts", F.col("event_ts")), C.Chaos()).select("event_id", "product_id", "item_id", "app_version")


@query(_FREE + f"SELECT event_id, CASE WHEN hit THEN CASE WHEN {_u('spoof-device', 'event_id')} < 0.8 THEN 'desktop' ELSE 'mobile_web' END ELSE device END AS device, CASE WHEN hit THEN 'guest' ELSE membership_tier END AS membership_tier FROM (SELECT *, _is_bot AND {_u('spoof', 'session_id')} < 0.75 AS hit FROM ff)")
def corrupt_spoof(spark, d):
    return C.spoof_bots(fault_free(spark, d), C.Chaos()).select("event_id", "device", "membership_tier")


@query(_FREE + f"SELECT event_id, round(round(least(12.0, 0.4 * pow(1 / greatest({_u('lag', 'event_id')}, 0.02), 0.55)), 6), 3) AS lag FROM ff")
def corrupt_stamp(spark, d):
    rows = C.stamp_ingestion(fault_free(spark, d).withColumn("_true_ts", F.col("event_ts")), C.Chaos())
    return rows.select("event_id", F.round((F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6, 3).alias("lag"))


@query(_FREE + f""", k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n, first_value(device) OVER (PARTITION BY session_id ORDER BY event_ts, event_id) AS d0 FROM ff)
SELECT event_id, k >= 1 + floor({_u('cut', 'session_id')} * (n - 1)) AS late_part FROM k WHERE d0 = 'app' AND n >= 3 AND {_u('offline', 'session_id')} < 0.1""")
def corrupt_buffer(spark, d):
    rows = C.buffer_offline(C.stamp_ingestion(fault_free(spark, d).withColumn("_true_ts", F.col("event_ts")), C.Chaos()), C.Chaos())
    touched = rows.filter("_was_buffered").select("session_id").distinct()
    return rows.join(touched, "session_id", "left_semi").select("event_id", F.coalesce("_was_buffered", F.lit(False)).alias("late_part"))


@query(_FREE + f""", k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, event_id DESC) = 1 AS is_last, {_u('drop', "event_id || ':0'")} AS u FROM ff)
SELECT count(*) FILTER (WHERE lost) AS dropped, count(*) FILTER (WHERE lost AND event_name = 'purchase') AS dropped_purchases, count(*) FILTER (WHERE NOT lost) AS kept FROM (SELECT *, u < CASE WHEN is_last THEN 0.055 ELSE 0.018 END AS lost FROM k)""")
def corrupt_drop(spark, d):
    return C.loss_ledger(fault_free(spark, d).withColumn("_true_ts", F.col("event_ts")), C.Chaos())


_TINY = "1 / 8589934592.0"
_ALL = f""", sp AS (SELECT epoch_us(min(event_ts)) AS lo, epoch_us(max(event_ts)) AS hi FROM ff),
f1 AS (SELECT ff.* EXCLUDE (device), ff.device AS d, {_u('skew', 'visitor_id')} AS us, {_u('absurd', 'visitor_id')} AS ua, {_u('skew-a', 'visitor_id')} AS ux, {_u('skew-b', 'visitor_id')} AS uy,
  ff.device = 'app' AND epoch_us(event_ts) >= CAST(floor(lo + (hi - lo) * 0.62e0) AS BIGINT) AND {_u('drift', 'visitor_id')} < 0.55 AS drifted, _is_bot AND {_u('spoof', 'session_id')} < 0.75 AS spoofed,
  {_u('lag', 'event_id')} AS ul, {_u('copies', 'event_id')} AS uc FROM ff, sp),
f2 AS (SELECT *, CASE WHEN spoofed THEN CASE WHEN {_u('spoof-device', 'event_id')} < 0.8 THEN 'desktop' ELSE 'mobile_web' END ELSE d END AS device,
  CASE WHEN us < 0.004 THEN CASE WHEN ua < 1 / 3.0 THEN -20455 WHEN ua < 2 / 3.0 THEN -3650 ELSE 4380 END * 86400.0 WHEN us < 0.06 THEN round(sqrt(-2 * ln(greatest(ux, {_TINY}))) * cos(2 * pi() * uy) * 240, 3) ELSE 0 END AS offset_s FROM f1),
f3 AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n, first_value(device) OVER w AS d0 FROM f2 WINDOW w AS (PARTITION BY session_id ORDER BY event_ts, event_id)),
f4 AS (SELECT *, d0 = 'app' AND n >= 3 AND {_u('offline', 'session_id')} < 0.1 AND k >= 1 + floor({_u('cut', 'session_id')} * (n - 1)) AS buffered, (1 + {_u('flush', 'session_id')} * 79) * 3600 AS flush_s FROM f3),
f5 AS (SELECT *, round(least(12.0, 0.4 * pow(1 / greatest(ul, 0.02), 0.55)), 6) + CASE WHEN buffered THEN round(flush_s, 6) ELSE 0 END AS lag0, unnest(range(0, 1 + CAST(floor(ln(greatest(uc, {_TINY})) / ln(0.015)) AS BIGINT))) AS copy FROM f4),
f6 AS (SELECT *, CASE WHEN copy > 0 THEN round(0.2e0 + {_u('again', "event_id || ':' || copy")} * (240e0 - 0.2e0), 6) ELSE 0 END AS again, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, event_id DESC, copy DESC) = 1 AS is_last FROM f5)
SELECT event_id, session_id, visitor_id, event_name, device, CASE WHEN spoofed THEN 'guest' ELSE membership_tier END AS membership_tier, CASE WHEN NOT drifted THEN product_id END AS product_id, CASE WHEN drifted THEN product_id END AS item_id,
CASE WHEN drifted THEN '2.4.0' ELSE '2.3.0' END AS app_version, CAST(round(offset_s * 1000) AS BIGINT) AS offset_ms, round(lag0 + again, 3) AS lag, drifted, spoofed, buffered, copy > 0 AS duplicate
FROM f6 WHERE NOT {_u('drop', "event_id || ':' || copy")} < CASE WHEN is_last THEN 0.055 ELSE 0.018 END"""


@query(_FREE + _ALL)
def corrupt_all(spark, d):
    rows = C.corrupt(fault_free(spark, d))
    micros = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "event_id", "session_id", "visitor_id", "event_name", "device", "membership_tier", "product_id", "item_id", "app_version",
        F.floor((micros("event_ts", "_true_ts") + 500) / 1000).cast("long").alias("offset_ms"), F.round(micros("ingested_at", "_true_ts") / 1e6, 3).alias("lag"),
        flag("_drifted").alias("drifted"), flag("_bot_spoofed").alias("spoofed"), flag("_was_buffered").alias("buffered"), flag("_is_duplicate").alias("duplicate"),
    )


#: The end of the generated days; the generator's own default sizes hold.
END = datetime(2024, 2, 1, tzinfo=timezone.utc)


def generated_events(spark, d):
    rows = generate_events(spark, END)
    return rows.select(
        "event_id", "session_id", "visitor_id", "member_id", us("event_ts").alias("event_us"), "event_name", "page_type", "product_id", "category", "search_term",
        "device", "membership_tier", "order_id", "order_total", F.col("_persona").alias("persona"),
    )


def generated_profile(spark, d):
    """Shares that the source is tuned for, by hour of the day, persona, tier, device and landing page."""
    first = generate_events(spark, END).withColumn("landing", F.first("page_type").over(Window.partitionBy("session_id").orderBy("event_ts", "event_id")))
    s = first.groupBy("session_id", "_persona", "membership_tier", "device", "landing").agg(F.hour(F.min("event_ts")).alias("hour"), F.count(F.lit(1)).alias("events"), F.bool_or(F.col("event_name") == "purchase").alias("buys"))
    axes = [F.struct(F.lit(n).alias("axis"), F.col(c).cast("string").alias("value")) for n, c in (("persona", "_persona"), ("tier", "membership_tier"), ("device", "device"), ("landing", "landing"), ("hour", "hour"))]
    cells = s.select("events", "buys", F.explode(F.array(*axes)).alias("x")).groupBy("x.axis", "x.value")
    return cells.agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.count_if("buys").alias("buying"))


def generated_silver_sessions(spark, d):
    """Source, faults and silver in one plan; then sessions by device through the semantic layer."""
    bronze = C.corrupt(generate_events(spark, END))
    return Engine(S.to_silver(S.quarantine(bronze)[0]), LAYER).frame(MetricSpec("sessions", ("device",)))


QUERIES |= {"generated_events": generated_events, "generated_profile": generated_profile, "generated_silver_sessions": generated_silver_sessions}
SQL |= {
    "generated_events": f"WITH {events_sql(END)} SELECT * FROM generated",
    "generated_profile": f"""WITH {events_sql(END)}, f AS (SELECT *, first_value(page_type) OVER (PARTITION BY session_id ORDER BY event_us, event_id) AS landing FROM generated),
s AS (SELECT session_id, persona, membership_tier, device, landing, CAST(min(event_us) // 3600000000 % 24 AS VARCHAR) AS hour, count(*) AS events, bool_or(event_name = 'purchase') AS buys FROM f GROUP BY ALL),
c AS (SELECT 'persona' AS axis, persona AS value, events, buys FROM s UNION ALL SELECT 'tier', membership_tier, events, buys FROM s UNION ALL SELECT 'device', device, events, buys FROM s
  UNION ALL SELECT 'landing', landing, events, buys FROM s UNION ALL SELECT 'hour', hour, events, buys FROM s)
SELECT axis, value, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, count(*) FILTER (WHERE buys) AS buying FROM c GROUP BY axis, value""",
}


def flagship(spark, d):
    return Engine(S.to_silver(clean(spark, d)), LAYER).frame(MetricSpec("sessions", ("device",)))
