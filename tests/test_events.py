"""Edge frames of every judgment, the invariants of source and faults, and the semantic layer."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewater import queries, schemas
from tidewater.operators import corrupt as C
from tidewater.operators import quality as Q
from tidewater.operators import silver as S
from tidewater.plans.semantic import Engine, MetricSpec, SpecError, compile_spec, lint, load_layer, query_hash, resolve, validate
from tidewater.sources import tables
from tidewater.sources.generate import generate_events

T0 = datetime(2024, 1, 5, 12, tzinfo=timezone.utc)
LAYER = load_layer()


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def events(spark, rows):
    """rows: dicts over defaults; event_id counts up."""
    base = {"session_id": "s", "visitor_id": "v", "event_ts": T0, "event_name": "page_view", "product_id": None, "item_id": None, "ingested_at": T0, "app_version": "2.3.0"}
    full = [base | {"event_id": f"{i:04d}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in sorted(base | {"event_id": 0})) for r in full], "app_version string, event_id string, event_name string, event_ts timestamp, ingested_at timestamp, item_id string, product_id string, session_id string, visitor_id string")


def test_quarantine_bounds(spark):
    launch = datetime(2019, 1, 1, tzinfo=timezone.utc)
    late = timedelta(hours=6)
    rows = [{"event_ts": launch, "ingested_at": launch}, {"event_ts": T0 + late}, {"event_ts": T0 + late + timedelta(microseconds=1)}, {"event_ts": None}, {"event_ts": launch - timedelta(days=1), "ingested_at": launch - timedelta(days=2)}]
    got = [r[0] for r in S.with_quarantine_reason(events(spark, rows)).orderBy("event_id").select("quarantine_reason").collect()]
    assert got == [None, None, "future_dated", None, "before_launch"]
    clean, bad = S.quarantine(events(spark, rows))
    assert clean.count() == 3 and bad.count() == 2


def test_first_arrival_stays(spark):
    rows = [{"event_id": "a", "ingested_at": at(5)}, {"event_id": "a", "ingested_at": at(0)}, {"event_id": "a", "ingested_at": at(9)}, {"event_id": "b", "ingested_at": None}, {"event_id": "b", "ingested_at": at(3)}, {"event_id": None}, {"event_id": None}]
    got = {r.event_id: r.ingested_at for r in S.deduplicate(events(spark, rows)).select("event_id", F.unix_seconds("ingested_at").alias("ingested_at")).collect()}
    assert got == {"a": int(at(0).timestamp()), "b": int(at(3).timestamp()), None: int(T0.timestamp())}


def test_drift(spark):
    rows = [{"product_id": "A"}, {"item_id": "B"}, {"product_id": "A", "item_id": "B"}, {}]
    out = S.resolve_drift(events(spark, rows))
    assert [r.sku for r in out.orderBy("event_id").collect()] == ["A", "B", "A", None] and out.filter(S.rescued()).count() == 1
    assert S.resolve_drift(events(spark, rows).drop("item_id")).filter(S.rescued()).count() == 0


def bot(spark, gaps, names=()):
    ts, rows = 0.0, []
    for i in range(len(gaps) + 1):
        rows.append({"event_ts": at(ts), "event_name": names[i] if i < len(names) else "page_view"})
        ts += gaps[i] if i < len(gaps) else 0
    return S.bot_features(events(spark, rows)).first()


def test_bot_rule(spark):
    assert bot(spark, [1.0] * 9).suspect
    assert not bot(spark, [1.0] * 8).suspect
    assert bot(spark, [3.0] * 13).suspect
    assert not bot(spark, [3.0] * 12).suspect
    assert not bot(spark, [0.5] * 19, ["add_to_cart"]).suspect and not bot(spark, [0.5] * 19, ["purchase"]).suspect
    assert bot(spark, [0.5] * 19, ["begin_checkout"]).suspect
    one, two = bot(spark, []), bot(spark, [7.0])
    assert (one.median_gap, one.gap_stdev, two.median_gap, two.gap_stdev) == (999.0, 999.0, 7.0, 999.0)
    assert not bot(spark, [1.6] * 9 + [9.0, 9.0, 0.1, 0.1]).suspect
    rows = events(spark, [{"session_id": None, "event_ts": at(i)} for i in range(20)])
    assert S.classify_bots(rows).filter("is_suspected_bot").count() == 0


def sessions_of(spark, rows, **kw):
    return [r.derived_session_id for r in S.sessionize(events(spark, rows), **kw).orderBy("event_id").collect()]


def test_sessions(spark):
    assert len(set(sessions_of(spark, [{}, {"event_ts": at(1800)}]))) == 1
    assert len(set(sessions_of(spark, [{}, {"event_ts": at(1800.000001)}]))) == 2
    assert len(set(sessions_of(spark, [{}, {"event_ts": at(600), "session_id": "t"}]))) == 1
    assert len(set(sessions_of(spark, [{}, {"event_ts": at(2400)}]))) == 2
    early = datetime(1969, 12, 31, 23, 59, 59, 500000, tzinfo=timezone.utc)
    assert sessions_of(spark, [{"event_ts": early}]) == ["v:-1"]
    assert sessions_of(spark, [{"visitor_id": None}]) == [None]
    assert len(set(sessions_of(spark, [{"event_ts": at(i * 400)} for i in range(9)], timeout_minutes=5))) == 9


def test_watermark(spark):
    h = 72 * 3600
    rows = S.apply_watermark(events(spark, [{"ingested_at": at(h)}, {"ingested_at": at(h + 0.000001)}, {"ingested_at": at(-9)}])).orderBy("event_id").collect()
    assert [r.arrived_after_watermark for r in rows] == [False, True, False]


def test_expected_values_of_the_view(spark):
    d = "/root/testdata/sf0.001"
    m = S.manifest_counts(tables.bronze_view(spark, d)).first()
    assert (m.rows_in, m.rows_out, m.sessions_derived, m.bot_events_flagged, m.bot_sessions_flagged, m.events_after_watermark, m.drifted_rows_recovered) == (1020, 881, 72, 267, 17, 16, 12)
    silver = queries.silver(spark, d).cache()
    s = Q.bot_scorecard(silver).first()
    assert (s.tp, s.fp, s.fn, s.tn) == (13, 4, 2, 43)
    engine = Engine(silver, LAYER)
    value = lambda k: engine.ask(k).value
    assert (value("sessions"), value("visitors"), value("pageviews"), value("orders")) == (54, 12, 127, 123)
    assert round(value("revenue"), 2) == 6990.51 and round(value("conversion_rate"), 6) == 0.833333 and round(value("conversion_rate_visitors"), 6) == 0.75
    assert engine.conversion_gap() < 0
    silver.unpersist()


def test_judgments_do_not_read_truth(spark):
    bronze = tables.bronze_view(spark, "/root/testdata/sf0.001")
    judged = ("sku", "is_suspected_bot", "derived_session_id", "event_date", "lateness_seconds", "arrived_after_watermark")
    assert Q.truth_free(lambda b: S.to_silver(S.quarantine(b)[0]), bronze, tuple(c for c in schemas.TRUTH if c in bronze.columns), judged)


def test_pipeline_modules_do_not_name_truth():
    from tidewater.plans import semantic
    from tidewater.streaming import stream

    assert not any(Q.truth_in_source(m, schemas.TRUTH) for m in (S, semantic, stream))
    assert "_is_bot" in Q.truth_in_source(Q, schemas.TRUTH)


def test_scores_of_nothing(spark):
    rows = events(spark, [{}]).withColumns({"is_suspected_bot": F.lit(False), "_is_bot": F.lit(False)})
    s = Q.bot_scorecard(rows).first()
    assert (s.precision, s.recall, s.f1, s.tn) == (0.0, 0.0, 0.0, 1)
    assert "tune" in Q.scorecard_text(s.asDict())


def test_restatement_bounds(spark):
    report = datetime(2024, 1, 6, 6, tzinfo=timezone.utc)
    rows = S.to_silver(events(spark, [{"ingested_at": report, "event_name": "purchase"}, {"visitor_id": "w", "ingested_at": report + timedelta(microseconds=1)}]))
    r = Q.restatement(rows, min_sessions=1).first()
    assert (r.sessions_early, r.sessions_final, r.purchases_early) == (1, 2, 1) and "->" in Q.restatement_text([r.asDict()])
    assert Q.restatement(rows, min_sessions=2).count() == 0


END = datetime(2024, 2, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def clean(spark):
    df = generate_events(spark, END, n_sessions=1500, days=7, seed=7).cache()
    yield df
    df.unpersist()


def test_generator(spark, clean):
    again = generate_events(spark, END, n_sessions=1500, days=7, seed=7)
    assert clean.repartition(3).exceptAll(again).count() == 0
    assert clean.select(*[x.split()[0] for x in schemas.CLEAN.split(", ")]).columns == clean.columns
    r = clean.agg(F.count_distinct("event_id").alias("ids"), F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("s"), F.count_distinct("visitor_id").alias("v"), F.count_distinct(F.when(F.col("_is_bot"), F.col("session_id"))).alias("b"), F.count_if(F.expr("event_name = 'purchase' and order_total is null")).alias("bad"), F.count_if(F.expr("membership_tier = 'guest' and member_id is not null")).alias("guests"), F.count_if(F.expr("_is_bot and event_name in ('add_to_cart', 'purchase')")).alias("botcarts")).first()
    assert r.ids == r.n and abs(r.s - 1500) <= 4 and 0.5 < r.v / r.s < 0.8 and 0.03 < r.b / r.s < 0.09 and (r.bad, r.guests, r.botcarts) == (0, 0, 0)
    assert clean.filter("event_name = 'purchase'").count() > 20


def test_faults(spark, clean):
    c = C.Chaos()
    skewed = C.skew_clocks(clean, c)
    offset = F.unix_micros("event_ts") - F.unix_micros("_true_ts")
    assert skewed.groupBy("visitor_id").agg(F.count_distinct(offset).alias("n")).filter("n > 1").count() == 0
    staged = C.stamp_ingestion(C.spoof_bots(C.drift_schema(skewed, c), c), c).cache()
    assert staged.filter("_drifted and product_id is not null").count() == 0
    assert staged.filter("_bot_spoofed and (membership_tier != 'guest' or device not in ('desktop', 'mobile_web'))").count() == 0
    lag = staged.select(((F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert lag[0] >= 0.4 and lag[1] <= 3.5
    buffered = C.buffer_offline(staged, c)
    assert buffered.count() == staged.count()
    late = buffered.filter("_was_buffered").groupBy("session_id").agg(((F.max(F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) - F.min(F.unix_micros("ingested_at") - F.unix_micros("_true_ts"))) / 1e6).alias("spread"), F.min((F.unix_micros("ingested_at") - F.unix_micros("_true_ts")) / 1e6).alias("least"))
    assert late.count() and late.filter("spread > 10 or least < 3600").count() == 0
    copies = C.deliver_at_least_once(staged, C.Chaos(duplicate_rate=0.4))
    assert copies.groupBy("event_id").count().filter("count >= 3").count() > 0
    assert C.deliver_at_least_once(staged, C.Chaos(duplicate_rate=0.0)).count() == staged.count()
    ledger = C.loss_ledger(staged, c).first()
    kept = C.drop_beacons(staged, c).count()
    assert ledger.kept == kept and ledger.kept + ledger.dropped == staged.count() and 0.9 < kept / staged.count() < 1
    staged.unpersist()
    bronze = C.corrupt(clean)
    silver, bad, manifest = S.run_pipeline(bronze)
    assert manifest.rows_in == bronze.count() and manifest.rows_out == silver.count() and len(manifest.notes) >= 4
    s = Q.bot_scorecard(silver).first()
    assert s.precision > 0.7 and s.recall > 0.7 and s.fp + s.fn > 0
    assert silver.filter("is_suspected_bot").join(silver.filter("event_name = 'purchase'").select("session_id").distinct(), "session_id").count() == 0


def test_sinks_and_engine(spark, tmp_path, clean):
    silver, bad, manifest = S.run_pipeline(C.corrupt(clean))
    tables.write_bronze(C.corrupt(clean), f"{tmp_path}/bronze")
    assert tables.read_bronze(spark, f"{tmp_path}/bronze").columns == [x.split()[0] for x in schemas.BRONZE.split(", ")]
    tables.write_silver(silver, f"{tmp_path}/silver")
    tables.write_quarantine(bad, f"{tmp_path}/bad")
    tables.write_json(spark, manifest.as_dict(), f"{tmp_path}/manifest.json")
    assert tables.read_json(spark, f"{tmp_path}/none.json") == {}
    engine = Engine.connect(spark, f"{tmp_path}/silver", f"{tmp_path}/manifest.json")
    answer = engine.ask("Conversion Rate")
    assert answer.ambiguity_warning and answer.caveats and answer.freshness and answer.data_quality["rows_in"] == manifest.rows_in and answer.query_hash in answer.render() and '"caveats"' in answer.to_json()
    assert engine.ask("aov", start_date="2030-01-01").value is None
    assert len(engine.list_metrics()) == 10 and engine.describe_metric("Unique visitors")["key"] == "visitors"
    with pytest.raises(FileNotFoundError):
        Engine.connect(spark, f"{tmp_path}/nowhere")


def test_written_once_is_as_run_in_memory(spark, tmp_path, clean):
    bronze = C.corrupt(clean).cache()
    silver, bad, manifest = S.run_pipeline(bronze)
    written, put_aside, again = S.write_pipeline(bronze, f"{tmp_path}/silver", f"{tmp_path}/bad")
    assert again.as_dict() == manifest.as_dict() and again.events_after_watermark
    assert any("clients named" in n for n in again.notes) and "2024-01-" in again.notes[-1]
    cols = [c for c in silver.columns if c != "lateness"]
    assert written.select(cols).exceptAll(silver.select(cols)).count() == 0 and written.count() == silver.count() and put_aside.count() == bad.count()
    bronze.unpersist()


def test_a_range_of_days_reads_its_folders_alone(spark, tmp_path, clean):
    silver = S.write_pipeline(C.corrupt(clean), f"{tmp_path}/silver", f"{tmp_path}/bad")[0]
    spec = MetricSpec("sessions", ("event_date",), "2024-01-28", "2024-01-29")
    frame = Engine(silver, LAYER).frame(spec)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "event_day" in filters and ">= 2024-01-28" in filters and "<= 2024-01-29" in filters
    rows = frame.collect()
    assert len(rows) == 2 and rows == Engine(silver.drop("event_day"), LAYER).frame(spec).collect()


def test_rows_without_ids_are_no_task_of_their_own(spark):
    rows = events(spark, [{"event_id": None, "session_id": None, "visitor_id": None, "event_ts": at(i), "product_id": str(i)} for i in range(40)] + [{"session_id": None, "visitor_id": "v"}])
    out = S.sessionize(S.classify_bots(rows)).collect()
    assert len(out) == 41 and not any(r.is_suspected_bot for r in out) and [r.derived_session_id for r in out if r.derived_session_id] == [f"v:{int(T0.timestamp())}"]
    parts = rows.select(S._own("session_id").alias("s")).distinct().count()
    assert parts > 20


def test_bots_take_one_shuffle(spark):
    plan = S.classify_bots(events(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_layer_with_the_least_that_it_needs(spark):
    layer = {"metrics": {"n_rows": {"sql": "COUNT(*)", "conflicts_with": ["gone"]}, "Big": {"sql": "COUNT(*)", "label": "Big_Number of  rows"}}}
    layer["metrics"]["big"] = layer["metrics"].pop("Big")
    engine = Engine(events(spark, [{}, {}]), layer)
    answer = engine.ask("N rows")
    assert answer.value == 2 and answer.owner == "unowned" and answer.caveats == [] and answer.ambiguity_warning is None and "unowned" in answer.render()
    assert resolve("big number of rows", layer)["resolved"] == "big" and lint(layer) == ["n_rows names gone but not the other way"]
    assert compile_spec(MetricSpec("big"), layer).sql == "SELECT COUNT(*) AS value FROM silver_events LIMIT 500"
    assert resolve("unique_visitors", LAYER)["resolved"] == "visitors"
    with pytest.raises(SpecError):
        engine.execute(MetricSpec("n_rows", ("device",)))


def test_specifications():
    with pytest.raises(SpecError) as e:
        validate(MetricSpec("x", ("y",), "2024-02-02", "2024-02-01", {"z": "1"}, ("w",), 10**7), LAYER)
    assert all(x in str(e.value) for x in ("'x'", "'y'", "'z'", "'w'", "limit", "start_date", "sessions", "device"))
    with pytest.raises(SpecError):
        validate(MetricSpec("sessions", start_date="2024-1-1"), LAYER)
    with pytest.raises(SpecError):
        validate(MetricSpec("sessions", start_date="2024-01-01", end_date="2024-03-01"), LAYER, max_days=30)
    q = compile_spec(MetricSpec("sessions", filters={"device": "'; DROP TABLE x;--"}), LAYER)
    assert "DROP" not in q.sql and "'; DROP TABLE x;--" in q.args and "GROUP BY" not in q.sql and "NOT is_suspected_bot" in q.sql
    assert "is_suspected_bot" not in compile_spec(MetricSpec("sessions", waive_default_filters=("exclude_bots",)), LAYER).sql
    assert "GROUP BY CAST(event_ts AS DATE)" in compile_spec(MetricSpec("sessions", ("event_date",)), LAYER).sql
    assert query_hash(MetricSpec("sessions", ("device", "category"))) == query_hash(MetricSpec("sessions", ("category", "device")))
    assert resolve("conversion_rate", LAYER)["ambiguous"] and resolve("conversion_rate", LAYER)["resolved"] == "conversion_rate_sessions"
    assert not resolve("sessions", LAYER)["ambiguous"] and resolve("client_sessions", LAYER)["ambiguous"] and resolve("page", LAYER)["resolved"] == "pageviews"
    for bad in ("vibes", " "):
        with pytest.raises(SpecError):
            resolve(bad, LAYER)
    assert lint(LAYER) == ["client_sessions names sessions but not the other way"]


def test_end_day_is_whole_and_nulls_last(spark):
    day = datetime(2024, 1, 5, tzinfo=timezone.utc)
    rows = events(spark, [{"event_ts": day + timedelta(days=1, microseconds=-1), "visitor_id": "a"}, {"event_ts": day + timedelta(days=1), "visitor_id": "b"}]).withColumns({"category": F.when(F.col("visitor_id") == "a", "x"), "is_suspected_bot": F.lit(False), "arrived_after_watermark": F.lit(False), "event_date": F.lit("physical")})
    engine = Engine(rows, LAYER)
    assert engine.execute(MetricSpec("visitors", end_date="2024-01-05")).value == 1
    assert [r["category"] for r in engine.execute(MetricSpec("visitors", ("category",))).rows] == ["x", None]
    assert len(engine.execute(MetricSpec("visitors", ("event_date",))).rows) == 2
    assert engine.execute(MetricSpec("visitors", filters={"category": "'; DROP TABLE x;--"})).value == 0


def test_steps_from_the_command_line(spark, tmp_path):
    from tidewater.__main__ import main

    d = str(tmp_path)
    assert "rows: " in main(["generate", "--sessions", "300", "--days", "4", "--end", "2024-02-01", d], spark)
    told = main(["silver", "--lateness-hours", "24", d], spark)
    assert "rows_out: " in told and "more than 24 hours late" in told and "precision" in told
    assert "Sessions: " in main(["ask", d, "sessions"], spark)
    sliced = main(["ask", d, "conversion rate", "--by", "device", "--from", "2024-01-29", "--where", "membership_tier=guest"], spark)
    assert "may mean" in sliced and "device " in sliced and "event_day >= " in sliced and "guest" not in sliced.split("sql: ")[1]
    assert '"query_hash"' in main(["ask", d, "aov", "--json"], spark)
    assert main(["ask", d, "profit"], spark).startswith("rejected: ") and "device" in main(["ask", d, "sessions", "--by", "store"], spark)


def test_generated_shares_and_conversion(clean):
    """The shares that the source is set to, within four standard deviations, and a conversion in the expected range."""
    from tidewater.sources import world as w

    s = clean.groupBy("session_id").agg(
        F.first("_persona").alias("persona"), F.first("device").alias("device"), F.first("membership_tier").alias("tier"), F.hour(F.min("event_ts")).alias("hour"),
        F.min_by("page_type", "event_ts").alias("landing"), F.date_format(F.min("event_ts"), "E").alias("weekday"), F.bool_or(F.col("event_name") == "purchase").alias("buys"),
    ).toPandas()
    wanted = {
        "persona": {k: v[0] for k, v in w.PERSONAS.items()},
        "landing": w.LANDING,
        "hour": dict(enumerate(w.HOURS)),
        "weekday": dict(zip(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), w.WEEKDAYS)),
    }
    n = len(s)
    for axis, shares in wanted.items():
        got, total = s[axis].value_counts(), sum(shares.values())
        for key, share in shares.items():
            p = share / total
            assert abs(got.get(key, 0) - n * p) < 4 * (n * p * (1 - p)) ** 0.5 + 1, (axis, key)
    # a visitor's sessions share device and tier, so these spread wider
    for axis, shares in (("device", w.DEVICES), ("tier", w.TIERS)):
        for key, v in shares.items():
            assert abs((s[axis] == key).mean() - v[0]) < 0.08, (axis, key)
    assert 0.03 < s.buys.mean() < 0.11
