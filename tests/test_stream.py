from tidewater.operators import silver as S
from tidewater.sources.tables import bronze_view
from tidewater.streaming import stream


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_steps(spark, tmp_path):
    bronze = bronze_view(spark, "/root/testdata/sf0.001")
    bronze.write.parquet(f"{tmp_path}/b")
    source = spark.readStream.schema(bronze.schema).parquet(f"{tmp_path}/b")
    flags = run(spark, stream.flagged(source).select("event_id", "ingested_at", "quarantine_reason", "sku", "arrived_after_watermark"), "flags")
    batch = stream.flagged(bronze).select("event_id", "ingested_at", "quarantine_reason", "sku", "arrived_after_watermark")
    assert flags.exceptAll(batch).count() == 0 and flags.count() == bronze.count()
    assert run(spark, stream.first_delivery(source).select("event_id"), "firsts").distinct().count() == bronze.select("event_id").distinct().count()
    q = source.writeStream.foreachBatch(lambda df, _: stream.merge_first(df, f"{tmp_path}/merged")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    merged, want = stream.read_first(spark, f"{tmp_path}/merged"), S.deduplicate(bronze)
    assert merged.select("event_id", "ingested_at").exceptAll(want.select("event_id", "ingested_at")).count() == 0 and merged.count() == want.count()
    windows = run(spark, stream.session_windows(source, watermark="20000 days"), "windows", "complete")
    assert windows.count() == S.sessionize(bronze).select("derived_session_id").distinct().count()
    assert run(spark, stream.daily_visitors(source, "20000 days"), "daily", "complete").count() > 0
