import zlib

from pyspark.sql import functions as F

from tests.llm.frames import awkward, empty
from tidewater.llm import sharding


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 40, 1000, 4097):
        steps = sharding.walk_steps(n)
        got = sorted(r[0] for r in spark.range(n).select(sharding.walked(F.col("id"), n, steps)).collect())
        assert got == list(range(n))


def test_driver_and_column_forms_agree(spark):
    got = [r[0] for r in spark.range(1000).orderBy("id").select(sharding.permuted(F.col("id"), 997)).collect()]
    assert got == [sharding.permuted_number(x, 997) for x in range(1000)]


def test_counts_and_slots(spark):
    texts = ["", None, "é", "same", "same"] + [f"t{i}" for i in range(500)]
    rows = sharding.shard_rows(awkward(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(by) == 40 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    of = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (of[i].size, of[i].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(awkward(spark, texts).repartition(3, "text")).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_spread_of_neighbours(spark):
    rows = sharding.shard_rows(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).orderBy("doc_id").collect()
    same = sum(a.shard == b.shard for a, b in zip(rows, rows[1:]))
    assert 40 < same < 180  # about one in forty


def test_empty(spark):
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(5, "same", 1, "x", "y")] * 30 + [(5, "z" * 3_000_000, 1, "x", "y"), (None, None, 1, "x", "y"), (None, "", 1, "x", "y")]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string, part string")).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(i, 0) for i in range(33)]
    assert {r.size for r in out} == {20, 3_000_016, 16}
