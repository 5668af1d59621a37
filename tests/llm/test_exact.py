import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.frames import awkward, empty
from tidewater.llm import _common, exact


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def check(spark, texts, **kw):
    rows = {r.doc_id: r for r in exact.exact_groups(awkward(spark, texts), **kw).collect()}
    assert len(rows) == len(texts) + 1
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (keep, len(ids), i == keep)
            assert rows[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()


TEXTS = ["", None, " \n", "a b", "ab", "a  b", "b a", " ab", "é" * 5000, "é" * 4999 + " é", "é" * 4999, "x" * 100_000, "x" * 100_001, "x" * 99_999 + " x"]


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("ab \n", k=rng.randint(0, 40))) for _ in range(150)]
    check(spark, texts, block_bytes=4)
    check(spark, TEXTS)


def test_hot_and_other_groups(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_SHARE", 4)
    check(spark, ["hot"] * 20 + ["h ot"] * 10 + ["warm", "wa rm", "cold", None, "", "x" * 20_000, "x" * 20_000])


def test_colliding_block_keys_are_made_anew(spark):
    weak = lambda block, salt: F.struct((F.octet_length(block) if salt == 0 else F.xxhash64(F.lit(salt), block)).cast("long").alias("x"), F.lit(0).alias("y"))
    check(spark, TEXTS, block_bytes=3000, block_key=weak)


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in exact.exact_groups(df).collect()) == [(0, False), (0, True), (1, False), (1, True)]


def test_empty(spark):
    assert exact.exact_groups(empty(spark)).count() == 0
