import hashlib
import random
from collections.abc import Iterator

import pandas as pd

from tests.llm.frames import awkward, empty
from tidewater.llm import fingerprints as fp


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, "A", "a ", "Straße", "STRASSE", "ﬁn", "fin", "same same", "same same"] + ["".join(rng.choices("aB é", k=rng.randint(0, 12))) for _ in range(200)] + ["z" * 200_000]
    order = sorted(range(len(texts)), reverse=True) + [None]
    text = {i: texts[i] or "" for i in range(len(texts))} | {None: "a row that has no id at all"}
    rows = {r.doc_id: r for r in fp.edited_fingerprints(awkward(spark, texts)).collect()}
    assert len(rows) == len(order)
    for i, j in zip(order, order[1:] + order[:1]):
        n = len(text[i])
        edited = text[i][: n - n // 2] + text[j][: n // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.fingerprint(text[i]), fp.fingerprint(edited))
        assert r.near_edited == float(fp.canonical(text[i]) == fp.canonical(edited))
        assert r.near_next == float(fp.canonical(text[i]) == fp.canonical(text[j]))


def test_one_row_and_repeated_ids(spark):
    one = fp.edited_fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.edited_fingerprints(spark.createDataFrame([(3, "ab"), (3, "ab"), (3, "cd")], "doc_id long, text string")).count() == 3


def test_a_missing_id_takes_several_ranges(spark):
    rows = [(None, f"text {i} of those without an id") for i in range(300)] + [(5, f"{i}") for i in range(200)] + [(i, f"own {i}") for i in range(6, 60)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == len(rows)
    hashes = {r.t: r.h for r in spark.createDataFrame(rows, "doc_id long, t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in out)


def test_groups(spark):
    rows = {r.doc_id: r for r in fp.fingerprint_groups(awkward(spark, ["Ａb  c", "ab c", "abc", None, ""])).collect()}
    assert [(rows[i].group_id, rows[i].group_size) for i in range(5)] == [(0, 2), (0, 2), (2, 1), (3, 2), (3, 2)]


def test_groups_of_the_query_and_both_joins(spark):
    rng = random.Random(12)
    texts = [None, "", " "] + ["".join(rng.choices("aA ", k=rng.randint(0, 4))) for _ in range(200)]
    of = {}
    for i, t in enumerate(texts):
        of.setdefault(fp.canonical(t), []).append(i)
    want = {i: (min(g), len(g)) for g in of.values() for i in g}
    for rows in (fp.edited_fingerprints(awkward(spark, texts)), fp.fingerprint_groups(awkward(spark, texts), broadcast_rows=0)):
        got = {r.doc_id: (r.group_id, r.group_size) for r in rows.collect()}
        assert got.pop(None) == (None, 1) and got == want


def test_bytes_are_compared_where_fingerprints_agree(spark):
    def weak(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({"fingerprint": [str(len(t)) for t in texts], "bytes": [t.encode() for t in texts]})

    docs = spark.createDataFrame(list(enumerate(["ab", "cd", "ab", "x", "cd", "ef"])), "doc_id long, text string")
    rows = fp.fingerprint_groups(docs, digests=weak).collect()
    assert {r.doc_id: (r.group_id, r.group_size) for r in rows} == {0: (0, 2), 2: (0, 2), 1: (1, 2), 4: (1, 2), 3: (3, 1), 5: (5, 1)}


def test_empty(spark):
    assert fp.edited_fingerprints(empty(spark)).count() == 0 and fp.fingerprint_groups(empty(spark)).count() == 0
