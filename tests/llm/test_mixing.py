import numpy as np

from tests.llm.frames import awkward, empty
from tidewater.llm import mixing, queries


def test_raking_reaches_the_marginals():
    rng = np.random.default_rng(7)
    cells = rng.uniform(1, 9, (4, 3, 2))
    index = [g.ravel() for g in np.indices(cells.shape)]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    mass = mixing.raked(cells.ravel(), index, targets)
    for at, want in zip(index, targets):
        assert np.allclose(np.bincount(at, mass) / mass.sum(), want)
    odds = np.log(mass.reshape(cells.shape) / cells)  # a sum of one term for each axis
    assert np.allclose(odds[1, 1, 1] - odds[0, 1, 1], odds[1, 0, 0] - odds[0, 0, 0])


def test_sampling_follows_the_targets(spark):
    rows = [(i, "w " * 50, ("en", "de")[i % 5 == 0], ("a", "b")[i % 3 == 0]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}, keep=0.3).filter("_kept").collect()
    for axis, value in (("source", "a"), ("lang", "de")):
        assert abs(sum(r[axis] == value for r in out) / len(out) - 0.5) < 0.04
    assert abs(len(out) / 6000 - 0.3) < 0.03


def reached(rows, axis):
    kept = {}
    for r in rows:
        kept[r[axis]] = kept.get(r[axis], 0) + r["_tokens"] * r["_probability"]
    return {v: n / sum(kept.values()) for v, n in kept.items()}


def test_bounded_chances_reach_the_targets_at_the_production_keep(spark, caplog):
    # a hot source and uneven languages and topics: many cells' weight times KEEP is above 1
    rows = [(i, "w " * 50, ("en", "en", "en", "de")[i % 4], "hot" if i % 3 == 0 else f"s{i % 7}", ("t0", "t1")[i % 5 < 2]) for i in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    have = {f"s{k}": 2 / 21 for k in range(7)} | {"hot": 1 / 3}
    source = {s: 0.25 if s == "hot" else 0.75 / 7 for s in have}
    targets = {"source": source, "lang": {"en": 0.7, "de": 0.3}, "topic": {"t0": 0.55, "t1": 0.45}}
    out = mixing.mixed(docs, targets).collect()
    assert max(r["_weight"] for r in out) * mixing.KEEP > 1 and max(r["_probability"] for r in out) <= 1
    assert abs(sum(r["_tokens"] * r["_probability"] for r in out) / sum(r["_tokens"] for r in out) - mixing.KEEP) < 1e-5
    for axis, wanted in targets.items():
        got = reached(out, f"_{axis}")
        assert all(abs(got[v] - wanted[v]) < 1e-5 for v in wanted), axis
    assert not caplog.records


def test_a_target_out_of_reach_is_stated_and_the_others_share_the_rest(spark, caplog):
    rows = [(i, "w " * 50, ("en", "de")[i % 2], "rare" if i % 50 == 0 else ("a", "b", "b")[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed(docs, {"source": {"rare": 0.2, "a": 0.3, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}).collect()
    got = reached(out, "_source")
    assert abs(got["rare"] - 0.02 / 0.8) < 1e-4 and abs(got["a"] / got["b"] - 0.6) < 1e-3
    assert abs(reached(out, "_lang")["en"] - 0.5) < 1e-3
    assert "source rare 0.2000 -> 0.0250" in caplog.text and "up to keep 0.100" in caplog.text


def test_query_reaches_its_targets_and_states_them(spark):
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.1").collect()
    tokens = sum(r.tokens for r in rows)
    for axis in mixing.AXES:
        have, kept, sure = {}, {}, {}
        for r in rows:
            v = r[axis]
            have[v] = have.get(v, 0) + r.tokens
            sure[v] = sure.get(v, 0) + r.tokens * r.probability
            kept[v] = kept.get(v, 0) + r.tokens * r.kept
        for r in rows:
            v = r[axis]
            assert abs(r[f"{axis}_present"] - have[v] / tokens) < 1e-9 and abs(r[f"{axis}_reached"] - sure[v] / sum(sure.values())) < 1e-9
            assert abs(r[f"{axis}_reached"] - r[f"{axis}_target"]) < 0.005, (axis, v, r[f"{axis}_target"], r[f"{axis}_reached"])
        wanted = mixing.TARGETS.get(axis) or {v: n**mixing.ALPHA / sum(x**mixing.ALPHA for x in have.values()) for v, n in have.items()}
        assert all(abs(kept[v] / sum(kept.values()) - wanted[v]) < 0.02 for v in have)
    assert abs(sum(r.tokens * r.probability for r in rows) / tokens - mixing.KEEP) < 1e-3 and abs(sum(r.kept * r.tokens for r in rows) / tokens - mixing.KEEP) < 0.02


def test_topics(spark):
    texts = ["All Rights Reserved, LICENSE", "call a@b or phone", "a | b", "plain", None, "license a@b"]
    got = {r.doc_id: r._topic for r in mixing.mixed(awkward(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == ["legal", "contact", "listing", "general", "general", "legal"]


def test_clashing_columns_are_replaced(spark):
    names = ["_weight", "_probability", "_tokens", "_topic", "_kept", "_draw", "doc", "t", "_source_target"]
    docs = spark.createDataFrame([(i, f"a b {i}", *["x"] * len(names)) for i in range(20)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mixed(docs)
    assert len(set(out.columns)) == len(out.columns) and out.count() == 20
    assert {(r._tokens, r._topic, r._draw, r.doc, r.t) for r in out.collect()} == {(3, "general", "x", "x", "x")}


def test_awkward_rows(spark):
    rows = mixing.mixed(awkward(spark, ["", None, "a b", "a b", "x" * 200_000])).collect()
    assert len(rows) == 6 and all(0 <= r["_probability"] <= 1 and r["_kept"] is not None for r in rows)
    assert {r.doc_id: r["_tokens"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 1, None: 8}
    assert mixing.mixed(empty(spark)).count() == 0


def test_cells_joined_by_shuffle_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pick = lambda: sorted((r.doc_id, r._probability, r._kept) for r in mixing.mixed(docs).select("doc_id", "_probability", "_kept").collect())
    sent = pick()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert pick() == sent
