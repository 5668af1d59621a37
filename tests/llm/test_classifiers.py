import itertools
import math
import zlib

import numpy as np

from tests.llm.frames import awkward, empty
from tidewater.llm import crf, quality

DATA = "/root/testdata/sf0.01"


def accuracy(rows, labels, fold, held):
    got = {r.doc_id: r for r in rows}
    held_ids = [i for i in labels if zlib.crc32(str(i).encode()) % fold == held]
    pos = [got[i].score for i in held_ids if labels[i] == 1]
    neg = [got[i].score for i in held_ids if labels[i] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return auc, np.mean([got[i].predicted == labels[i] for i in held_ids])


def test_chain_marginals_against_all_paths():
    model = crf.Model()
    model.start, model.trans = -0.7, np.array([[0.3, -1.0], [0.2, 0.9]])
    rng = np.random.default_rng(1)
    seqs = [rng.normal(size=n) for n in (1, 4, 6, 2, 0)]
    f, b = crf.forward_backward(model, seqs)
    for s, x, y in zip(seqs, f, b):
        mass = np.zeros((len(s), 2))
        for path in itertools.product((0, 1), repeat=len(s)):
            e = sum(v * k for v, k in zip(s, path)) + (model.start * path[0] if path else 0) + sum(model.trans[p, q] for p, q in zip(path, path[1:]))
            for t, k in enumerate(path):
                mass[t, k] += math.exp(e)
        assert np.allclose(1 / (1 + np.exp(-(x + y))), mass[:, 1] / mass.sum(1) if len(s) else [])


def test_runs_of_any_length_give_the_same():
    model = crf.Model()
    model.start, model.trans = -0.7, np.array([[0.3, -1.0], [0.2, 2.9]])
    rng = np.random.default_rng(6)
    seqs = [rng.normal(-3, 4, size=n) for n in (1, 400, 0, 37, 36, 2000, 72)]
    whole = crf.forward_backward(model, seqs, 10_000)
    for run in (1, 36, 128):
        for a, b in zip(whole, crf.forward_backward(model, seqs, run)):
            assert all(np.allclose(x, y) for x, y in zip(a, b))


def test_features_by_kind_are_the_features():
    model = crf.Model()
    rng = np.random.default_rng(7)
    words = ["Idiot", "the", "THE", "idiots", "Ab", "x"]
    model.weights = {f: float(rng.normal()) for w in words for f in [*crf.features(w), *crf.beside(w)] if rng.random() < 0.7}
    e = crf.Emissions(model)
    for w in words:
        want = (sum(model.weights.get(f, 0.0) for f in crf.features(w)), *(model.weights.get(f, 0.0) for f in crf.beside(w)))
        assert np.allclose(e.known[e[w]], want)


def test_no_tag_against_all_paths_and_gradient():
    texts = ["Good day to all", "you Foul thing you foul", "a day", "foul FOUL", "thing of the day good", "all foul day"]
    sample = crf.Sample(texts * 3, [0, 1, 0, 1, 0, 1] * 3)
    rng = np.random.default_rng(2)
    params = rng.normal(0, 0.7, len(sample.names) + 6)
    weight = rng.uniform(0.5, 2, len(sample.labels))
    _, grad = sample.likelihood(params, weight, crf.Model())
    for i in rng.choice(len(params), 12, replace=False).tolist() + list(range(len(params) - 6, len(params))):
        up, down = params.copy(), params.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (sample.likelihood(up, weight, crf.Model())[0] - sample.likelihood(down, weight, crf.Model())[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-4 * max(1, abs(slope)), i
    model = crf.Model()
    model.bias, model.start, model.trans = -0.4, 0.3, np.array([[0.2, -0.6], [0.5, 0.9]])
    model.weights = {"w=foul": 1.5, "before=you": 0.7, "after=thing": -0.4, "h=mixed": 0.2, "p4=thin": 0.3}
    for t, (_, clean) in zip(texts, crf.tagged(model, texts)):
        (s,) = crf.Emissions(model).of([t.split()])
        mass = [sum(v * k for v, k in zip(s, path)) + model.start * path[0] + sum(model.trans[p, q] for p, q in zip(path, path[1:])) for path in itertools.product((0, 1), repeat=len(s))]
        assert np.isclose(clean, mass[0] - np.logaddexp.reduce(mass))
    assert crf.tagged(model, ["", None])[0][1] == 0.0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = crf.toxicity(docs, labels).collect()
    auc, right = accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}, crf.FOLDS, crf.HELD_OUT)
    assert auc > 0.9 and right > 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {texts[r.doc_id][s.start : s.end].lower() for r in rows for s in r.spans}
    assert "idiot" in words and "the" not in words


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.quality(docs, labels).collect()
    auc, right = accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}, quality.FOLDS, quality.HELD_OUT)
    assert auc > 0.95 and right > 0.9
    assert all(abs(sum(r.attention) - 1) < 1e-3 and len(r.attention) == r.passages for r in rows)


def test_attention_gradient_against_differences():
    rng = np.random.default_rng(4)
    model = quality.Model(3)
    bags = [quality.encode("".join(rng.choice(list("ab é!|"), n))).astype(float) for n in (0, 5, 700, 1900, 3000)]
    assert [len(b) for b in bags] == [1, 1, 2, 4, 5]
    x, starts, of = quality._joined(bags)
    y, weight = np.array([0, 1, 1, 0, 1.0]), rng.uniform(0.5, 1.5, 5)

    def loss():
        s = model.forward(x, starts, of)["score"]
        return -(weight * np.where(y == 1, np.log(s), np.log(1 - s))).sum()

    grad = model.gradient(x, starts, of, y, weight)
    used = np.flatnonzero(x[:, :-1].sum(0))
    for name, g in grad.items():
        p = model.p[name]
        for _ in range(6):
            at = tuple(rng.choice(used) if name == "W" and d == 0 else rng.integers(n) for d, n in enumerate(p.shape))
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            slope = (up - loss()) / 2e-5
            p[at] = keep
            assert abs(slope - g[at]) < 1e-6 + 1e-4 * abs(slope), (name, at)


def test_passages_cover_the_text():
    for text in ("", None, "é" * 1300, "x" * 600, "x" * 601, "日本" * 5000 + "a", "w " * 600_000):
        x = quality.encode(text)
        assert len(x) == max(1, -(-len(text or "") // quality.PASSAGE))
        assert np.allclose((x[:, :-1] ** 2).sum(1), 1 if text else 0, atol=1e-3) and (x[:, -1] < 1).all()
    texts, labels = ["GOOD " * 300, "bad!! " * 300, "fine text " * 200, "!!" * 900], [1, 0, 1, 0]
    score, _ = quality.train(texts, labels, rounds=200).score([quality.encode(t) for t in texts])
    assert ((score > 0.5) == np.array(labels)).all()


def test_awkward_rows(spark):
    docs = awkward(spark, ["", None, "ok", "ok", "x " * 100_000])
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for rows in (crf.toxicity(docs, labels).collect(), quality.quality(docs, labels).collect()):
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert crf.toxicity(empty(spark), labels).count() == 0 and quality.quality(empty(spark), labels).count() == 0
