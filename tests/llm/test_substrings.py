import random

from tests.llm.frames import awkward, empty
from tidewater.llm import substrings


def brute(texts):
    seen, out = set(), []
    for raw in texts:
        gone, own = bytearray(len(raw)), set()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            own.add(s)
            if s in seen:
                gone[i : i + 50] = b"\x01" * 50
        seen |= own
        out.append(gone)
    return out


def check(spark, texts, **kw):
    rows = {r.doc_id: r for r in substrings.without_repeats(awkward(spark, texts).repartition(3), **kw).collect()}
    assert len(rows) == len(texts) + 1
    raws = [(t or "").encode() for t in texts]
    for i, (raw, gone) in enumerate(zip(raws, brute(raws))):
        want = bytes(b for b, g in zip(raw, gone) if not g)
        assert bytes(rows[i].kept) == want, i
        covered = sum(s.end - s.start for s in rows[i].spans)
        assert covered == sum(gone) and rows[i].n_bytes == len(raw)
        assert all(a.end < b.start for a, b in zip(rows[i].spans, rows[i].spans[1:]))


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(12)]
    texts = ["", None, "x" * 49, "x" * 50, "x" * 51, "ab" * 60, "ba" * 60, passages[0], passages[0], passages[0][3:], "é" * 40, "é" * 40]
    for _ in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 40) : rng.randint(60, 150)] if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 7))]
        texts.append(rng.choice(["", " "]).join(parts))
    long = " ".join(word() for _ in range(60_000))
    texts += [long, "q" + long[1000:200_000] + "q"]
    check(spark, texts, batch_bytes=2000)


def test_large_batches(spark):
    rng = random.Random(10)
    line = "".join(rng.choices("abcdef ", k=400))
    texts = [line[rng.randint(0, 300) :] + str(i) + line[: rng.randint(0, 200)] for i in range(200)]
    check(spark, texts)


def test_same_ids_are_not_originals(spark):
    t = "y" * 20 + "z" * 60
    rows = substrings.without_repeats(spark.createDataFrame([(1, t), (1, t), (None, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 9, len(r.kept)) for r in rows) == [(1, 80), (1, 80), (9, 0), (9, 0)]


def test_empty(spark):
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_one_passage_in_every_document_and_large_ids(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(25))
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 15))), passage[rng.randint(0, 3) :], *(word() for _ in range(rng.randint(0, 15)))]) for _ in range(150)]
    ids = sorted(rng.sample(range(1 << 62), len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for size in (1500, 1 << 20):  # many batches; one batch, where the passage's names are hot
        rows = {r.doc_id: bytes(r.kept) for r in substrings.without_repeats(docs.repartition(3), batch_bytes=size).collect()}
        for i, t, gone in zip(ids, texts, brute([t.encode() for t in texts])):
            assert rows[i] == bytes(b for b, g in zip(t.encode(), gone) if not g)


def test_packed_numbers():
    import numpy as np

    for v in ([0], [5, 5, 7], [0, 255, 256, 1 << 40], [(1 << 64) - 1]):
        v = np.array(v, np.uint64)
        assert (substrings._from_gaps(substrings._gaps(v)) == v).all()
        assert (substrings._from_bytes(substrings._cut_bytes(v)) == v).all()
    places = substrings._place(np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)), 7)
    assert places.min() == 0 and places.max() == 6 and (np.diff(places) >= 0).all()
