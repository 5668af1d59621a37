import itertools

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_exact_stage_with_null_and_repeated_ids(spark):
    texts = ["a b", "ab", " a b", "other text", None, "", "x y z"]
    rows = [(i, t) for i, t in itertools.product([None, 3, 3, 1], texts)] + [(7, "alone"), (7, "also alone"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    best = {}
    for i, t in rows:
        norm = "".join((t or "").split())
        best[norm] = min(best.get(norm, (0, True, 0)), (-len(t or ""), i is None, i or 0))
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.exact_stage(spark, docs, "").collect()]
    assert len(got) == len(best)
    assert {"".join(t.split()): (-len(t), i is None, i or 0) for i, t in got} == best
