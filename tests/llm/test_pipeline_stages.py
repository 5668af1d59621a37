"""Every stage, and run, on awkward rows and against plain Python."""

import zlib

import corpus_pipeline
from tests.llm.frames import awkward, empty
from tidewater.llm import mixing, packing, quality

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, node string, id long, gone_id long, _tokens string, kept string, score double, first_node string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "y", "z", 0.5, "w") for i, t in rows], EXTRA)


def test_no_document_is_lost_and_no_copy_stays_with_repeated_and_null_ids(spark):
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five six seven", "a third text of its own"
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, None), (7, ""), (7, " ")]
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.simhash_stage):
        out = stage(spark, table(spark, rows), "")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in out.collect())
        assert got == [(0, c), (1, a), (5, b), (7, "")], stage


def test_mixing_keeps_rows_of_the_table_and_packing_takes_all(spark):
    rows = [(i % 50, f"text number {i} of many") for i in range(400)] + [(None, None), (3, "")]
    out = corpus_pipeline.mixing_stage(spark, table(spark, rows), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert set(kept) <= set(rows) and 250 < len(kept) <= len(rows)
    want = {(r.doc_id, r.text) for r in mixing.mixed(table(spark, rows), mixing.TARGETS).filter("_kept").collect()}
    assert set(kept) == want
    packed = corpus_pipeline.packing_stage(spark, table(spark, rows), "").collect()
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_quality_stage_keeps_what_its_scores_say(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    more = table(spark, [(None, "|| !! " * 50), (10**9, None), (3, "a lone line of text")]).select(*corpus_pipeline.COLUMNS)
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(more)
    model = quality.fitted(docs, labels)
    rows = docs.collect()
    scores = [float(model.score([quality.encode(r.text)])[0][0]) for r in rows]
    got = sorted(map(str, corpus_pipeline.quality_stage(spark, docs, d).collect()))
    assert got == sorted(str(r) for r, s in zip(rows, scores) if s >= quality.THRESHOLD)


def test_empty_and_awkward_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "/root/testdata/sf0.001").count() == 0, name
        stage(spark, awkward(spark, ["", None, "ok ok", "ok ok", "x " * 30_000]), "/root/testdata/sf0.001").count()


def test_run_against_plain_python(spark):
    """The rows that stay after each stage, made again from the stage's input without Spark's operators."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    model = quality.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.score([quality.encode(t)])[0][0] >= quality.THRESHOLD]
    best = {}
    for i, t in rows:
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, i, t)), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for _, t in rows]
    prints = [simple_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for x in range(len(rows)):
        for y in range(x):
            near = grams[x] and len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y])
            if near or (prints[x] ^ prints[y]).bit_count() <= 3:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").join(docs.drop("text"), "doc_id")
    chance = {(r.doc_id, r.text): r._kept for r in mixing.mixed(table.select(*corpus_pipeline.COLUMNS), mixing.TARGETS).collect()}
    rows = [r for r in rows if chance[r]]
    got = {}
    for r in corpus_pipeline.run(spark, d).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [i for i, _ in rows]
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in rows:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        pieces = sorted(got[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


def simple_simhash(text):
    import xxhash

    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
