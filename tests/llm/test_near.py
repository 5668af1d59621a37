import itertools
import random

import corpus_pipeline
from tests.llm.frames import awkward, empty
from tidewater.llm import near


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Texts with single near copies, a chain of edits and one large group of near copies."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(4000)]
    bases = [rng.choices(pool, k=rng.randint(60, 500)) for _ in range(60)]
    texts = [" ".join(b) for b in bases]
    texts += [edited(rng, b, max(1, len(b) // rng.choice([45, 60, 100, 30]))) for b in bases[:40]]
    texts += [edited(rng, bases[50], rng.randint(1, 6)) for _ in range(120)]
    for _ in range(8):
        texts.append(edited(rng, texts[-1].split(), 5))
    rng.shuffle(texts)
    return texts


def brute(texts):
    """Positions of the texts that stay, and all similar pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}, pairs


def test_stage_leaves_one_of_each_component_of_similar_texts(spark):
    texts = corpus()
    stay, pairs = brute(texts)
    assert len(pairs) > 500 and len(stay) < len(texts) - 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == stay


def test_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    close = text.replace("w7 ", "other ")
    rows = [(None, text, None, None, 1), (None, close, "en", "s", 1), (5, "a lone text", "en", "s", 1), (5, "another text with that id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.text for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert len(kept) == 3 and {"a lone text", "another text with that id"} < set(kept)
    # the empty and the null text are one text, of which one row stays
    out = corpus_pipeline.simhash_stage(spark, awkward(spark, ["", None, "x", "a b c d e f", "x"]), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 0), (False, 2), (False, 3), (True, 0)]
    assert near.near_copies(empty(spark)).count() == 0
