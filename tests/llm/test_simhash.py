import itertools
import random

import xxhash

from tests.llm.frames import awkward, empty
from tidewater.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Ab", "cé", "dd", "EE", "f", "gg\x0bh", " x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(120)] + ["", None, "  \t", "one", "one two", "A b C", "a B c", "w " * 40_000]
    docs = awkward(spark, texts)
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts[:-1])} | {len(texts) - 1: brute_fingerprint(texts[-1][:9])}
    want = brute_components(fps)
    assert len(got) == len(texts) + 1
    for i in fps:
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == want[i]
    assert got[None].component_id is None


def test_links_find_every_pair_also_in_crowded_segments(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    base = rng.getrandbits(64)
    fps |= {base ^ i for i in range(80)}  # one crowded half
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowded in (5, 1000):
        got = [(r.a, r.b) for r in simhash.links(df, crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
