import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tests.llm.frames import awkward, empty
from tidewater.llm import packing

TEXTS = ["", None, "a", " lead", "trail ", "two  spaces", "tabs\t\tand\n\n lines\n", "x \n y", "  \n", "don't won't I'LL", "é ñ  z", "<|endoftext|> is text", "a <|endoftext|>  <|endoftext|>b", "<|endoftext|>" * 3, "<|endoftext| >", "word " * 3000, "日本語 テキスト", "a\x1cb \x1c c", "x" * 5000]


def test_ids_are_the_tokenizers_librarys():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    rng = random.Random(5)
    for t in [x or "" for x in TEXTS] + ["".join(rng.choices(" \n\tab'sé1!.　", k=60)) for _ in range(400)] + ["".join(rng.choices(["<|endoftext|>", "<|", " ", "\n", "ab"], k=12)) for _ in range(100)]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_round_trip(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = TEXTS + [f"text {i} " * (i % 90) for i in range(300)]
    rows = packing.packed_documents(awkward(spark, texts)).collect()
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) == -(-total // 1024)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_plan_fills_as_full_as_any_subset():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        plan, left = packing.bin_plan(counts, 20), dict(counts)
        for pattern, times in plan:
            for _ in range(times):
                first = max(k for k, v in left.items() if v)
                items = [k for k, v in left.items() for _ in range(v)]
                items.remove(first)
                sums = {first}
                for k in items:
                    sums |= {s + k for s in sums if s + k <= 20}
                assert sum(k * c for k, c in pattern.items()) == max(sums) and pattern[first]
                for k, c in pattern.items():
                    left[k] -= c
        assert not any(left.values())


def test_empty(spark):
    assert packing.packed_documents(empty(spark)).count() == 0


def test_repeated_ids_and_extra_columns(spark):
    rows = [(7, "one two", 1, "x"), (7, "one two", 2, "y"), (None, "three", 3, None), (None, None, 4, None)]
    out = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in out) == [(False, 3), (False, 3), (True, 1), (True, 2)]
    assert {r.sequence_id for r in out} == {0} and sorted(r.offset for r in out)[0] == 0
