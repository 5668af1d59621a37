"""The registered queries on a whole small table: contract columns and types, and values made again in plain Python or DuckDB."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_fingerprints import fp
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substrings import brute
from tidewater.llm import queries, sharding

DATA = "/root/testdata/sf0.001"
TYPES = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_mixing": {"doc_id": "bigint", "probability": "double", "kept": "boolean"},
    "op6_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_substrings": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def of(name):
        if name not in made:
            df = queries.QUERIES[name](spark, DATA)
            made[name] = (dict(df.dtypes), df.collect())
        return made[name]

    return of


@pytest.mark.parametrize("name", queries.QUERIES)
def test_contract_columns(result, texts, name):
    types, rows = result(name)
    assert TYPES[name].items() <= types.items()
    if name not in ("op2_warc", "op3_packing"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(result, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in result(name)[1])


def test_simhash(result, texts):
    want = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(want)
    for r in result("op1_simhash")[1]:
        assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", roots[r.doc_id])


def test_fingerprints(result, texts):
    order = sorted(texts, reverse=True)
    same = {}
    for i, t in texts.items():
        same.setdefault(fp.canonical(t), []).append(i)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in result("op6_fingerprints")[1]:
        t, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = t[: n - n // 2] + texts[after[r.doc_id]][: n // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == fp.fingerprint(t)
        group = same[fp.canonical(t)]
        assert (r.group_id, r.group_size) == (min(group), len(group)) and r.near_edited == float(fp.canonical(edited) == fp.canonical(t))


@pytest.mark.parametrize(("name", "mod", "held"), [("op7_toxicity", 4, 2), ("op10_quality", 5, 0)])
def test_folds(result, name, mod, held):
    for r in result(name)[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_substrings(result, texts):
    order = sorted(texts)
    gone = dict(zip(order, brute([texts[i].encode() for i in order])))
    for r in result("op8_substrings")[1]:
        raw, g = texts[r.doc_id].encode(), gone[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(raw), sum(g)) and r.n_spans == len([1 for x, y in zip([0, *g], g) if y > x])
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, x in zip(raw, g) if not x)).hexdigest()


def test_sharding_by_number(result, texts):
    n = len(texts)
    for k, r in enumerate(sorted(result("op9_sharding")[1], key=lambda r: r.doc_id)):
        place = sharding.permuted_number(k, n)
        while place >= n:
            place = sharding.permuted_number(place, n)
        raw = texts[r.doc_id].encode()
        assert (r.shard, r.slot, r.size, r.text_crc32) == (place % 40, place // 40, len(raw) + 16, zlib.crc32(raw))


def test_packing_is_close(result, texts):
    rows = result("op3_packing")[1]
    ids = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-ids // 1024) * 1.02 + 1
    assert {r.doc_id for r in rows} == set(texts) and ids == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert np.all([r.length <= 1024 for r in rows])
