import gzip
import hashlib
import io

import pytest

from tests.llm.frames import empty
from tidewater.llm import _common as C
from tidewater.llm import warc

LONG = "<p>é" * 60


def test_round_trip(spark):
    rows = [(1, "http://a/x y", LONG), (2, None, LONG), (3, "http://b/\r\nX: 1", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", LONG + "!"), (0, "u", LONG), (0, "u", LONG), (None, "u", LONG), (9, "u", "z" * 700_000), (9, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark, pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = 0 if html == LONG and i != 0 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)


def test_archives_are_members_of_one_record_each(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30) for i in range(20)], "page_id long, url string, html string")
    paths = [r.path for r in warc.write_warc(pages).collect()]
    texts = []
    for path in paths:
        fs, p = C.open_fs(path)
        with fs.open_input_stream(p, compression=None) as f:
            raw = f.read()
        texts += list(warc.members(io.BytesIO(raw)))
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(list(warc.members(io.BytesIO(raw))))
    assert len(texts) == 20 and all(t.startswith(b"WARC/1.1\r\n") and t.count(b"WARC/1.1") == 1 for t in texts)


def test_damage_is_found():
    raw = warc.encode_record("urn:page:1", "u", b"payload" * 9, hashlib.sha256(b"payload" * 9).hexdigest(), None)
    (text,) = warc.members(io.BytesIO(raw))
    assert warc.decode_record(text)["payload"] == b"payload" * 9
    for bad in (text.replace(b"payload" * 9, b"paYload" + b"payload" * 8), text[:-5], text.replace(b"WARC/", b"XXXX/", 1)):
        with pytest.raises(ValueError):
            warc.decode_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(raw[:-4])))


def test_empty(spark):
    assert warc.warc_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, "u", LONG, "d", 3, "x", "y", b"p") for i in (4, 2, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long, rid string, path string, payload binary")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark, pages).collect())
    assert got == [(2, "response", None), (4, "revisit", 2), (4, "revisit", 2)]
