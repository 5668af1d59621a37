"""Canonical exact fingerprints: Unicode, case and white space folded, then a wide xxhash."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C

#: So many repeated fingerprints are broadcast, at most.
BROADCAST_ROWS = 200_000
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, content string"


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, NFKC again, runs of white space one space, none at the ends."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: bytes, b: bytes) -> float:
    """1 if two canonical texts have one digest and, byte by byte, one content, else 0."""
    return float(xxhash.xxh3_128_digest(a) == xxhash.xxh3_128_digest(b) and a == b)


def _digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        c = [canonical(t) for t in texts]
        yield pd.DataFrame({"fingerprint": [xxhash.xxh3_128_hexdigest(x) for x in c], "bytes": c})


_digests.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def with_groups(rows: DataFrame, texts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (fingerprint, content, doc_id) with group_id and group_size by canonical text.

    texts has doc_id, fingerprint and bytes of the same rows, made anew where
    it is read. Rows meet by fingerprint first; only bytes of fingerprints that
    come more than once are compared, by grouping them with the fingerprint,
    copies being merged before the shuffle. content, the SHA-256 of the bytes,
    leads a row to its group, so texts that only share a fingerprint stay
    apart. Up to `broadcast_rows` repeated fingerprints are broadcast, more
    are joined by shuffle.
    """
    repeated = C.cut(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "fingerprints-repeated")
    some = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    same = texts.join(some, "fingerprint", "left_semi").groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    groups = C.cut(same.select("fingerprint", F.sha2("bytes", 256).alias("content"), "group_id", "group_size").filter("group_size > 1"), "fingerprint-groups")
    keys = ["fingerprint", "content"]
    alone = rows.join(F.broadcast(groups.select(*keys)) if repeated.count() <= broadcast_rows else groups.select(*keys), keys, "left_anti")
    return C.join_groups(rows, groups, keys, "group_size").unionByName(alone.withColumns({"group_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}))


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, digests=_digests) -> DataFrame:
    """One row per input row: id, fingerprint, group_id (smallest id with the same canonical text), group_size.

    Nulls count as empty texts; a group of null ids has a null group_id.
    Repeated rows count each. An empty table gives an empty result.
    """
    C.small_batches(docs.sparkSession)
    x = F.pandas_udf(digests, "fingerprint string, bytes binary")(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), x.alias("x")).select("doc_id", "x.fingerprint", "x.bytes")
    rows = C.cut(texts.select("doc_id", "fingerprint", F.sha2("bytes", 256).alias("content")), "fingerprints")
    out = with_groups(rows, texts, broadcast_rows)
    return out.select(F.col("doc_id").alias(id_col), "fingerprint", "group_id", "group_size")


def _edit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then as documents follow each other; the last of a bucket is the row after it, already out."""
    held, out = None, []

    def done(cur, nxt):
        i, text, c = cur
        n, half = len(text), len(text) // 2
        edited = text[: n - half] + nxt[1][:half]
        ce = canonical(edited) if half else c
        fp, fe = xxhash.xxh3_128_hexdigest(c), xxhash.xxh3_128_hexdigest(ce)
        return i, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, fe, likeness(c, ce), likeness(c, nxt[2]), hashlib.sha256(c).hexdigest()

    bucket = None
    for batch in rows:
        for b, i, text, edge in zip(*(batch.column(k).to_pylist() for k in range(4))):
            text = text or ""
            now = (i, text, canonical(text))
            if bucket == b and held is not None:
                out.append(done(held, now))
            bucket, held = b, None if edge else now
        yield _result(out)
        out = []


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in EDITED.split(", ")])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its text with the last half replaced by the next document's start; the groups of equal canonical texts.

    Documents follow each other by descending id, null ids last, equal ids by
    a hash of their texts; the first follows the last. They are dealt to ranges
    of these once; the first row of each range also goes to the end of the
    range before it.
    Null texts are empty. A single document follows itself. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    n = C.parts_of(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ranges from a sketch of the ids; how even they are doesn't change the result. An id that takes several ranges, as a
    # missing one may, is divided by the hash of its texts
    rows = rows.withColumn("key", F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie")))
    found = rows.agg(F.percentile_approx("key.id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = []
    for i, times in Counter(found or []).items():
        bounds += [(i, (1 << 63) - 1 - (j + 1) * ((1 << 64) // (times + 1))) for j in range(times)]
    as_key = lambda k: F.struct(F.lit(k[0]).cast("long").alias("id"), F.lit(k[1]).cast("long").alias("tie"))
    above = F.array(*map(as_key, sorted(bounds, reverse=True))) if bounds else F.array().cast("array<struct<id:bigint,tie:bigint>>")
    numbered = rows.withColumn("b", F.size(F.filter(above, lambda x: x > F.col("key"))))
    firsts = {r["b"]: tuple(r["k"]) for r in numbered.groupBy("b").agg(F.max("key").alias("k")).collect()}
    order = sorted(firsts)
    edge = F.lit(None).cast("int")
    if order:  # first key of a bucket -> the bucket before it
        edge = F.element_at(F.create_map(*[x for i, b in enumerate(order) for x in (as_key(firsts[b]), F.lit(order[i - 1]))]), F.col("key"))
    both = F.array(F.struct("b", F.lit(False).alias("edge")), F.struct(edge.alias("b"), F.lit(True).alias("edge")))
    placed = numbered.select("key", "text", "doc_id", F.explode(F.filter(both, lambda x: x["b"].isNotNull())).alias("x"))
    dealt = placed.select("x.b", "x.edge", "key", "doc_id", "text").repartitionById(max(order, default=0) + 1, F.col("b").cast("int"))
    edited = C.cut(dealt.sortWithinPartitions("b", "edge", F.desc("key"), "text").select("b", "doc_id", "text", "edge").mapInArrow(_edit, EDITED), "fingerprints")
    C.free_shuffles(spark)  # whole texts, of no use any more
    x = F.pandas_udf(_digests, "fingerprint string, bytes binary")(F.col("text"))
    return with_groups(edited, rows.select("doc_id", x.alias("x")).select("doc_id", "x.fingerprint", "x.bytes")).drop("content")
