"""The registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import crf, exact, fingerprints, mixing, packing, quality, sharding, simhash, substrings, warc
from tidewater.llm._common import crc_mod, lead


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(lead(spark, "documents", sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, lead(spark, "pages", sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(lead(spark, "documents", sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(lead(spark, "documents", sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(lead(spark, "documents", sf_dir), mixing.TARGETS, columns=("doc_id",))
    return out.select("doc_id", *(F.col(c).alias(c[1:]) for c in out.columns if c != "doc_id"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(lead(spark, "documents", sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crf.toxicity(lead(spark, "documents", sf_dir), lead(spark, "labels", sf_dir))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), crf.FOLDS) == crf.HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(lead(spark, "documents", sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(lead(spark, "documents", sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(lead(spark, "documents", sf_dir), lead(spark, "labels", sf_dir))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "passages")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_packing, op4_exact_dedup, op5_mixing, op6_fingerprints, op7_toxicity, op8_substrings, op9_sharding, op10_quality)}

#: In plain SQL, where it has what a result needs; the others have brute-force tests.
ORACLE_SQL = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op4_exact_dedup": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
    # bytes as pairs of hex digits; a removed run is a chain of repeated strings, each within 50 bytes of the one before
    "op8_substrings": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p JOIN m USING (s) WHERE doc_id > least),
n AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM sp),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
