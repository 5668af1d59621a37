"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All stages but the last
return the columns of `documents`, whatever other columns docs has; a column
that docs lacks is null. Null texts are empty, an empty table gives an empty
result, and rows are decided by id and text together, so a null or repeated id
loses no other row and saves no copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import _common as C
from tidewater.llm import exact, mixing, near, packing, quality

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}

#: Chunks that the tokenizer remembers; fewer than where packing runs alone, as executors hold other stages' memory too.
CACHED = 100_000


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def _one_of_each_text(docs: DataFrame, first: DataFrame) -> DataFrame:
    """One row of docs (with its text's key, node) for each node of first (node, id): the one with that id, one of those that repeat it."""
    same = (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    kept = docs.join(first.select(F.col("node").alias("first_node"), F.col("id").alias("first_id")), same, "left_semi")
    return kept.dropDuplicates(["node"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each by its text alone; empty texts have a score like any other."""
    model = quality.fitted(docs, C.lead(spark, "labels", sf_dir))
    return _documents(docs.filter(quality.score_udf(model)(F.col("text")) >= quality.THRESHOLD))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest as it stands, then the smallest id (null last); of rows that repeat both, one."""
    docs = _documents(docs)
    key = near.text_key(F.col("text"))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), key.alias("node")).alias("id"), "text")
    groups = C.cut(exact.exact_groups(keyed, "id"), "exact-decisions")
    rows = groups.groupBy("id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    repeated = bool(rows.filter("kept and n > 1").limit(1).count())
    gone = rows.filter("not kept").select(F.col("id.doc_id").alias("gone_id"), F.col("id.node").alias("gone_node"))
    out = docs.withColumn("node", key).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")), "left_anti")
    return (out.dropDuplicates(["doc_id", "node"]) if repeated else out).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null last) of each component of SimHash links and of texts that share 0.8 of their five-word shingles; rows of one text are a component."""
    docs = _documents(docs).withColumn("node", near.text_key(F.col("text")))
    out = docs.join(C.cut(near.near_copies(docs), "near-copies"), "node", "left_anti")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("least")
    texts = C.cut(docs.groupBy("node").agg(least, F.count(F.lit(1)).alias("n")).select("node", "least.id", "n"), "near-counts")
    repeated = texts.filter("n > 1")  # none after the exact stage
    if repeated.limit(1).count():
        alone = out.join(repeated.select("node"), "node", "left_anti")
        out = alone.unionByName(_one_of_each_text(out, repeated))
    return out.select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows sampled to the target weights of sources, languages and topics; rows alike in id and text share their fate."""
    return _documents(mixing.mixed(_documents(docs), mixing.TARGETS).filter("_kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in sequences of one length; an empty text is the one id that ends a document."""
    return packing.packed_documents(docs, cached=CACHED)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; a stage's own tables are deleted when the next one has been written."""
    docs, earlier = C.lead(spark, "documents", sf_dir), []
    for name, stage in STAGES:
        start = C.mark()
        docs = C.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        made = C.since(start)
        C.release(spark, [*made[:-1], *earlier])  # the last is the stage's result
        earlier = made[-1:]
        C.free_shuffles(spark)
    return docs
