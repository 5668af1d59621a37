"""Exact dedup by deterministic block naming, in DataFrame functions alone.

A text is cut into blocks of fixed size. The distinct blocks are sorted into
integer names; then the names of adjacent blocks are paired and the distinct
pairs sorted into names again, level by level, until each text has one name.
Two texts have the same (level, name) exactly when they are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C

BLOCK_BYTES = 8192
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for s in _SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def _block_key(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), block).alias("x"), F.hash(F.lit(salt), block).alias("y"))


def _named(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """keys in sorted order with an increasing integer, kept in a table so that it can't change."""
    return C.cut(keys.orderBy(*cols).withColumn("name", F.monotonically_increasing_id()), name)


def _block_names(blocks: DataFrame, block_key: Callable[[Column, int], Column]) -> tuple[DataFrame, int]:
    """(k, name, n: rows) for the distinct blocks, and the salt with which no two blocks share a key."""
    salt = 0
    while True:
        each = blocks.select(block_key(F.col("block"), salt).alias("k"), "block").groupBy("k", "block").agg(F.count(F.lit(1)).alias("n"))
        names = _named(each.groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")), ["k"], "exact-blocks")
        if not names.filter("blocks > 1").limit(1).count():
            return names.drop("blocks"), salt
        salt += 1


def _identities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row, level, name) for every row: its blocks' names, paired and named anew level by level until one is left."""
    each = rows.select("row", F.posexplode("keys").alias("pos", "k"))
    state = C.cut(C.join_groups(each, names, ["k"], "n").select("row", "pos", "name"), "exact-level")
    done = state.join(rows.filter("size(keys) = 1").select("row"), "row", "left_semi").select("row", F.lit(0).alias("level"), "name")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    counts = rows.select("row", F.size("keys").alias("left"))
    level, even = 0, F.col("pos") % 2 == 0
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        # (left, right) names of adjacent pairs; -1 stands for a missing right one
        a, b = F.min(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.min(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        open_rows = state.join(counts.filter("left > 1"), "row")
        pairs = C.cut(open_rows.groupBy("row", F.floor(F.col("pos") / 2).alias("pos")).agg(a, b), "exact-pairs")
        names = _named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], "exact-names")
        state = C.cut(C.join_groups(pairs, names, ["a", "b"], "n").select("row", "pos", "name"), "exact-level")
        counts = counts.select("row", F.ceil(F.col("left") / 2).cast("int").alias("left"))
        blocks = F.size("keys")
        ready = rows.filter((blocks > 2 ** (level - 1)) & (blocks <= 2**level)).select("row")
        done = done.unionByName(state.join(ready, "row", "left_semi").select("row", F.lit(level).alias("level"), "name"))
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_key: Callable[[Column, int], Column] = _block_key) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Blocks are grouped by their bytes after a hash key; when two different
    blocks share a key, which the grouping shows, all keys are made anew with
    another salt, so that a name stands for one block's bytes only.

    Null and empty texts are equal to each other. Of equal texts the row with
    the most code points stays, then the smallest id (null last); of rows that
    repeat both, one stays. An empty table gives an empty result. Only the two
    named columns are read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = base.withColumn("norm", normalised(F.col("text"))).withColumn("bin", F.col("norm").cast("binary"))
    raw = raw.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bin") / F.lit(block_bytes)).cast("int")))
    places = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    blocks = F.transform(places, lambda i: F.call_function("substring", F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))
    names, salt = _block_names(raw.select(F.explode(blocks).alias("block")), block_key)
    keys = F.transform(blocks, lambda b: block_key(b, salt))
    rows = raw.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.length("text").alias("n_chars"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"),
        keys.alias("keys"),
    )
    rows = C.cut(rows, "exact-rows")
    known = C.cut(rows.drop("keys").join(_identities(rows, names), "row"), "exact-known")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = C.cut(known.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = C.join_groups(known, groups, ["level", "name"], "group_size")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
