"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import _common as C

SHARDS = 40
#: The modulus 2^31 - 1 and two numbers below it for each round.
PRIME = 2147483647
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (214013, 2531011), (22695477, 907633385), (69069, 362437), (134775813, 521288629))


def _mix(x: Column, k: Column, c: Column) -> Column:
    """A round function that fits 64-bit arithmetic: two affine steps around a square, modulo PRIME."""
    u = ((x % PRIME) * k + c) % PRIME
    return (u * u + k) % PRIME


def _sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permuted(x: Column, n: int) -> Column:
    """One pass of the Feistel network over [0, a*b), a*b >= n and a*b - n < a; a bijection.

    The value is (left, right) with left < a, right < b; rounds add a mix of
    one half to the other, modulo that half's size.
    """
    a, b = _sides(n)
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"), F.lit(i % 2 == 0).alias("on_left")) for i, (k, c) in enumerate(ROUNDS)])

    def step(v: Column, r: Column) -> Column:
        on, mix = r["on_left"], _mix(F.when(r["on_left"], v["right"]).otherwise(v["left"]), r["k"], r["c"])
        return F.struct(F.when(on, (v["left"] + mix) % a).otherwise(v["left"]).alias("left"), F.when(on, v["right"]).otherwise((v["right"] + mix) % b).alias("right"))

    # a fold keeps the expression small; written out, it would double with each round
    start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("left"), (x % F.lit(b).cast("long")).alias("right"))
    return F.aggregate(keys, start, step, lambda v: v["left"] * b + v["right"])


def walked(x: Column, n: int, steps: int) -> Column:
    """The permutation of [0, n): passes until the value is below n, at most `steps` in all."""
    again = lambda v: F.when(v < n, v).otherwise(permuted(v, n))
    return F.aggregate(F.sequence(F.lit(2), F.lit(max(2, steps))), permuted(x, n), lambda v, _: again(v))


def permuted_number(x: int, n: int) -> int:
    """`permuted` for one number on the driver."""
    a, b = _sides(n)
    left, right = divmod(x, b)
    for i, (k0, k1) in enumerate(ROUNDS):
        u = ((right if i % 2 == 0 else left) % PRIME * k0 + k1) % PRIME
        u = (u * u + k0) % PRIME
        left, right = ((left + u) % a, right) if i % 2 == 0 else (left, (right + u) % b)
    return left * b + right


def walk_steps(n: int) -> int:
    """Passes that bring every row number below n.

    A walk leaves [0, n) only through the numbers in [n, a*b), fewer than
    sqrt(n) + 1 of them, so they are followed here.
    """
    a, b = _sides(n)
    follow = {x: permuted_number(x, n) for x in range(n, a * b)}
    longest = 0
    for x in set(follow) - set(follow.values()):  # where walks from below n come in
        steps = 0
        while x >= n:
            x, steps = follow[x], steps + 1
        longest = max(longest, steps)
    return longest + 1


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law 'rows', shard, slot, grown_shard (null).

    Rows are numbered by id (null last), then text size and crc32, so the same
    rows get the same places however they are stored; rows alike in all of
    these are interchangeable. Number p of the permutation goes to shard
    p mod shards at slot p div shards: counts differ by one at most and a
    row's place needs only its number. Null text counts as empty with size 16.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    ranged = C.cut(narrow.repartitionByRange(max(C.parts_of(spark), 1), *order).withColumn("part", F.spark_partition_id()), "shard-rows")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = C.cut(counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "shard-offsets")
    n = offsets.agg(F.sum("rows")).first()[0] or 0
    numbered = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(offsets, "part")
    place = walked(F.col("before") + F.col("k") - 1, n, walk_steps(n)) if n else F.lit(0).cast("long")
    return numbered.withColumn("place", place).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
