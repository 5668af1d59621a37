"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most three bits have one segment that differs in at most one, so
that segment's one-wildcard variants (one bit left out) meet by equality; the
whole fingerprints are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import _common as C
from tidewater.llm.components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: A segment value with more distinct fingerprints than this is cut once more.
CROWDED = 256
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The SimHash of one text as a signed 64-bit number; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest, n = b" ".join(words), xxhash.xxh64_digest, max(1, len(words) - SHINGLE + 1)
    at, starts, ends = 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    votes = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")
    C.give_back()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _wild(value: Column, bits: int) -> Column:
    """An array of (left-out bit, value without it) for every bit."""

    def without(j: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        return F.struct(j.alias("j"), value.bitwiseAND(F.bitwise_not(bit)).alias("rest"))

    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), without)


def _near() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS


def _halved(side: DataFrame, bits: int) -> DataFrame:
    """A row for each one-wildcard variant k of both halves of the column free (bits wide), with the other half as free."""
    half = bits // 2
    cuts = (F.shiftrightunsigned("free", half), F.col("free").bitwiseAND((1 << half) - 1))

    def variants(s: int) -> Column:
        return F.transform(_wild(cuts[s], half), lambda w: F.struct(F.struct(F.lit(s).alias("s"), w["j"].alias("j"), w["rest"].alias("rest")).alias("k"), cuts[1 - s].alias("free")))

    rest = [c for c in side.columns if c != "free"]
    return side.select(*rest, F.explode(F.concat(variants(0), variants(1))).alias("v")).select(*rest, "v.k", "v.free")


def _compared(x: DataFrame, y: DataFrame, keys: list[str], bits: int, crowded: int) -> DataFrame:
    """Pairs (a, b) at most MAX_BITS apart of x (keys, a, free) and y (keys, b, free), whose other bits differ by one at most.

    Free bits are halved and met by one-wildcard variants; buckets of more than
    `crowded` are halved again, down to 8 free bits, where a bucket has at most
    2**10 of each side: the 8 bits, and the one left out of each of two cuts.
    """
    level = f"k{bits}"
    x, y = (_halved(side, bits).withColumnRenamed("k", level) for side in (x, y))
    keys = [*keys, level]
    pairs = lambda p, q: p.drop("free").join(q.drop("free"), keys).filter(_near()).select("a", "b").distinct()
    if bits <= 16:
        return pairs(x, y)
    x, y = C.cut(x, "simhash-side"), C.cut(y, "simhash-side")
    many = C.cut(x.select(*keys).unionByName(y.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * crowded).drop("n"), "simhash-crowded")
    if not many.limit(1).count():
        return pairs(x, y)
    few = pairs(x.join(many, keys, "left_anti"), y.join(many, keys, "left_anti"))
    return few.unionByName(_compared(x.join(many, keys, "left_semi"), y.join(many, keys, "left_semi"), keys, bits // 2, crowded))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most MAX_BITS apart.

    Distinct segment values have at most 32 neighbours at one bit, so the
    variant index stays linear in the fingerprints. Fingerprints that share a
    segment value (or have neighbouring ones) are compared; where a value has
    more than `crowded` of them, the other half is cut and indexed the same
    way, again and again (`_compared`), so no crowded group is ever paired
    with itself.
    """
    low = F.lit(0xFFFFFFFF)
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)
    halves = F.array(*(F.struct(F.lit(i).alias("seg"), h.alias("half"), o.alias("other")) for i, (h, o) in enumerate(((upper, lower), (lower, upper)))))
    member = C.cut(fps.select("fp", F.explode(halves).alias("x")).select("fp", "x.*"), "simhash-members")
    # a small table, but 32 rows come of each of its rows: dealt out before that
    values = C.cut(member.groupBy("seg", "half").agg(F.count(F.lit(1)).alias("n")), "simhash-values")
    dealt = values.repartition(C.parts_of(fps.sparkSession), "seg", "half")
    # one-wildcard variants: a bucket holds the value with the bit and the one without it
    one_bit = (
        dealt.select("seg", "half", F.explode(_wild(F.col("half"), 32)).alias("v"))
        .groupBy("seg", "v.j", "v.rest")
        .agg(F.min("half").alias("a_half"), F.max("half").alias("b_half"))
        .filter("a_half < b_half")
        .select("seg", "a_half", "b_half")
    )
    sized = lambda side: values.select("seg", F.col("half").alias(f"{side}_half"), F.col("n").alias(f"n{side}"))
    own = values.filter("n > 1").select("seg", F.col("half").alias("a_half"), F.col("half").alias("b_half"), F.col("n").alias("na"), F.col("n").alias("nb"))
    groups = own.unionByName(one_bit.join(sized("a"), ["seg", "a_half"]).join(sized("b"), ["seg", "b_half"]))
    groups = C.cut(groups, "simhash-groups")
    left = member.select("seg", F.col("half").alias("a_half"), F.col("fp").alias("a"), F.col("other").alias("free"))
    right = member.select("seg", F.col("half").alias("b_half"), F.col("fp").alias("b"), F.col("other").alias("free"))
    is_crowded = F.greatest("na", "nb") > crowded
    few = groups.filter(~is_crowded)
    found = few.join(left.drop("free"), ["seg", "a_half"]).join(right.drop("free"), ["seg", "b_half"]).filter(_near()).select("a", "b")
    if groups.filter(is_crowded).limit(1).count():
        many, keys = groups.filter(is_crowded).drop("na", "nb"), ["seg", "a_half", "b_half"]
        x, y = many.join(left, ["seg", "a_half"]).select(*keys, "a", "free"), many.join(right, ["seg", "b_half"]).select(*keys, "b", "free")
        found = found.unionByName(_compared(x, y, keys, 32, crowded))
    return found.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint, component_id (smallest id reachable).

    Links are searched between distinct fingerprints, so copies cost one row
    each whatever their number. Null and empty texts have fingerprint zero and
    are linked like any other. Repeated rows and ids give a row each. A row
    whose id is null belongs to its component; a component of null ids alone
    has a null component_id. Other columns are not read. An empty table gives
    an empty result.
    """
    C.small_batches(docs.sparkSession)
    rows = C.cut(docs.select(F.col(id_col).alias("id"), F.pandas_udf(_fingerprints, T.LongType())(F.col(text_col)).alias("fp")), "simhash-rows")
    firsts = C.cut(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(firsts.select("fp")))
    firsts = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = C.cut(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    of_fp = C.cut(firsts.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id")
