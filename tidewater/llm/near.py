"""Near copies: pairs of texts with a Jaccard similarity of word shingles of 0.8 or more.

Candidates share one of BANDS keys of ROWS minimum hashes each: a pair at 0.8
is missed with a probability of (1 - 0.8**5)**30, about 7 in a million, a more
similar one less often. Every candidate is checked on its whole shingle sets.
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
from tidewater.llm import simhash
from tidewater.llm.components import components

SEED, SHINGLE, SIMILARITY, BANDS, ROWS = 42, 5, 0.8, 30, 5
#: Below this share of equal minimum hashes a pair isn't compared; one at 0.8 is five standard deviations above.
LIKELY = 0.636
#: So many text keys are broadcast, at most, to pick texts.
BROADCAST_ROWS = 200_000
#: Width of a class of sizes, as a factor.
CLASS = 1.02
#: Room for the rounding of bounds.
_SLACK = 1e-6
_CHUNK = 256
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    last = max(1, len(words) - SHINGLE + 1)
    ends = starts[min(SHINGLE, len(words)) :] - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[:last].tolist())], np.uint64))


def sketch(text: str | None) -> tuple[int, list[int], bytes]:
    """(number of shingles, a key for each band of ROWS minimum hashes, a byte of each minimum hash); no words: 0, no keys, no bytes."""
    own = shingles(text)
    if not len(own):
        return 0, [], b""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _CHUNK):
        least = np.minimum(least, (own[k : k + _CHUNK, None] * _FACTORS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), SEED) - (1 << 63) for b in least.reshape(BANDS, ROWS)]
    return len(own), keys, least.astype(np.uint8).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([sketch(t) for t in texts], columns=["size", "keys", "least"])
    C.give_back()


_sketches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def _shingle_lists(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def _likely(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the share of equal minimum hashes is above LIKELY."""
    n = BANDS * ROWS
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, n) for v in (left, right))
    return pd.Series((x == y).sum(axis=1) > LIKELY * n)


def _similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        out, text, own = [], None, None
        for a, b in zip(left, right):
            if text is None or a != text:
                text, own = a, shingles(a)
            out.append(jaccard(own, shingles(b)) >= SIMILARITY)
        yield pd.Series(out, dtype=bool)
        text = own = out = None
    C.give_back()


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts with these keys, one for each."""
    nodes = C.cut(nodes.distinct(), "near-asked")
    some = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    return C.cut(texts.join(some, "node", "left_semi").dropDuplicates(["node"]), "near-texts")


def _checked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar: first by their sketches, the likely ones by their whole shingle sets."""
    spark = pairs.sparkSession
    start = C.mark()
    side = lambda of, side, col: of.select(F.col("node").alias(side), F.col(col).alias(f"{col}_{side}"))
    likely = F.pandas_udf(_likely, T.BooleanType())("least_a", "least_b")
    both = pairs.distinct().join(side(sketches, "a", "least"), "a").join(side(sketches, "b", "least"), "b")
    pairs = C.cut(both.filter(likely).select("a", "b"), "near-candidates")
    C.free_shuffles(spark)
    own = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts)
    C.free_shuffles(spark)
    both = pairs.join(side(own, "a", "text"), "a").join(side(own, "b", "text"), "b")
    used = C.since(start)
    found = C.cut(both.filter(F.pandas_udf(_similar, T.BooleanType())("text_a", "text_b")).select("a", "b"), "near-pairs")
    C.release(spark, used)
    C.free_shuffles(spark)
    return found


def _ordered(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, s, at): the shingles that several of the nodes have, and their places when a text's shingles are ordered by how many nodes have them, rarest first."""
    own = _texts_of(nodes, texts).select("node", F.pandas_udf(_shingle_lists, "array<long>")("text").alias("shingles"))
    own = C.cut(own, "near-shingles")
    each = own.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    known = C.cut(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared")
    lists = each.join(known, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("x"))
    # those that no other node has come first and can't meet any
    placed = lists.select("node", "size", F.posexplode("x").alias("k", "x"), (F.col("size") - F.size("x")).alias("lone"))
    return placed.select("node", "size", F.col("x.s").alias("s"), (F.col("lone") + F.col("k")).alias("at"))


def _apart(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in buckets' different components, one of which stands apart from its bucket's center, that can be similar.

    An exact prefix filter: two similar texts share so many shingles that they
    have one in common among the rarest of each; how many of these matter
    depends on both sizes, so texts meet by shingle and class of sizes, and the
    places of the shared shingle bound the similarity once more. A text that
    differs too much from a large group's center has too many shingles that
    are rarer than the group's, and meets none of its members.
    """
    s = SIMILARITY / (1 + SIMILARITY)  # of both sizes, what two similar texts share
    rows = named.join(named.filter("apart").select("band", "key").distinct(), ["band", "key"], "left_semi").filter("apart or node != rep")
    state = C.cut(rows.groupBy("node").agg(F.max("apart").alias("apart"), F.min("root").alias("root")), "near-apart")
    tokens = _ordered(state.select("node"), texts).join(state, "node")
    size, at = F.col("size"), F.col("at")
    class_of = lambda n: F.floor(F.ln(F.greatest(n, F.lit(1.0))) / F.lit(np.log(CLASS)))
    tokens = C.cut(tokens.filter(at <= size - SIMILARITY * size + _SLACK), "near-prefixes")
    small = tokens.filter(at <= size - 2 * s * size + _SLACK).withColumn("class", class_of(size))
    most = F.least(size, (size - at + _SLACK) / s - size)  # size of the smaller text, as far as this place allows
    large = tokens.withColumn("class", F.explode(F.sequence(class_of(SIMILARITY * size - _SLACK), class_of(most))))
    side = lambda rows, x: rows.select("s", "class", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "at", "root")))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        ordered = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") < F.col("node_y")))
        shared = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
        possible = (F.col("root_x") != F.col("root_y")) & ordered & (shared + _SLACK >= s * (F.col("size_x") + F.col("size_y")))
        x, y = side(x, "x"), side(y, "y")
        return x.join(y, (x.s == y.s) & (x["class"] == y["class"]) & possible).select("node_x", "node_y")

    pairs = met(small.filter("apart"), large).unionByName(met(small.filter("not apart"), large.filter("apart")))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def near_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b), a < b, of text keys that join all similar texts; not every pair of a component has a link of its own.

    The members of a bucket are first compared with its most central one, which
    shares buckets with most texts: of a text and its edited copies that is the
    text, the same in all their buckets, so a group of near copies costs about
    its size. Those that end in another component are then compared with all
    such buckets' members that aren't in theirs and that they can be similar to
    (`_apart`), so that no pair is left out unless both are linked already or
    can't be similar.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    texts = docs.select(text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    kind = "size int, keys array<long>, least binary"
    sketches = C.cut(texts.select("node", F.pandas_udf(_sketches, kind)("text").alias("x")).select("node", "x.*").dropDuplicates(["node"]), "near-sketches")
    member = sketches.select("node", "size", F.posexplode("keys").alias("band", "key"))
    buckets = C.cut(member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    member = C.cut(member.join(buckets, ["band", "key"]), "near-members")
    central = C.cut(member.groupBy("node").agg(F.sum("n").alias("central")), "near-central")
    best = F.max(F.struct("central", "node", "size")).alias("best")
    reps = C.cut(member.join(central, "node").groupBy("band", "key").agg(best).select("band", "key", F.col("best.node").alias("rep"), F.col("best.size").alias("rep_size")), "near-reps")
    member = C.cut(member.join(reps, ["band", "key"]), "near-members")
    C.free_shuffles(spark)
    fits = F.least("size", "rep_size") >= SIMILARITY * F.greatest("size", "rep_size")
    first = member.filter(F.col("node") != F.col("rep")).filter(fits).select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b"))
    found = _checked(first, sketches, texts)
    roots = components(found)
    named = member.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("rep_root")), "rep", "left")
    named = C.cut(named.withColumn("apart", F.col("root") != F.coalesce("rep_root", "rep")), "near-named")
    C.free_shuffles(spark)
    return found.unionByName(_checked(_apart(named, texts), sketches, texts))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The text keys (column node) of all texts but one of each component of SimHash links and similar texts.

    The text with the smallest id stays (null last). Equal texts share a key,
    and so their fate. Null and repeated ids are taken like any other.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    alike = simhash.simhash_components(keyed, "node").filter("node != component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b"))
    roots = C.cut(components(alike.unionByName(near_links(docs, text_col))), "near-roots")
    named = C.cut(keyed.select("id", "node").join(roots, "node"), "near-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("node").alias("node"))).alias("best")
    best = C.cut(named.groupBy("root").agg(least), "near-best")
    return named.join(best, "root").filter("node != best.node").select("node").distinct()
