"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C

ALPHA, KEEP, SEED, MAX_CELLS = 0.7, 0.8, 17, 1_000_000
#: Cells are broadcast up to so many bytes of their names, else joined by shuffle.
BROADCAST_BYTES = 4 << 20
AXES = ("source", "lang", "topic")
#: Cues of topics, in lower case; a text without any is GENERAL.
TOPICS = {
    "legal": ("license", "licence", "copyright", "rights reserved"),
    "contact": ("@", "phone", "e-mail"),
    "code": ("token =", "import ", "{", "();"),
    "listing": (" | ",),
}
GENERAL = "general"
#: What the registered query and the pipeline aim at, as shares of the kept tokens; sources are tempered by ALPHA.
TARGETS = {
    "lang": {"en": 0.54, "de": 0.18, "fr": 0.17, "es": 0.11},
    "topic": {"general": 0.92, "legal": 0.04, "contact": 0.02, "code": 0.01, "listing": 0.01},
}
#: Targets out of reach that are logged one by one.
TOLD = 20
log = logging.getLogger(__name__)


def raked(cells: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Cell masses whose marginals are the targets (shares of the total), by repeated scaling of one axis at a time."""
    mass = cells.astype(float).copy()
    total = mass.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(index, targets):
            now = np.bincount(at, mass, len(target))
            scale = np.divide(target * total, now, out=np.ones_like(target), where=now > 0)
            worst = max(worst, float(np.abs(scale[now > 0] - 1).max(initial=0)))
            mass *= scale[at]
        if worst < tolerance:
            break
    return mass


def reachable(share: np.ndarray, have: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each value: as `share` says, but at most what the value has; what it lacks goes to the others by their shares."""
    full = np.zeros(len(share), bool)
    while True:
        rest, left = share[~full].sum(), total - have[full].sum()
        want = np.where(full, have, share * max(0.0, left) / rest if rest else 0.0)
        over = ~full & (want > have)
        if not over.any():
            return want
        full |= over


def chances(tokens: np.ndarray, weight: np.ndarray, index: list[np.ndarray], shares: list[np.ndarray], keep: float, rounds: int = 500, tolerance: float = 1e-7) -> np.ndarray:
    """Probabilities min(1, product of one factor for each axis) with `keep` of all tokens expected and the shares on every axis.

    Where a weight times `keep` is above 1 the weights are raked again under
    that bound, so the other cells make up for what a full one can't give. A
    value with fewer tokens than its target is kept whole, and the others of
    its axis share the rest. Raising a factor never overshoots, as the bound
    makes the kept tokens concave in it.
    """
    if (keep * weight).max(initial=0) <= 1:
        return keep * weight
    alive = np.where(np.logical_and.reduce([share[at] > 0 for at, share in zip(index, shares)]), tokens, 0.0)
    total = min(keep * tokens.sum(), alive.sum())
    wants = [reachable(share, np.bincount(at, alive, len(share)), total) for at, share in zip(index, shares)]
    factor = keep * weight
    for _ in range(rounds):
        worst = 0.0
        for at, want in zip(index, wants):
            now = np.bincount(at, alive * np.minimum(1, factor), len(want))
            scale = np.divide(want, now, out=np.ones_like(want), where=now > 0)
            worst = max(worst, float(np.abs(want - now).max(initial=0)) / total)
            factor = np.clip(factor * scale[at], 0, 1e100)
        if worst < tolerance:
            break
    return np.minimum(1, factor)


def shortfall(tokens: np.ndarray, chance: np.ndarray, index: list[np.ndarray], shares: list[np.ndarray], near: float = 1e-4) -> list[tuple[int, int, float, float]]:
    """(axis, value, target, reached) as shares of the expected tokens, where they differ by more than `near`; farthest first."""
    kept = tokens * chance
    found = []
    for a, (at, share) in enumerate(zip(index, shares)):
        got = np.bincount(at, kept, len(share)) / max(kept.sum(), 1e-300)
        found += [(a, int(v), float(share[v]), float(got[v])) for v in np.flatnonzero(np.abs(got - share) > near)]
    return sorted(found, key=lambda x: -abs(x[2] - x[3]))


def largest_keep(tokens: np.ndarray, index: list[np.ndarray], shares: list[np.ndarray]) -> float:
    """The share of all tokens above which some value has fewer tokens than its target."""
    most = [np.bincount(at, tokens, len(share))[share > 0] / share[share > 0] for at, share in zip(index, shares)]
    return min([1.0, *(float(m.min()) / tokens.sum() for m in most if len(m))])


def topic_of(text: Column, topics: dict[str, tuple[str, ...]]) -> Column:
    """The topic with the most different cues in the lower-cased text, the first of equals; GENERAL where there is none."""
    low = F.lower(text)
    found = {name: sum((F.contains(low, F.lit(cue)).cast("int") for cue in cues), F.lit(0)) for name, cues in topics.items()}
    most = F.greatest(*found.values(), F.lit(0))
    out = F.when(most == 0, F.lit(GENERAL))
    for name, n in found.items():
        out = out.when(n == most, F.lit(name))
    return out.otherwise(F.lit(GENERAL))


def with_axes(docs: DataFrame, id_col: str, text_col: str, topics: dict[str, tuple[str, ...]], seed: int) -> DataFrame:
    """doc (all columns), _tokens (words), _draw (a number in [0, 1) by id, text and seed), _source, _lang and _topic."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"),
        draw.alias("_draw"),
        given("source").alias("_source"),
        given("lang").alias("_lang"),
        (given("topic") if "topic" in docs.columns else topic_of(text, topics)).alias("_topic"),
    )


def calibrated(found: list, targets: dict[str, dict[str, float]], alpha: float, keep: float) -> list[tuple]:
    """Of each cell (source, lang, topic, tokens): its names, weight, probability, and by axis the present, target and reached shares."""
    names = [f"_{a}" for a in AXES]
    tokens = np.array([r["t"] or 0 for r in found], float)
    values, index, present, shares = [], [], [], []
    for axis, name in zip(AXES, names):
        own, at = np.unique([r[name] for r in found], return_inverse=True)
        have = np.bincount(at, tokens, len(own))
        want = np.array([targets[axis].get(v, 0.0) for v in own]) if axis in targets else have**alpha
        want = np.where(have > 0, want, 0.0)
        values.append(own)
        index.append(at)
        present.append(have / have.sum() if have.sum() else have)
        shares.append(want / want.sum() if want.sum() else want)
    if not tokens.sum():
        return [(*(r[n] for n in names), 1.0, keep, *[0.0] * 9) for r in found]
    mass = raked(tokens, index, shares)
    weight = np.divide(mass, tokens, out=np.ones_like(mass), where=tokens > 0)
    chance = chances(tokens, weight, index, shares, keep)
    if missed := shortfall(tokens, chance, index, shares):
        told = ", ".join(f"{AXES[a]} {values[a][v]} {want:.4f} -> {got:.4f}" for a, v, want, got in missed[:TOLD])
        log.warning("keep %g: %d targets are out of reach (all have the tokens up to keep %.3f); target -> reached, farthest first: %s", keep, len(missed), largest_keep(tokens, index, shares), told)
    kept = tokens * chance
    reached = [np.bincount(at, kept, len(share)) / max(kept.sum(), 1e-300) for at, share in zip(index, shares)]
    columns = [x[at] for x, at in ((part[a], index[a]) for a in range(len(AXES)) for part in (present, shares, reached))]
    return [(*(r[n] for n in names), *map(float, row)) for r, row in zip(found, zip(weight, chance, *columns))]


def mixed(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, keep: float = KEEP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    topics: dict[str, tuple[str, ...]] = TOPICS, columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs with _tokens, _source, _lang, _topic, _weight, _probability, _kept and, of the row's value on each axis, _<axis>_present, _target and _reached.

    Token masses of the (source, lang, topic) cells, at most MAX_CELLS, are
    raked on the driver to the target shares of each axis; on an axis without
    targets a value's share is its tokens to the power alpha. A cell's weight
    is its raked over its present mass. Documents are kept independently with
    probability `keep` * weight, raked again where that is above 1 (`chances`),
    so that `keep` of all tokens have the target shares; targets that the
    tokens can't give at this `keep` are logged with what is reached instead.
    The draw is a hash of id, text and seed, so repeated rows share their fate.
    Shares are of all tokens (present), wanted (target) and of the expected
    kept tokens (reached). The topic is the column topic where there is one,
    else it is told by the cues in `topics`. With `columns` only these of docs
    are returned, and the texts are read once.

    Null or absent source and language count as the empty value; targets for
    values without tokens are left out and the rest scaled up, values without
    a target are left out of the sample. Empty texts have no tokens and their
    cell's probability. Columns of docs that are named like a new one are
    replaced. An empty table gives an empty result.
    """
    spark, names = docs.sparkSession, [f"_{a}" for a in AXES]
    rows = with_axes(docs, id_col, text_col, topics, seed)
    if columns is not None:
        rows = C.cut(rows.withColumn("doc", F.struct(*(F.col(f"doc.`{c}`") for c in columns))), "mixing-rows")
    cells = C.cut(rows.groupBy(*names).agg(F.sum("_tokens").alias("t")), "mixing-cells")
    if (n := cells.count()) > MAX_CELLS:
        raise ValueError(f"{n} cells of {AXES}; at most {MAX_CELLS} are raked")
    found = cells.orderBy(*names).collect()
    shares = [f"_{a}_{x}" for a in AXES for x in ("present", "target", "reached")]
    numbers = ["_weight", "_probability", *shares]
    table = spark.createDataFrame(calibrated(found, targets or {}, alpha, keep), ", ".join([f"{n} string" for n in names] + [f"{n} double" for n in numbers]))
    # the cells' size is known here, so that whole texts needn't be shuffled to find it out
    size = sum(8 * len(numbers) + sum(len(r[n].encode("utf-8", "surrogatepass")) for n in names) for r in found)
    out = rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, names, "left").withColumn("_kept", F.col("_draw") < F.col("_probability"))
    new = ["_tokens", *names, *numbers, "_kept"]
    return out.select(*(F.col(f"doc.`{c}`") for c in (columns or docs.columns) if c not in new), *new)
