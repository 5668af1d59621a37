"""Uniform numbers from md5: the same in every engine and for every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A double in [0, 1) from seed, salt and keys: the first 32 bits of an md5 over 2^32."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def between(u: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return low + u * (high - low)


def pick(u: Column, shares: dict[str, float]) -> Column:
    """The key whose cumulative share first exceeds u."""
    total, at, out = sum(shares.values()), 0.0, None
    for key, share in list(shares.items())[:-1]:
        at += share / total
        out = (F.when if out is None else out.when)(u < at, F.lit(key))
    last = F.lit(list(shares)[-1])
    return last if out is None else out.otherwise(last)


def normal(u: Column, v: Column) -> Column:
    """A standard normal number by Box and Muller."""
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(2.0**-33)))) * F.cos(2 * math.pi * v)


def seconds(x: Column) -> Column:
    """An interval of x seconds, to the microsecond."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(x, 6).cast("decimal(18,6)"))
