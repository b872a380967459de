"""Column-level math used everywhere: null-safe ratios, clips, bounded maps."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(x) -> Column:
    """Text to double; anything unparsable or non-finite is null."""
    return finite(col(x).try_cast("double"))


def ratio(a, b) -> Column:
    """a / b, null when b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x, lo=None, hi=None) -> Column:
    """Bounds that keep null as null (greatest/least alone would skip it)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def clip100(x) -> Column:
    return clip(x, 0, 100)


def sigmoid(x, cap: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -cap, cap)))


def logit(p, eps: float = 0.01) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def tanh_score(x, scale: float = 18.0, centre: float = 50.0, slope: float = 2.0) -> Column:
    """Map an unbounded score to 0..100 around the centre."""
    return clip100(centre + scale * F.tanh(col(x) / slope))


def flag(cond: Column) -> Column:
    """Boolean to 0/1 with null counted as 0 (the comparison rule of label columns)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def total(cols) -> Column:
    return functools.reduce(operator.add, cols)


def weighted_sum(terms: dict, null_as: float | None = 0.0) -> Column:
    """Sum of weight * column; nulls count as ``null_as`` (None keeps them null)."""
    part = lambda c: col(c) if null_as is None else F.coalesce(col(c), F.lit(float(null_as)))
    return total([part(c) * float(w) for c, w in terms.items()])


def ladder(rules, default=None) -> Column:
    """First matching rule wins; ``rules`` is a list of (condition, value)."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, value in rules[1:]:
        out = out.when(cond, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))
