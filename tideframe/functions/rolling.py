"""Time-series expressions over one entity ordered by date.

All take a ``WindowSpec`` (partition = entity, order = date) and return a Column, so
one ``select`` with many of them costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .scalar import col, ratio

ALL_BEFORE = Window.unboundedPreceding
ALL_AFTER = Window.unboundedFollowing


def by_entity(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def day(order: str = "date") -> WindowSpec:
    """Order of a date-level table (one row per day); never used on asset rows or facts."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def prior(w: WindowSpec, n: int | None = None) -> WindowSpec:
    """The n rows before the current one (all of them when n is None)."""
    return w.rowsBetween(ALL_BEFORE if n is None else -n, -1)


def ahead(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1, n)


def guarded(agg, x, frame: WindowSpec, min_periods: int) -> Column:
    """``agg`` of the frame, null when fewer than ``min_periods`` values are present."""
    x = col(x)
    return F.when(F.count(x).over(frame) >= min_periods, agg(x).over(frame))


# --- returns and changes -------------------------------------------------------

def step_return(p, n: int, w: WindowSpec) -> Column:
    """p[t] / p[t-n] - 1 without padding of gaps."""
    p = col(p)
    return ratio(p, F.lag(p, n).over(w)) - 1


def padded(x, w: WindowSpec, limit: int | None = None) -> Column:
    """Forward fill, over at most ``limit`` rows when given."""
    start = ALL_BEFORE if limit is None else -limit
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(start, 0))


def back_filled(x, w: WindowSpec) -> Column:
    return F.first(col(x), ignorenulls=True).over(w.rowsBetween(0, ALL_AFTER))


def difference(x, n: int, w: WindowSpec) -> Column:
    x = col(x)
    return x - F.lag(x, n).over(w)


def forward_return(p, h: int, w: WindowSpec) -> Column:
    p = col(p)
    return ratio(F.lead(p, h).over(w), p) - 1


def forward_min_strict(p, h: int, w: WindowSpec) -> Column:
    """Worst forward return over h rows; the row t+h-1 must exist and max(2, h//2) values be present."""
    p = col(p)
    frame = ahead(w, h)
    ok = (F.count(p).over(frame) >= max(2, h // 2)) & F.lead(F.lit(1), h - 1).over(w).isNotNull()
    return F.when(ok, ratio(F.min(p).over(frame), p) - 1)


def forward_min_any(p, h: int, w: WindowSpec) -> Column:
    """Worst forward return over whatever rows exist among the next h."""
    p = col(p)
    return ratio(F.min(p).over(ahead(w, h)), p) - 1


# --- moments ------------------------------------------------------------------

def mean(x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return guarded(F.avg, x, trailing(w, n), min_periods or n)


def high(x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return guarded(F.max, x, trailing(w, n), min_periods or n)


def low(x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return guarded(F.min, x, trailing(w, n), min_periods or n)


def std(x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return guarded(F.stddev_samp, x, trailing(w, n), min_periods or n)


def annual_vol(ret, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return std(ret, n, w, min_periods) * F.sqrt(F.lit(252.0))


def zscore(x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    x = col(x)
    return ratio(x - mean(x, n, w, min_periods), std(x, n, w, min_periods))


def loose_min_periods(n: int, floor: int) -> int:
    """The min_periods rule max(floor, n // 3) of the tolerant z-scores."""
    return max(floor, n // 3)


def drawdown(p, n: int, w: WindowSpec) -> Column:
    p = col(p)
    return ratio(p, high(p, n, w, max(5, n // 4))) - 1


def slope(y, pos, n: int, w: WindowSpec) -> Column:
    """OLS slope of the last n values on their row position; null when any is missing."""
    y = col(y)
    frame = trailing(w, n)
    return F.when(F.count(y).over(frame) == n, F.regr_slope(y, col(pos).cast("double")).over(frame))


def log_ratio(a, b) -> Column:
    r = ratio(a, b)
    return F.when(r > 0, F.log(r))


def beta(y, x, n: int, w: WindowSpec, min_periods: int) -> Column:
    """cov(y, x) / var(x) over the last n rows on which both are present."""
    y, x = col(y), col(x)
    frame = trailing(w, n)
    both = y.isNotNull() & x.isNotNull()
    return F.when(F.count(F.when(both, 1)).over(frame) >= min_periods, F.regr_slope(y, x).over(frame))


# --- compounding -----------------------------------------------------------------

def compound(r) -> Column:
    """Aggregate: prod(1 + r) - 1 with nulls as 0."""
    return F.product(1 + F.coalesce(col(r), F.lit(0.0))) - 1


def equity(r, w: WindowSpec) -> Column:
    """Running product of (1 + r); a return of -100% or worse keeps its sign and zero."""
    g = 1 + F.coalesce(col(r), F.lit(0.0))
    run = w.rowsBetween(ALL_BEFORE, 0)
    size = F.exp(F.sum(F.log(F.when(g == 0, F.lit(None)).otherwise(F.abs(g)))).over(run))
    sign = F.when(F.sum((g < 0).cast("int")).over(run) % 2 == 0, 1.0).otherwise(-1.0)
    return F.when(F.max((g == 0).cast("int")).over(run) == 1, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def off_peak(e, w: WindowSpec) -> Column:
    e = col(e)
    return ratio(e, F.max(e).over(w.rowsBetween(ALL_BEFORE, 0))) - 1
