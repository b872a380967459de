"""Operators. A *panel* is a DataFrame with one row per (date, entity).

Every panel built in this library passes through a ``groupBy(date, entity)`` or a
keep-last step, so the raw facts are pre-aggregated map-side and a hot key of the
facts collapses to one row per day.  Windows partitioned by entity are therefore
bounded by the calendar and windows partitioned by date by the universe.  Anything
that pools rows across dates (AUC, calibration bins, quantiles, threshold sweeps)
goes through ``operators.pooled`` and never sorts the pool in one task.
"""
