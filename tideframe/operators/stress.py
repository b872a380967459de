"""Shock scores of driver moves and the stress score built from them."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

from tideframe.functions import rolling as R
from tideframe.functions.scalar import clip, col, ratio


def shock(move, weight, w: WindowSpec) -> Column:
    """Largest of the 1, 5 and 20 row moves in units of their trailing deviation, on 0..100."""
    move = col(move)
    sd = R.std(move, 252, w, 60)
    z1 = ratio(move, sd)
    z5 = ratio(R.guarded(F.sum, move, R.trailing(w, 5), 3), sd * 5 ** 0.5)
    z20 = ratio(R.guarded(F.sum, move, R.trailing(w, 20), 10), sd * 20 ** 0.5)
    return clip(32.0 * F.greatest(z1, z5, z20) * weight, 0, 100)
