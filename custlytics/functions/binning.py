"""Binning with fixed edges (right-closed like a histogram cut)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def band(c, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True) -> Column:
    """Label of the right-closed interval ``(e[i], e[i+1]]`` holding the value.

    The first interval is closed on the left too when ``include_lowest``.
    Values outside ``[e[0], e[-1]]`` and nulls get null.  (``Bucketizer`` is
    left-closed, so it cannot express this.)"""
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per interval")
    v = _c(c)
    lo = (v >= edges[0]) if include_lowest else (v > edges[0])
    expr = None
    for i, label in enumerate(labels):
        cond = (v <= edges[i + 1]) & (lo if i == 0 else (v > edges[i]))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def fixed_bin(c, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin index in ``[0, bins)``; the right edge falls in the last
    bin.  Null outside ``[lo, hi]``."""
    v = _c(c)
    idx = F.least(F.floor((v - F.lit(float(lo))) * bins / F.lit(float(hi - lo))),
                  F.lit(bins - 1)).cast("int")
    return F.when((v >= lo) & (v <= hi), idx)
