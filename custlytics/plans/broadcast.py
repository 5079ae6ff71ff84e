"""Size-checked broadcast.

A side is broadcast only behind a size bound: either one that holds by
construction (a table with one row per calendar month, per score band, per
rank bucket ...; pass ``proven=True`` and say why at the call site) or one
checked at runtime by counting at most ``max_rows + 1`` rows.  Beyond the
bound the join stays a shuffle join, which AQE may still turn into a
broadcast once the materialised side turns out small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int, proven: bool = False,
                       check: bool = True) -> DataFrame:
    """Hint a broadcast only behind a size bound.

    ``proven``: the bound holds by construction (say why at the call site).
    ``check``: count at most ``max_rows + 1`` rows now -- cheap for a base
    table, but it would execute a derived table's whole pipeline, so for
    derived tables pass ``check=False``: no hint, and AQE converts the join
    to a broadcast at runtime once the materialised side proves small."""
    if proven:
        return F.broadcast(df)
    if not check:
        return df
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
