"""Salting for joins whose big side may hold a hot key.

``salted_left_join`` is ``big LEFT JOIN small`` on a key that is unique in
``small``.  Rows of the (few, known) hot keys get a salt from a hash of the
row, so they spread over ``splits`` shuffle partitions; the small side's row
of each hot key is replicated once per salt value.  Every other key keeps
salt 0, i.e. the plain shuffle join.  The result is exactly the plain join:
salting only changes which task does the work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def hot_keys_by_count(counts: DataFrame, key: str, count_col: str, share: float = 0.01) -> list:
    """Keys holding at least ``share`` of all rows, from a table with one row
    per key and its row count.  At most ``1/share`` keys qualify, so the list
    is bounded."""
    total = counts.agg(F.sum(count_col)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count_col) >= share * total).select(key).collect()]


def salted_left_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                     hot: Sequence, splits: int, salt_from: Sequence[str] | None = None) -> DataFrame:
    if not hot:
        return big.join(small, big[big_key] == small[small_key], "left")
    is_hot = F.col(big_key).isin(list(hot))
    cols = list(salt_from or big.columns)
    salt: Column = F.when(is_hot, F.pmod(F.xxhash64(*cols), F.lit(splits))).otherwise(F.lit(0))
    left = big.withColumn(SALT, salt.cast("int"))
    right = small.withColumn(SALT, F.explode(
        F.when(F.col(small_key).isin(list(hot)), F.sequence(F.lit(0), F.lit(splits - 1)))
        .otherwise(F.array(F.lit(0)))))
    j = left.join(right, (left[big_key] == right[small_key]) & (left[SALT] == right[SALT]), "left")
    return j.drop(left[SALT]).drop(right[SALT])

