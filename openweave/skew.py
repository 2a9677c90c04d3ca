"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys, however large the data.
HOT_SHARE = 1024


def lookup_skewed(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and the key's number of rows in ``weight``.

    Hot keys (more than total/HOT_SHARE rows) are fewer than HOT_SHARE by counting, so their part of the table is broadcast
    and their rows are never moved; all other keys are small and go through an ordinary shuffled join. No row is dropped.
    ``table`` should be materialized: it is read twice.
    """
    limit = max(total // HOT_SHARE, 1)
    hot, cold = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    left = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(left)


#: Rows up to which a table is broadcast, after they have been counted.
SMALL_ROWS = 100_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are at most ``limit``; otherwise df itself, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df
