"""Joins that keep frequent keys out of any one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds at least 1/HOT_SHARE of the weight; there are at most HOT_SHARE such keys.
HOT_SHARE = 10_000


def join_hot_cold(df: DataFrame, table: DataFrame, key: str, weight: str, values: list[str], small_enough: Column | None = None) -> DataFrame:
    """Inner join of ``df`` with ``table`` (unique ``key``), adding ``values``.

    ``weight`` is the number of rows of ``df`` with the key. Frequent keys are joined by broadcast:
    at most HOT_SHARE rows of the table, whatever its size. The others are joined by a shuffle in
    which no key is frequent. ``small_enough`` may exclude rows that are too wide to broadcast. ``table`` is read
    twice and should be materialised.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= F.lit(max(1, total))
    if small_enough is not None:
        hot = hot & small_enough
    marked = "__hot"
    frequent = table.where(hot).select(key, F.struct(*values).alias(marked))
    rest = table.where(~hot).select(key, *values)
    left = df.join(F.broadcast(frequent), key, "left")
    columns = df.columns
    found = left.where(F.col(marked).isNotNull()).select(*columns, *[F.col(f"{marked}.{v}").alias(v) for v in values])
    others = left.where(F.col(marked).isNull()).select(*columns).join(rest, key)
    return found.unionByName(others.select(*columns, *values))
