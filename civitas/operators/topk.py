"""Sorts, limits and top-k.  A global top-N is always
``orderBy(...).limit(n)`` with a tie-break key, which Spark plans as
``TakeOrderedAndProject`` (per-partition heaps, n rows shuffled)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topn(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def topn_sum(df: DataFrame, group: Sequence[str], measure: Column, n: int,
             alias: str = "total", descending: bool = True,
             extra_aggs: Sequence[Column] = ()) -> DataFrame:
    agg = df.groupBy(*group).agg(measure.alias(alias), *extra_aggs)
    first = F.col(alias).desc_nulls_last() if descending else F.col(alias).asc_nulls_last()
    return agg.orderBy(first, *[F.col(g).asc_nulls_last() for g in group]).limit(n)


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   k: int) -> DataFrame:
    """k best rows per group in one shuffle, safe for a group holding a third
    of the data: Spark limits every group to k rows in each task before the
    exchange (WindowGroupLimit) and again behind it.  ``order`` must be a total
    order (end with a unique key)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def top_keys(df: DataFrame, key: str, weight: Column, k: int) -> DataFrame:
    """The k heaviest keys (k rows: bounded, safe to broadcast)."""
    return (df.groupBy(key).agg(weight.alias("__w"))
              .orderBy(F.col("__w").desc(), F.col(key).asc_nulls_last())
              .limit(k).select(key))


def topn_then_filter(df: DataFrame, key: str, weight: Column, k: int) -> DataFrame:
    """All rows of the k heaviest categories (semi join with the top-k frame)."""
    return df.join(F.broadcast(top_keys(df, key, weight, k)), key, "left_semi")


def topn_other_bucket(df: DataFrame, key: str, weight: Column, k: int,
                      out: str = "grouped", other: str = "Outros") -> DataFrame:
    """Keep the k heaviest categories, relabel the rest as ``other``."""
    top = top_keys(df, key, weight, k).withColumn("__top", F.lit(True))
    return (df.join(F.broadcast(top), key, "left")
              .withColumn(out, F.when(F.col("__top"), F.col(key)).otherwise(F.lit(other)))
              .drop("__top"))
