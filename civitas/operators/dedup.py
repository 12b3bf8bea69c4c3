"""One row per key with a total order.

The pick is an *aggregate* (``max_by`` / ``min_by`` over a struct of the
ordering columns), not a ``row_number`` window: the aggregate combines on the
map side, so a key holding a third of all rows is reduced to one row per
input partition before the shuffle, where a window would sort the whole hot
key in one task.  The ordering struct always ends with a tie-break so the
winner is the same for any input order or partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions._util import col


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def _key_struct(cols, nulls_rank_low: bool) -> Column:
    """Struct used as the ordering key.  Every column is preceded by a null
    flag so nulls sort last for both directions: for max (``latest``) a
    non-null value gets flag 1, for min (``earliest``) a null gets flag 1."""
    parts = []
    for i, c in enumerate(cols):
        c = col(c)
        flag = c.isNotNull() if nulls_rank_low else c.isNull()
        parts += [flag.alias(f"f{i}"), c.alias(f"v{i}")]
    return F.struct(*parts)


def _pick(df: DataFrame, keys: Sequence[str], order: list, tie_break: Sequence | None,
          newest: bool) -> DataFrame:
    """The row of the extreme ordering key.  Without a tie-break the whole row
    ends the ordering key and is read from it, so it is carried once."""
    if tie_break is None:
        best = F.max if newest else F.min
        picked = df.groupBy(*keys).agg(
            best(_key_struct([*order, _row(df)], newest)).alias("__best"))
        return picked.select(f"__best.v{len(order)}.*")
    by = F.max_by if newest else F.min_by
    picked = df.groupBy(*keys).agg(
        by(_row(df), _key_struct([*order, *tie_break], newest)).alias("__pick"))
    return picked.select("__pick.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                   tie_break: Sequence | None = None) -> DataFrame:
    """Row with the greatest ``order`` tuple per key, nulls last
    (``row_number() over (partition by keys order by ... desc nulls last) = 1``)."""
    return _pick(df, keys, list(order), tie_break, True)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                     tie_break: Sequence | None = None) -> DataFrame:
    """Row with the least ``order`` tuple per key, nulls last."""
    return _pick(df, keys, list(order), tie_break, False)


def dedup_on_keys(df: DataFrame, keys: Sequence[str],
                  prefer: Sequence | None = None, newest: bool = True) -> DataFrame:
    """Unique by ``keys``; among duplicates the ``prefer`` order decides
    (newest first by default) and the full row breaks remaining ties, so the
    reference's order-dependent "any row" becomes repeatable."""
    pick = latest_per_key if newest else earliest_per_key
    return pick(df, keys, list(prefer or []))


def first_seen_unique(df: DataFrame, keys: Sequence[str],
                      seen_order: Sequence) -> DataFrame:
    """Ids unique across pages/periods, the first occurrence wins."""
    return earliest_per_key(df, keys, seen_order)
