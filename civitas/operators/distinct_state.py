"""Distinct counts that roll up: exact bitmaps over dense ids.

A mart that stores ``count(distinct x)`` per month cannot be rolled up to a year.
Here it stores, per group, which values there are, as bitmaps of 32,768 ids each:

* ``dense_ids``        gives each value of a column a number from 1 without gaps;
                       values of later loads go on where the numbers end, so old
                       marts stay valid.  No window and no sort over all values.
* ``distinct_mart``    one aggregate per load: additive sums and the bitmaps
                       (``bitmap_construct_agg``, combined on the map side, so a
                       hot group is spread).  Marts of several loads are unioned.
* ``roll_up``          any coarser grouping: ``bitmap_or_agg`` per bitmap, then the
                       bits are counted.  Equal to the fact's distinct counts.

A bitmap takes 4 KB before compression whatever it holds: the state is for groups
with many values (months, states, offices).  Null values are no value; a null
group is a group; a group whose values are all null has count 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitas.session import materialize_table

STATE = ("__measure", "__bucket", "__bits")


def dense_ids(values: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """``col``, id: the values of ``known`` (an earlier result) with their ids, and
    those new in ``values`` with the ids after them."""
    new = values.select(col).where(F.col(col).isNotNull()).distinct()
    last = 0
    if known is not None:
        new = new.join(known.select(col), col, "left_anti")
        last = known.agg(F.max("id")).first()[0] or 0
    # a task's row number is the low half of this id; the tasks' totals, one row
    # each, give the number before its first row
    row = F.monotonically_increasing_id()
    new = materialize_table(new.select(
        col, F.shiftright(row, 33).alias("__task"),
        row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "dense-ids")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = new.groupBy("__task").count().select(
        "__task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    new = new.join(tasks, "__task").select(
        col, (F.lit(last + 1) + F.col("__before") + F.col("__row")).cast("long").alias("id"))
    return new if known is None else known.select(col, "id").unionByName(new)


def distinct_mart(fact: DataFrame, group: Sequence[str], sums: Mapping[str, Column],
                  distinct: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Per ``group``: one row with the additive ``sums`` and rows of state per
    distinct count.  ``distinct``: name -> (column of the fact, its ``dense_ids``)."""
    group = list(group)
    none = [F.lit(None).cast("string").alias("__measure"), F.lit(None).cast("long").alias("__bucket"),
            F.lit(None).cast("binary").alias("__bits")]
    mart = fact.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()]).select("*", *none)
    types = {f.name: f.dataType for f in mart.schema.fields}
    for name, (col, ids) in distinct.items():
        keyed = fact.select(*[F.col(g).alias(g) for g in group], F.col(col).alias("__value")).join(
            ids.select(F.col(col).alias("__value"), "id"), "__value")
        bits = keyed.groupBy(*group, F.bitmap_bucket_number("id").alias("__bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__bits"))
        mart = mart.unionByName(bits.select(
            *group, *[F.lit(None).cast(types[n]).alias(n) for n in sums],
            F.lit(name).alias("__measure"), "__bucket", "__bits"))
    return mart


def roll_up(mart: DataFrame, group: Sequence[str], sums: Sequence[str],
            distinct: Sequence[str]) -> DataFrame:
    """The mart by a coarser ``group`` (or none): sums added up and exact distinct
    counts, one row per group."""
    group = list(group)
    each = mart.groupBy(*group, "__measure", "__bucket").agg(
        *[F.sum(n).alias(n) for n in sums], F.bitmap_or_agg("__bits").alias("__bits"))
    return each.groupBy(*group).agg(
        *[F.sum(n).alias(n) for n in sums],
        *[F.coalesce(F.sum(F.when(F.col("__measure") == n, F.bitmap_count("__bits"))), F.lit(0))
          .cast("long").alias(n) for n in distinct])


def roll_up_levels(mart: DataFrame, levels: Mapping[str, Sequence[str]], sums: Sequence[str],
                   distinct: Sequence[str], level: str = "nivel") -> DataFrame:
    """``roll_up`` to several levels at once, each with its name.  Levels are read
    off the mart, which is small, not off the fact."""
    every = [c for c in mart.columns if c not in (*STATE, *sums)]
    out = None
    for name, group in levels.items():
        rows = roll_up(mart, group, sums, distinct).select(
            F.lit(name).alias(level), *[(F.col(c) if c in group else F.lit(None).cast(mart.schema[c].dataType))
                                        .alias(c) for c in every], *sums, *distinct)
        out = rows if out is None else out.unionByName(rows)
    return out


def totals_by_level(df: DataFrame, levels: Mapping[str, Sequence[str]], aggs: Sequence[Column],
                    level: str = "nivel") -> DataFrame:
    """One aggregate for all ``levels`` (grouping sets): name -> its dimensions.
    ``grouping_id`` names the level, so the total over a dimension and the group of
    its null value stay apart though both show a null.  A table without rows has no
    group at any level, the total included."""
    dims = list(dict.fromkeys(c for group in levels.values() for c in group))
    sets = [[F.col(c) for c in group] for group in levels.values()]
    bits = {name: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in group)
            for name, group in levels.items()}
    named = None
    for name, b in bits.items():
        named = (F if named is None else named).when(F.grouping_id() == b, F.lit(name))
    return df.groupingSets(sets, *[F.col(c) for c in dims]).agg(named.alias(level), *aggs) \
        .select(level, *dims, *[c for c in _names(df, aggs)])


def _names(df: DataFrame, aggs: Sequence[Column]) -> list[str]:
    return df.limit(0).agg(*aggs).columns
