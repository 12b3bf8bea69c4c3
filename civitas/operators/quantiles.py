"""Exact per-group quantiles that never put a whole group in one task.

Built-in ``percentile``/``median`` merge a value->count map per group in a
single task and a ``row_number`` window sorts the whole group in one task:
both break when one group holds a third of all rows.  Here, for every size:

1. ``freq``    distinct (group, value) with counts - partial aggregation,
               shuffled on (group, value), so a hot group is spread; then
               dealt into ranges of (group, value) and written once with the
               number of its range.
2. offsets     counts per (group, range): one row per range that a group
               touches; a running sum over them gives each range's offset and
               the group's n.
3. ranks       a running sum inside (group, range), never more rows than one
               range holds, plus the offset; the values whose runs cover the
               wanted ranks are read off in one aggregation.

Null groups are groups; a group whose values are all null has n = 0 and null
quantiles.

All ranks are 0-based positions in the sorted group.  ``method``:
``linear`` (position p*(n-1), interpolated: DuckDB quantile_cont, Spark
percentile, the median everywhere), ``nearest`` (position round(p*(n-1)),
half away from zero), ``lower`` (floor), ``higher`` (ceil).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitas.session import materialize_table


def _rank_exprs(p: float, method: str) -> tuple[Column, Column, Column]:
    h = F.lit(p) * (F.col("__n") - 1)
    if method == "linear":
        lo, hi = F.floor(h), F.ceil(h)
        return lo.cast("long"), hi.cast("long"), (h - F.floor(h)).cast("double")
    if method == "nearest":
        r = F.round(h, 0).cast("long")
    elif method == "lower":
        r = F.floor(h).cast("long")
    elif method == "higher":
        r = F.ceil(h).cast("long")
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    return r, r, F.lit(0.0)


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    probs: Sequence[float], method: str | Sequence[str] = "linear",
                    names: Sequence[str] | None = None, with_count: bool = True) -> DataFrame:
    """One row per group: ``n`` plus one column per probability.  ``method``
    may be one name or one per probability (all share a single pass)."""
    group = list(group)
    if not group:  # global quantiles: one constant group
        out = exact_quantiles(df.withColumn("__g", F.lit(0)), ["__g"], value, probs,
                              method, names, with_count)
        return out.drop("__g")
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    methods = [method] * len(probs) if isinstance(method, str) else list(method)

    return _of_counts(value_counts(df, group, value), group, probs, methods, names, with_count)


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The state quantiles are read from: group, value, count; one row without a
    value keeps a group of nulls.  States of several loads are added by
    ``add_value_counts``, so a new load reads none of the old rows."""
    freq = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return freq.withColumn("__c", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__c")))


def add_value_counts(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """The union of several loads' ``value_counts`` as one."""
    return states.groupBy(*group, "__v").agg(F.sum("__c").alias("__c"))


def quantiles_of_counts(state: DataFrame, group: Sequence[str], probs: Sequence[float],
                        method: str | Sequence[str] = "linear", names: Sequence[str] | None = None,
                        with_count: bool = True) -> DataFrame:
    """``exact_quantiles`` of all rows ever added to ``state``."""
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    methods = [method] * len(probs) if isinstance(method, str) else list(method)
    return _of_counts(add_value_counts(state, group), list(group), probs, methods, names, with_count)


def _of_counts(freq: DataFrame, group: list[str], probs, methods, names, with_count) -> DataFrame:
    freq = freq.repartitionByRange(*group, "__v").withColumn("__range", F.spark_partition_id())
    freq = materialize_table(freq, "quantile-freq")

    ranges = freq.groupBy(*group, "__range").agg(F.sum("__c").alias("__rc"))
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *[F.col(g).alias(f"__o_{g}") for g in group], F.col("__range").alias("__o_range"),
        F.coalesce(F.sum("__rc").over(before), F.lit(0)).alias("__before"),
        F.sum("__rc").over(by_group).alias("__n"))
    same = F.col("__range") == F.col("__o_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    inside = (Window.partitionBy(*group, "__range").orderBy("__v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = (freq.withColumn("__in", F.sum("__c").over(inside)).join(offsets, same)
               .withColumn("__run", F.col("__before") + F.col("__in")))

    def at(rank: Column) -> Column:
        here = (F.col("__run") - F.col("__c") <= rank) & (rank < F.col("__run"))
        return F.max(F.when(here, F.col("__v"))).cast("double")

    cols = []
    for p, m, name in zip(probs, methods, names):
        lo, hi, frac = _rank_exprs(p, m)
        low, high = at(lo), at(hi)
        cols.append((low + F.max(frac) * (high - low)).alias(name))
    out = run.groupBy(*group).agg(F.max("__n").alias("n"), *cols)
    return out if with_count else out.drop("n")


def median_by(df: DataFrame, group: Sequence[str], value: str, name: str = "median",
              **kw) -> DataFrame:
    return exact_quantiles(df, group, value, [0.5], "linear", names=[name], **kw)


def approx_quantiles(df: DataFrame, group: Sequence[str], value: str,
                     probs: Sequence[float], accuracy: int = 10000,
                     names: Sequence[str] | None = None) -> DataFrame:
    """Separately named approximate variant (``percentile_approx``): a sketch
    of fixed size per group, rank error about 1/``accuracy``.  For groups too
    large even for the binned exact form; never mixed with exact results."""
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    qs = F.percentile_approx(F.col(value), list(probs), accuracy)
    return (df.groupBy(*group).agg(F.count(F.col(value)).alias("n"), qs.alias("__qs"))
              .select(*group, "n", *[F.col("__qs")[i].alias(nm) for i, nm in enumerate(names)]))


def quantile_sketch(df: DataFrame, group: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """Separately named approximation of fixed size per group: group, n and a KLL
    sketch, which loads add up by ``merge_sketches``."""
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(states: DataFrame, group: Sequence[str]) -> DataFrame:
    return states.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(state: DataFrame, group: Sequence[str], probs: Sequence[float],
                     names: Sequence[str] | None = None) -> DataFrame:
    """Quantiles of ``quantile_sketch`` states, rank error about 1 % at k = 400;
    null for a group without values."""
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    return state.select(*group, "n", *[
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(nm)
        for p, nm in zip(probs, names)])
