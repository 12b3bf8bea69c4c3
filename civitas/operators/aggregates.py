"""Aggregate expressions shared by the marts.

Money is summed as an exact decimal and returned as double, averages are
rounded, counts are bigint: results are then identical whatever the number
of partitions or the order in which partial sums are merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions._util import col


def sum_money(c, scale: int = 2) -> Column:
    return F.sum(col(c).cast(f"decimal(18,{scale})")).cast("double")


def avg_round(c: str, digits: int = 4) -> Column:
    """Mean of a 2-decimal measure rounded exactly (see ``exact_ratio_sql``)."""
    return avg_exact(c, digits)


def avg_coalesced(c: str, digits: int = 4) -> Column:
    """agg_avg_coalesced: mean with nulls counted as zero, rounded exactly."""
    return avg_exact(c, digits, zero_null=True)


def count_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def count_if(cond: Column) -> Column:
    """``count(case when cond then 1 end)``: 0 when nothing matches."""
    return F.count_if(cond).cast("bigint")


def sum_if_money(cond: Column, c) -> Column:
    """``sum(case when cond then x end)``: null when nothing matches."""
    return F.sum(F.when(cond, col(c).cast("decimal(18,2)"))).cast("double")


def count_distinct_if(cond: Column, c) -> Column:
    """agg_conditional_distinct: distinct values under a condition."""
    return F.count_distinct(F.when(cond, col(c))).cast("bigint")


def rate_pct(num: Column, den: Column, digits: int = 1) -> Column:
    """``round(100 * num / nullif(den, 0), 1)``."""
    return F.round(F.lit(100.0) * num / F.nullif(den, F.lit(0)), digits)


def coalesce_max(a, b) -> Column:
    """agg_coalesce_max: prefer A's attribute, else B's."""
    return F.coalesce(F.max(col(a)), F.max(col(b)))


def gross_pay(*components) -> Column:
    """Sum of components with nulls as zero (a fold of coalesce); the
    components keep their own (exact decimal) types."""
    total = None
    for c in components:
        term = F.coalesce(col(c), F.lit(0))
        total = term if total is None else total + term
    return total


def unpivot_components(df: DataFrame, ids: Sequence[str], components: Sequence[str],
                       name: str = "component", value: str = "value",
                       positive_only: bool = True) -> DataFrame:
    """agg_unpivot_components: wide row -> (component, value), > 0 only."""
    long = df.unpivot(list(ids), list(components), name, value)
    return long.where(F.col(value) > 0) if positive_only else long


def rollup_additive(mart: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """agg_rollup_from_agg: re-aggregate a pre-aggregate.  Only additive
    measures (sums, counts) may be rolled up; distinct counts and means must be
    recomputed from the fact (SURVEY 2.13-3)."""
    return mart.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def exact_ratio_sql(num_units: str, den: str, digits: int, unit_scale: int,
                    dialect: str = "spark") -> str:
    """``round(num / den, digits)`` computed exactly, half away from zero.

    ``num_units`` is an integer-valued SQL expression (money already scaled by
    10**unit_scale), ``den`` a count.  The division is an integer division, so
    the rounding never depends on floating point or on the order in which
    partial sums were merged; only the final result becomes a double.
    """
    if dialect == "spark":
        # per-row work stays in bigint; the once-per-group rounding is done in
        # decimal(38,0) so scaling by 10**digits cannot overflow
        n = f"cast({num_units} as decimal(38,0))"
        a = f"(abs({n}) * {10 ** digits})"
        b = f"(cast({den} as decimal(38,0)) * {10 ** unit_scale})"
        q = f"((2 * {a} + {b}) div (2 * nullif({b}, 0)))"
        return f"cast(signum({n}) * {q} / {10 ** digits} as double)"
    a = f"(abs({num_units}) * {10 ** digits})"
    b = f"({den} * {10 ** unit_scale})"
    q = f"((2 * {a} + {b}) // (2 * nullif({b}, 0)))"
    return f"cast(sign({num_units}) * {q} / {10 ** digits} as double)"


def units_sum_sql(c: str, scale: int = 2, dialect: str = "spark", zero_null: bool = False) -> str:
    """sum of ``c`` in integer units of 10**-scale (exact)."""
    v = f"coalesce({c}, 0)" if zero_null else c
    # bigint per row (ANSI mode raises on overflow, it never wraps)
    t = "bigint" if dialect == "spark" else "hugeint"
    return f"sum(cast(cast({v} as decimal(18,{scale})) * {10 ** scale} as {t}))"


def avg_exact_sql(c: str, digits: int = 4, scale: int = 2, dialect: str = "spark",
                  zero_null: bool = False) -> str:
    """``round(avg(c), digits)`` exactly; ``zero_null`` counts nulls as 0."""
    n = "count(*)" if zero_null else f"count({c})"
    return exact_ratio_sql(units_sum_sql(c, scale, dialect, zero_null), n, digits, scale, dialect)


def avg_exact(c: str, digits: int = 4, scale: int = 2, zero_null: bool = False) -> Column:
    return F.expr(avg_exact_sql(c, digits, scale, "spark", zero_null))


def count_distinct_approx(c, rsd: float = 0.01) -> Column:
    """Separately named approximate variant of agg_count_distinct
    (HyperLogLog++, relative standard deviation ``rsd``): fixed memory per
    group and no row expansion, for many distinct counts over huge groups.
    Not used where an exact figure is reported."""
    return F.approx_count_distinct(col(c), rsd).cast("bigint")


def count_distinct_many(df: DataFrame, group: Sequence[str], distinct: dict,
                        other_aggs: Sequence[Column] = ()) -> DataFrame:
    """Several exact distinct counts per group, with ``other_aggs``: one row per
    group, a null group included.  ``distinct`` maps output name -> column name or
    expression (``when(cond, c)`` gives a conditional count).

    Each count reads ``df`` once and reduces it to (group, value), on the map side
    first; a hot group is spread over tasks by value before it is counted.  Counted
    in one aggregate, Spark would make a row per count of every input row and, where
    a buffer is a string, hold and sort all of them in the task."""
    group = list(group)
    out = df.groupBy(*group).agg(*other_aggs) if other_aggs else df.select(*group).distinct()
    for name, c in distinct.items():
        keys = [f"__g{i}" for i in range(len(group))]
        values = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], col(c).alias("__v"))
        n = values.where(F.col("__v").isNotNull()).distinct().groupBy(*keys).agg(
            F.count(F.lit(1)).cast("bigint").alias("__n"))
        same = F.lit(True)
        for g, k in zip(group, keys):
            same = same & F.col(g).eqNullSafe(F.col(k))
        out = out.join(n, same, "left").withColumn(name, F.coalesce("__n", F.lit(0).cast("bigint"))) \
            .drop(*keys, "__n")
    return out
