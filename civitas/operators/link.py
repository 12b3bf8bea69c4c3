"""Joins: dimension joins, derived-key joins that cannot fan out, priority fallback and cross-references over pre-aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.operators.dedup import earliest_per_key

def join_left_dim(fact: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Fact left join dimension (denormalise).  No hint: the optimiser's byte
    threshold and AQE's measured sizes choose the join, and AQE splits a skewed
    sort-merge join."""
    return fact.join(dim, on, "left")


def unique_registry(reg: DataFrame, key: str, id_col: str) -> DataFrame:
    """Registry reduced to one row per (non-blank) key: the smallest id wins.
    Doing this before the join is what stops a name join from duplicating
    fact rows (two members with the same folded name)."""
    clean = reg.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return earliest_per_key(clean, [key], [F.col(id_col)])


def join_on_derived_key(left: DataFrame, right: DataFrame, left_expr: Column,
                        right_expr: Column, key: str = "__k",
                        how: str = "left") -> DataFrame:
    """Equi-join on a computed key (``upper(trim(name))``, folded name ...).
    The key is computed once per side; blank keys never match (they would all
    match each other and form one giant skewed group)."""
    lk = left.withColumn(key, F.nullif(left_expr, F.lit("")))
    rk = right.withColumn(key, right_expr).where(F.col(key).isNotNull() & (F.col(key) != ""))
    return lk.join(rk, key, how)


def join_priority_fallback(entities: DataFrame, key: str,
                           reg_a: DataFrame, a_id: str,
                           reg_b: DataFrame, b_id: str,
                           a_condition: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Link to registry A; use registry B only where A found nothing.

    Both registries are first made unique on the key, so neither join can fan
    out and the result has exactly one row per entity row (A before B).
    ``a_condition`` is an extra ON predicate on A: when false the entity row is
    kept with A's columns null (a conditional left join, not a filter)."""
    a = unique_registry(reg_a, key, a_id).withColumnRenamed(key, "__ka")
    b = unique_registry(reg_b, key, b_id).withColumnRenamed(key, "__kb")
    cond_a = F.col(key) == F.col("__ka")
    if a_condition is not None:
        cond_a = cond_a & a_condition(a)
    linked = entities.join(a, cond_a, "left")
    cond_b = (F.col(key) == F.col("__kb")) & F.col(a_id).isNull()
    linked = linked.join(b, cond_b, "left")
    return (linked.withColumn("linked_id", F.coalesce(F.col(a_id), F.col(b_id)))
                  .withColumn("link_source",
                              F.when(F.col(a_id).isNotNull(), F.lit("A"))
                               .when(F.col(b_id).isNotNull(), F.lit("B")))
                  .drop("__ka", "__kb"))


def join_crossref(left: DataFrame, left_key: str, left_aggs: Sequence[Column],
                  right: DataFrame, right_key: str, right_aggs: Sequence[Column],
                  key: str = "entity_id") -> DataFrame:
    """Entities present in both facts, with per-side totals.  Each side is
    aggregated to one row per key *before* the join (partial aggregation on
    the map side), so the join is 1:1 and totals are never multiplied."""
    l = left.groupBy(F.col(left_key).alias(key)).agg(*left_aggs)
    r = right.groupBy(F.col(right_key).alias(key)).agg(*right_aggs)
    return l.join(r, key, "inner")


def join_counts_zero_fill(base: DataFrame, counts: DataFrame, on,
                          count_cols: Sequence[str]) -> DataFrame:
    """Left join an aggregate and turn missing counts into 0."""
    out = base.join(counts, on, "left")
    for c in count_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def semi_latest_period(df: DataFrame, period_cols: Sequence[str]) -> DataFrame:
    """join_tuple_in: rows whose (year, month) equals the latest pair.  The
    latest pair is a one-row global aggregate, so broadcasting it is bounded."""
    latest = df.agg(F.max(F.struct(*period_cols)).alias("__p")).select("__p.*")
    return df.join(F.broadcast(latest), list(period_cols), "left_semi")
