"""Data-quality assertions: not_null / unique /
accepted_values as one aggregate pass per table, reported as rows
(table, column, check, severity, failures)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.operators.aggregates import exact_ratio_sql

REPORT_SCHEMA = "table_name string, column_name string, check_name string, severity string, failures bigint"


def dq_report(df: DataFrame, table_name: str,
              not_null: Sequence[str] = (),
              unique: Sequence[Sequence[str]] = (),
              accepted_values: Mapping[str, Sequence[str]] | None = None,
              severity: Mapping[str, str] | None = None) -> DataFrame:
    """failures = null rows (not_null); key values present more than once
    (unique); distinct non-null values outside the list (accepted_values)."""
    severity = dict(severity or {})
    accepted_values = dict(accepted_values or {})
    sev = lambda check, c: F.lit(severity.get(f"{check}:{c}", "error"))
    parts = []
    if not_null or accepted_values:
        aggs = [F.count_if(F.col(c).isNull()).alias(f"nn_{i}") for i, c in enumerate(not_null)]
        aggs += [F.count_distinct(F.when(~F.col(c).isin(*vals), F.col(c))).alias(f"av_{i}")
                 for i, (c, vals) in enumerate(accepted_values.items())]
        one = df.agg(*aggs)
        rows = [F.struct(F.lit(c).alias("column_name"), F.lit("not_null").alias("check_name"),
                         sev("not_null", c).alias("severity"),
                         F.col(f"nn_{i}").cast("bigint").alias("failures"))
                for i, c in enumerate(not_null)]
        rows += [F.struct(F.lit(c).alias("column_name"), F.lit("accepted_values").alias("check_name"),
                          sev("accepted_values", c).alias("severity"),
                          F.col(f"av_{i}").cast("bigint").alias("failures"))
                 for i, c in enumerate(accepted_values)]
        parts.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    for key in unique:
        key = list(key)
        name = ",".join(key)
        dup = (df.groupBy(*key).count().where(F.col("count") > 1)
                 .agg(F.count(F.lit(1)).cast("bigint").alias("failures"))
                 .select(F.lit(name).alias("column_name"), F.lit("unique").alias("check_name"),
                         sev("unique", name).alias("severity"), "failures"))
        parts.append(dup)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(table_name).alias("table_name"), "*")


def dq_key_links(df: DataFrame, linked_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose entity link found an id (the reference reports ~90 %)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count(F.col(linked_id)).cast("bigint").alias("matched"),
        F.expr(exact_ratio_sql(f"count({linked_id})", "count(*)", 4, 0)).alias("match_rate"))
