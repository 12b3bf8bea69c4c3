"""Code -> label lookups as data (a small broadcast table), not CASE chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.functions._util import col


def coalesce_label(c, label: str = "N/D") -> Column:
    return F.coalesce(col(c), F.lit(label))


def label_map(c, mapping: dict[str, str]) -> Column:
    """Short literal map (a handful of codes): code -> label, default the code."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(c)), col(c))


def lookup_label(spark: SparkSession, df: DataFrame, key_expr: Column,
                 mapping: dict[str, str], out: str,
                 default: Column | None = None) -> DataFrame:
    """category_map: join a lookup table built from ``mapping`` (its size is
    fixed by the code, so broadcasting it is safe) and fall back to
    ``default`` (lower(trim(raw)) in the reference) when unmatched."""
    lut = spark.createDataFrame(list(mapping.items()), "lk_key string, lk_label string")
    joined = (df.withColumn("__lk", key_expr)
                .join(F.broadcast(lut), F.col("__lk") == F.col("lk_key"), "left"))
    fallback = default if default is not None else F.col("__lk")
    return (joined.withColumn(out, F.coalesce(F.col("lk_label"), fallback))
                  .drop("__lk", "lk_key", "lk_label"))
