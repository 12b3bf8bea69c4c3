"""Nested JSON records -> typed columns with ``from_json`` and
struct paths; no Python per-record functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civitas.functions._util import col

JSON_OPTS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def scan_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as text (one record per line) plus its source file path."""
    return spark.read.text(path).select(F.col("value").alias("json"),
                                        F.col("_metadata.file_path").alias("file_path"))


def parse_records(df: DataFrame, json_col: str, schema: StructType | str,
                  alias: str = "r") -> DataFrame:
    """scan_json_records: parse with an explicit schema; a malformed record is
    a null struct, not a failed job."""
    return df.withColumn(alias, F.from_json(col(json_col), schema, JSON_OPTS))


def singleton_to_list(json_col, path: str, element_schema: str) -> Column:
    """A child that may be null, one object or a list of objects -> a list.
    The child is taken as text first: ``from_json`` with an array schema wraps
    a single *root* object into a one-element list, which it does not do for
    a nested field; a missing child becomes an empty list."""
    child = F.get_json_object(col(json_col), path)
    parsed = F.from_json(child, f"array<{element_schema}>", JSON_OPTS)
    return F.coalesce(parsed, F.array().cast(f"array<{element_schema}>"))


def scan_json_drifting(spark: SparkSession, path: str, fields: Mapping[str, tuple[str, str]],
                       required: Sequence[str] = ()) -> DataFrame:
    """JSON lines whose records change shape: each line is parsed to a VARIANT and
    ``fields`` (name -> (path, type)) are read from it, so no schema is inferred
    and no record fails the job.

    * a value of another type is cast where that is possible (the text "12.5" as a
      number); where it is not, the field is null and its name is in ``drifted``;
    * ``rejected`` is the reason a line is no record: 'broken' (no JSON), 'shape'
      (no object) or 'missing' (a ``required`` field is not there or null).
    All lines are kept, with their text in ``raw``; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))
    typed = {n: F.try_variant_get("v", p, t) for n, (p, t) in fields.items()}
    found = {n: F.try_variant_get("v", p, "variant") for n, (p, _) in fields.items()}
    there = {n: f.isNotNull() & ~F.is_variant_null(f) for n, f in found.items()}
    drifted = F.array_compact(F.array(*[F.when(there[n] & typed[n].isNull(), F.lit(n)) for n in fields]))
    gone = F.lit(False)
    for n in required:
        gone = gone | ~there[n] | typed[n].isNull()
    reason = (F.when(F.col("v").isNull(), "broken")
              .when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<")), "shape")
              .when(gone, "missing"))
    return lines.select(*[c.alias(n) for n, c in typed.items()], drifted.alias("drifted"),
                        reason.alias("rejected"), "raw")


def observed_schema(spark: SparkSession, path: str) -> str:
    """The schema that all records of the JSON lines together have, for the report
    of a drift."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return v.agg(F.schema_of_variant_agg("v")).first()[0]
