"""scan_parquet / scan_parquet_glob and the catalog helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from civitas.schemas import TABLES


def scan_parquet(spark: SparkSession, path: str,
                 schema: StructType | None = None) -> DataFrame:
    """One Parquet file or dataset with an explicit schema (no inference)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def scan_parquet_glob(spark: SparkSession, root: str, schema: StructType,
                      merge_schema: bool = False) -> DataFrame:
    """All period files under ``root``; ``key=value`` folders become partition
    columns, so a filter on them prunes whole folders before any file opens."""
    return (spark.read.schema(schema)
            .option("mergeSchema", str(merge_schema).lower())
            .option("basePath", root)
            .parquet(root))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", TABLES[name])


def register_views(spark: SparkSession, sf_dir: str,
                   names: list[str] | None = None) -> list[str]:
    """Expose the input tables as temp views for ad-hoc SQL (lazy, no copy)."""
    names = names or list(TABLES)
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return names


def list_tables(spark: SparkSession) -> DataFrame:
    """list_tables: the catalog's view of what can be queried."""
    rows = [(t.name, t.tableType, bool(t.isTemporary))
            for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, table_type string, is_temporary boolean")


def adhoc_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """adhoc_sql: user SQL with named parameters bound as literals, never
    spliced into the text (the reference builds SQL strings from user input)."""
    return spark.sql(text, args=args or {})
