"""Incremental load and keyed upsert on partitioned Parquet.

Plain Parquet has no row-level MERGE, so an upsert rewrites only the
partitions the batch touches:

    affected  = target rows in the touched partitions
    merged    = affected anti-join batch keys  UNION  batch
    staged    -> a new folder under spark.checkpoint.dir (Spark cannot
                 overwrite a path it is reading)
    target    <- staged, with dynamic partition overwrite: untouched
                 partitions are never read or written.

The list of touched partition values is the only thing collected: its size
is the number of partitions in one batch, not the number of rows.
Where a table format with MERGE is available the same contract maps onto
``MERGE INTO``; this module keeps to Parquet so it runs anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civitas.operators.dedup import dedup_on_keys
from civitas.session import path_exists, remove_path, work_dir


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` (schemas of all its files merged), or None."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without data files yet
            return None
        raise


def current_watermark(spark: SparkSession, path: str, col: str, default: Any = None) -> Any:
    """Target high-watermark ``max(col)``: one scalar (a one-row aggregate).
    It is turned into a literal so the source filter is static and prunes
    partitions / row groups."""
    return high_watermark(read_target(spark, path), col, default)


def high_watermark(table: DataFrame | None, col: str, default: Any = None) -> Any:
    """``max(col)`` of a table, however it is kept."""
    wm = None if table is None else table.agg(F.max(col)).first()[0]
    return default if wm is None else wm


def watermark_filter(src: DataFrame, col: str, watermark: Any, strict: bool = False,
                     lookback: Any = None) -> DataFrame:
    """watermark_filter_ge: ``>=`` (re-read the last period) or
    watermark_filter_gt: strict ``>`` (loses late rows in the last loaded
    period, SURVEY 2.13-4).  ``lookback`` is subtracted from
    the watermark to re-read late arrivals."""
    if watermark is None:
        return src
    wm = F.lit(watermark)
    if lookback is not None:
        wm = wm - F.lit(lookback)
    return src.where(F.col(col) > wm) if strict else src.where(F.col(col) >= wm)


def check_types(target: StructType, batch: StructType) -> None:
    """Refuses a batch whose column has another type than in the target: files
    of two types under one table can no longer be read together."""
    have = {f.name: f.dataType for f in target.fields}
    odd = [f"{f.name}: {have[f.name].simpleString()} -> {f.dataType.simpleString()}"
           for f in batch.fields if f.name in have and have[f.name] != f.dataType]
    if odd:
        raise ValueError("the batch changes column types; cast it or rewrite the table: "
                         + ", ".join(odd))


def same_keys(keys: Sequence[str], prefix: str = "__k_"):
    """Null-safe equality of ``keys`` with columns renamed by ``same_key_columns``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def same_key_columns(df: DataFrame, keys: Sequence[str], prefix: str = "__k_") -> DataFrame:
    return df.select(*[F.col(k).alias(prefix + k) for k in keys])


def schema_sync(df: DataFrame, schema: StructType) -> DataFrame:
    """conform to ``schema``: missing columns become typed nulls, extra ones
    are dropped, order follows the schema (sync all columns on merge)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def union_schema(a: StructType, b: StructType) -> StructType:
    """b's columns in b's order, then a's extra ones (new columns win)."""
    names = {f.name for f in b.fields}
    return StructType(list(b.fields) + [f for f in a.fields if f.name not in names])


def write_parquet_keyed(df: DataFrame, path: str, keys: Sequence[str],
                        partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
                        mode: str = "overwrite", dynamic: bool = False,
                        cluster: bool = True) -> int:
    """Dedup on the key (deterministic), cluster rows by partition, sort within
    files for min/max row-group skipping, write; returns the rows written
    (counted by an ``Observation`` riding the write, no second pass)."""
    out = dedup_on_keys(df, keys) if keys else df
    if partition_by and cluster:
        # REBALANCE on the partition columns: rows of one partition land in
        # few files, and AQE splits a partition holding a third of the data
        # over several tasks and merges tiny ones (a plain hash repartition
        # would give a hot partition a single task; range partitioning would
        # need a sampling pass over the input plan)
        out = out.hint("rebalance", *partition_by)
    if cluster and (sort_by or partition_by):
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    obs = Observation("write_parquet_keyed")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = out.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get.get("rows", 0))


def full_refresh(df: DataFrame, path: str, keys: Sequence[str],
                 partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> int:
    return write_parquet_keyed(df, path, keys, partition_by, sort_by, mode="overwrite")


def upsert_by_key(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str],
                  partition_by: Sequence[str], sort_by: Sequence[str] = (),
                  keys_may_move: bool | None = None, prefer: Sequence | None = None) -> int:
    """Merge ``batch`` into the partitioned Parquet table at ``path``: rows
    with a key in the batch are replaced, new keys inserted, other rows kept.
    The key alone decides: a key that arrives with another partition value
    leaves its old partition.  That search over the target's keys is left out
    only where the partition columns are part of the key, or where the caller
    vouches for it with ``keys_may_move=False``.  Null keys are equal.
    Returns the number of rows written to the touched partitions.

    The batch is idempotent by key: after a crash in the middle of the last
    write, running it again completes it."""
    keys, partition_by = list(keys), list(partition_by)
    if keys_may_move is None:
        keys_may_move = not set(partition_by) <= set(keys)
    sort_by = list(sort_by) or keys
    target = read_target(spark, path)
    if target is None:
        return write_parquet_keyed(dedup_on_keys(batch, keys, prefer), path, [],
                                   partition_by, sort_by)
    # the deduplicated batch feeds three steps (touched partitions, merge,
    # key list): keep it for the duration of this merge (memory and disk,
    # recomputed from its lineage if an executor is lost)
    batch = dedup_on_keys(batch, keys, prefer).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _merge(spark, batch, target, path, keys, partition_by, sort_by, keys_may_move)
    finally:
        batch.unpersist()


def _merge(spark, batch, target, path, keys, partition_by, sort_by, keys_may_move) -> int:
    check_types(target.schema, batch.schema)
    schema = union_schema(target.schema, batch.schema)
    batch = schema_sync(batch, schema)
    batch_keys = same_key_columns(batch, keys)
    touched = batch.select(*partition_by)
    if keys_may_move:  # a key may leave its old partition: find it globally
        touched = touched.union(target.join(batch_keys, same_keys(keys), "left_semi")
                                .select(*partition_by))
    touched_vals = [tuple(r) for r in touched.distinct().collect()]

    affected = schema_sync(target.where(_partition_condition(partition_by, touched_vals)), schema)
    merged = affected.join(batch_keys, same_keys(keys), "left_anti").unionByName(batch)

    staged = work_dir(spark, "upsert-stage")
    # the staged copy is written as it comes (no sampling pass over the merge
    # plan); the final write clusters it, sampling the cheap Parquet copy
    write_parquet_keyed(merged, staged, [], partition_by, sort_by, cluster=False)
    restaged = spark.read.schema(schema).parquet(staged)
    written = restaged.select(*partition_by).distinct().collect()
    emptied = set(touched_vals) - {tuple(r) for r in written}
    n = write_parquet_keyed(restaged, path, [], partition_by, sort_by,
                            mode="overwrite", dynamic=True)
    if emptied:  # every row left these partitions (keys moved): drop their files
        _remove_partition_files(spark, path, partition_by, emptied)
    remove_path(spark, staged)
    return n


def _partition_condition(partition_by, values):
    cond = F.lit(False)
    for vals in values:
        c = F.lit(True)
        for name, v in zip(partition_by, vals):
            c = c & (F.col(name).isNull() if v is None else (F.col(name) == F.lit(v)))
        cond = cond | c
    return cond


def _remove_partition_files(spark: SparkSession, path: str, partition_by, values) -> None:
    """Dynamic overwrite never touches a partition that receives no rows, so a
    partition emptied by the merge is removed file by file.  Its files are
    found through the file-path metadata column under the partition filter
    (pruned to those partitions; no path-escaping rules copied)."""
    files = [r[0] for r in read_target(spark, path)
             .where(_partition_condition(partition_by, values))
             .select(F.col("_metadata.file_path")).distinct().collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, False)


LEDGER_SCHEMA = "source string, watermark string, rows bigint, loaded_at timestamp"


def record_watermark(spark: SparkSession, ledger: str, source: str, watermark: Any,
                     rows: int) -> None:
    """watermark_table: a small append-only Parquet ledger of loads."""
    row = spark.createDataFrame([(source, None if watermark is None else str(watermark),
                                  int(rows))], "source string, watermark string, rows bigint")
    row.withColumn("loaded_at", F.current_timestamp()).write.mode("append").parquet(ledger)


def ledger_watermark(spark: SparkSession, ledger: str, source: str) -> str | None:
    led = read_target(spark, ledger)
    if led is None:
        return None
    r = (led.where(F.col("source") == source)
            .agg(F.max_by("watermark", "loaded_at")).first())
    return r[0] if r else None
