"""Keyed merge that rewrites only the files which hold a touched key.

``upsert_by_key`` rewrites whole partitions in place; here a table keeps, beside
its Parquet files, a key sketch per file, and a merge leaves all other files
alone:

    candidates = files whose key range and Bloom filter may hold a batch key,
                 and files without a sketch
    touched    = candidates that do hold one (their key columns are read)
    new files  = rows of touched files without the batch's keys, and the batch
    version    = live files - touched + new

* **Sketch** (``_sketches``): per file the smallest and largest key and a Bloom
  filter of 64-bit words, one row per word that is not empty.  A key sets a few
  bits of one word, so the filter is built by ``bit_or``, and a batch is tested
  by an equi-join on (filter size, word) with the range and the bits in the join
  condition; pairs of keys and files are never shuffled.  It has no false
  negative; a false positive costs a read of key columns.
* **Version** (``_versions``): the list of live files.  It is written under
  another name and renamed, so readers see the table before or after a merge,
  and files of a merge that died are in no list and are never read.
* Files are written in ranges of (partition, key), which keeps key ranges short.

The key alone decides: a key that arrives with another partition value leaves
its old file.  Null keys are equal, and so are 0.0 and -0.0.  One writer at a
time.  What the driver holds is lists of files, as Spark's own scans do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from civitas.operators.dedup import dedup_on_keys
from civitas.operators.upsert import (check_types, same_key_columns, same_keys, schema_sync,
                                      union_schema)
from civitas.session import (materialize_table_at, path_exists, plain_names, remove_path,
                             work_dir)

BITS_PER_KEY = 12
BITS_SET = 4            # of one 64-bit word


@dataclass(frozen=True)
class MergeResult:
    version: int
    rows_written: int
    files_written: int
    files_removed: int
    files_kept: int


# ---- paths and versions -----------------------------------------------------

def _same_spelling(spark: SparkSession, uris) -> list[str]:
    """File names as ``_metadata.file_path`` has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [path(p).toUri().toString() for p in plain_names(spark, uris)]


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = f"{path}/_versions"
    if not path_exists(spark, root):
        return []
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in
             p.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"v=(\d+)", n) for n in names) if m)


def _commit(spark: SparkSession, path: str, version: int, files: Sequence[str],
            schema: StructType) -> None:
    """Writes the list of live files and the table's columns, then renames."""
    sc = spark.sparkContext
    tmp = f"{path}/_versions/.{uuid.uuid4().hex}"
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{tmp}/files")
    spark.createDataFrame([], schema).write.parquet(f"{tmp}/schema")
    src, dst = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (tmp, f"{path}/_versions/v={version}"))
    fs = dst.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise RuntimeError(f"version {version} of {path} was written by another job")


def live_files(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    found = _versions(spark, path)
    if not found:
        return []
    v = found[-1] if version is None else version
    return [r.file for r in spark.read.schema("file string").parquet(f"{path}/_versions/v={v}/files").collect()]


def _read(spark: SparkSession, path: str, schema: StructType, files: Sequence[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    names = plain_names(spark, files)
    return spark.read.schema(schema).option("basePath", path).parquet(*names).select(*schema.names)


def table_schema(spark: SparkSession, path: str, version: int | None = None) -> StructType:
    v = _versions(spark, path)[-1] if version is None else version
    return spark.read.parquet(f"{path}/_versions/v={v}/schema").schema


def read_keyed_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version (the last one), or None."""
    if not _versions(spark, path):
        return None
    return _read(spark, path, table_schema(spark, path, version), live_files(spark, path, version))


# ---- sketches ---------------------------------------------------------------

def _plain_key(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Equal keys have equal values: -0.0 becomes 0.0."""
    return [(F.col(k) + F.lit(0.0).cast(df.schema[k].dataType)).alias(k)
            if isinstance(df.schema[k].dataType, (FloatType, DoubleType)) else F.col(k) for k in keys]


def _hashed(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """key, hash, mask (the bits a key sets in its word) and ``more``."""
    cols = _plain_key(df, keys)
    other = F.xxhash64(F.lit(17), *cols)
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(other, {6 * i}) & 63 as int))")
            for i in range(BITS_SET)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return df.select(F.struct(*cols).alias("key"), F.xxhash64(*cols).alias("hash"),
                     other.alias("other"), *more).withColumn("mask", mask).drop("other")


def sketch_files(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """file, words, word, bits, lo, hi: the sketches of the files ``rows`` is read
    from; ``words`` is a power of two that fits the file's number of rows."""
    each = _hashed(rows, keys, F.col("_metadata.file_path").alias("file"))
    size = each.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    size = size.select("file", "lo", "hi", F.expr(
        f"shiftleft(1L, cast(ceil(log2(greatest(n * {BITS_PER_KEY} / 64, 1))) as int))").alias("words"))
    return (each.join(size.select(F.col("file").alias("f"), "words", "lo", "hi"), F.col("file") == F.col("f"))
            .groupBy("file", "words", F.col("hash").bitwiseAND(F.col("words") - 1).alias("word"))
            .agg(F.bit_or("mask").alias("bits"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))


def candidate_files(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str],
                    live: Sequence[str]) -> list[str]:
    """The live files that may hold a key of ``batch``: those whose sketch says so
    and those that have none."""
    if not path_exists(spark, f"{path}/_sketches"):
        return list(live)
    sketches = spark.read.option("mergeSchema", "true").parquet(f"{path}/_sketches")
    known = {r.file for r in sketches.select("file").distinct().collect()}
    sizes = [r.words for r in sketches.select("words").distinct().collect()]  # powers of two
    probe = _hashed(batch, keys).select(
        "key", "mask", "hash", F.explode(F.array(*[F.lit(w).cast("long") for w in sizes])).alias("size"))
    probe = probe.withColumn("at", F.col("hash").bitwiseAND(F.col("size") - 1))
    hit = sketches.join(
        probe, (F.col("words") == F.col("size")) & (F.col("word") == F.col("at"))
        & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        & (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
    found = {r.file for r in hit.select("file").distinct().collect()}
    return [f for f in live if f in found or f not in known]


# ---- writing ----------------------------------------------------------------

def _add_files(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str],
               partition_by: Sequence[str]) -> list[str]:
    """Writes ``rows`` (read from a table: sampling them is cheap) as new files in
    ranges of (partition, key), and their sketches."""
    order = [*partition_by, *keys]
    order = list(dict.fromkeys(order))
    into = f"{path}/__load={uuid.uuid4().hex}"
    w = rows.repartitionByRange(*order).sortWithinPartitions(*order).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(into)
    if rows.isEmpty():
        return []
    schema = StructType([f for f in rows.schema.fields])
    new = spark.read.schema(schema).option("basePath", into).parquet(into)
    sketch_files(new, keys).write.mode("append").parquet(f"{path}/_sketches")
    return _same_spelling(spark, new.inputFiles())


def write_keyed_files(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str],
                      partition_by: Sequence[str] = (), prefer: Sequence | None = None) -> MergeResult:
    """full_refresh: a new version that holds ``df`` only, one row per key."""
    keys, partition_by = list(keys), list(partition_by)
    old, found = live_files(spark, path), _versions(spark, path)
    staged = work_dir(spark, "merge-stage")
    rows = materialize_table_at(dedup_on_keys(df, keys, prefer), staged)
    files = _add_files(spark, rows, path, keys, partition_by)
    version = found[-1] + 1 if found else 0
    _commit(spark, path, version, files, rows.schema)
    n = rows.count()
    remove_path(spark, staged)
    return MergeResult(version, n, len(files), len(old), 0)


def merge_keyed_files(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str],
                      partition_by: Sequence[str] = (), prefer: Sequence | None = None,
                      drop_missing: bool = False) -> MergeResult:
    """Rows with a key of the batch are replaced, new keys inserted, other rows
    kept.  ``drop_missing``: columns the batch no longer has leave the table
    (sync all columns); otherwise they stay and are null in new rows.  A merge
    that died can be run again: its files are in no version."""
    keys, partition_by = list(keys), list(partition_by)
    found = _versions(spark, path)
    if not found:
        return write_keyed_files(spark, batch, path, keys, partition_by, prefer)
    have = table_schema(spark, path)
    check_types(have, batch.schema)
    schema = batch.schema if drop_missing else union_schema(have, batch.schema)
    batch = schema_sync(dedup_on_keys(batch, keys, prefer), schema).persist(StorageLevel.MEMORY_AND_DISK)
    staged = work_dir(spark, "merge-stage")
    try:
        live = live_files(spark, path)
        maybe = candidate_files(spark, path, batch, keys, live)
        wanted = same_key_columns(batch, keys)
        touched = _same_spelling(spark, [r[0] for r in _read(spark, path, have, maybe)
                                         .select(*keys, F.col("_metadata.file_path").alias("file"))
                                         .join(wanted, same_keys(keys), "left_semi")
                                         .select("file").distinct().collect()]) if maybe else []
        rest = schema_sync(_read(spark, path, have, touched), schema) \
            .join(wanted, same_keys(keys), "left_anti")
        rows = materialize_table_at(rest.unionByName(batch), staged)
        files = _add_files(spark, rows, path, keys, partition_by)
        gone = set(touched)
        kept = [f for f in live if f not in gone]
        _commit(spark, path, found[-1] + 1, kept + files, schema)
        return MergeResult(found[-1] + 1, rows.count(), len(files), len(gone), len(kept))
    finally:
        batch.unpersist()
        remove_path(spark, staged)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data files that the last version does not list; returns how many.
    For when no reader of an older version and no writer is at work."""
    live = set(live_files(spark, path))
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    gone, it = 0, fs.listFiles(root, True)
    while it.hasNext():
        p = it.next().getPath()
        uri = _same_spelling(spark, [p.toUri().toString()])[0]
        if "/__load=" in uri and uri.endswith(".parquet") and uri not in live:
            fs.delete(p, False)
            gone += 1
    return gone
