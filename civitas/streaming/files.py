"""Period files picked up once, merged by key, aggregated by event time.

* ``stream_period_files``  file source over a landing folder (explicit
  schema, partition folders as columns, bounded files per micro-batch).
* ``run_available_now``    process everything that is there and stop
  (``trigger(availableNow=True)``) with a checkpoint in the shared folder,
  so a restarted job resumes instead of re-reading.
* ``stream_upsert``        ``foreachBatch`` -> keyed upsert: replaying a
  micro-batch after a failure rewrites the same rows, so it is idempotent.
* ``stream_event_time_agg`` windowed aggregate with a watermark, for results
  that may leave late rows out.
* ``stream_additive_agg``  complete for any lateness: every micro-batch appends
  its partial sums once, and reading adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civitas.operators.file_merge import merge_keyed_files
from civitas.operators.upsert import upsert_by_key
from civitas.session import path_exists, remove_path


def stream_period_files(spark: SparkSession, landing: str, schema: StructType,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(landing)


def run_available_now(df: DataFrame, on_batch: Callable[[DataFrame, int], None],
                      checkpoint: str, output_mode: str = "append",
                      name: str | None = None) -> None:
    w = (df.writeStream.foreachBatch(on_batch).outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if name:
        w = w.queryName(name)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_upsert(spark: SparkSession, stream: DataFrame, target: str, keys: Sequence[str],
                  partition_by: Sequence[str], checkpoint: str,
                  prefer: Sequence | None = None, output_mode: str = "append",
                  keys_may_move: bool | None = None) -> None:
    """Merge every micro-batch into ``target`` by key (duplicates inside a
    batch are resolved by ``prefer`` then the whole row)."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        upsert_by_key(spark, batch, target, keys, partition_by, prefer=prefer,
                      keys_may_move=keys_may_move)
    run_available_now(stream, merge, checkpoint, output_mode)


def stream_merge_files(spark: SparkSession, stream: DataFrame, target: str, keys: Sequence[str],
                       partition_by: Sequence[str], checkpoint: str,
                       prefer: Sequence | None = None) -> None:
    """``stream_upsert`` into a table of ``file_merge``: a micro-batch rewrites only
    the files that hold one of its keys, and readers see a version before or after
    it.  A replayed batch replaces its own rows."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            merge_keyed_files(spark, batch, target, keys, partition_by, prefer)
    run_available_now(stream, merge, checkpoint)


def stream_dedup(stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
                 delay: str | None = None) -> DataFrame:
    """Streaming dedup with bounded state: only when an event-time watermark
    bounds how long a key must be remembered.  Rows older than the watermark
    are dropped by Spark, so jobs that must keep every row dedup in the
    keyed upsert instead (``stream_upsert``)."""
    if event_time is None:
        return stream
    return stream.withWatermark(event_time, delay or "1 day").dropDuplicatesWithinWatermark(list(keys))


def stream_event_time_agg(stream: DataFrame, event_time: str, window: str, delay: str,
                          group: Sequence[Column], aggs: Sequence[Column]) -> DataFrame:
    """``withWatermark`` + ``groupBy(window(...), ...)``: state for a window is
    dropped once the watermark passes its end, so state stays bounded."""
    return (stream.withWatermark(event_time, delay)
                  .groupBy(F.window(event_time, window).alias("w"), *group).agg(*aggs))


def stream_additive_agg(spark: SparkSession, stream: DataFrame, deltas: str, group: Sequence[Column],
                        sums: dict[str, Column], checkpoint: str) -> None:
    """Writes one delta per micro-batch under ``deltas``: the sums of its rows by
    group (``sums``: name -> an aggregate that can be added up).  A batch that is
    repeated after a failure overwrites its own delta, so each row counts once;
    nothing depends on the order in which rows arrive, and no state is kept."""
    def append(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()])
              .write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}"))
    if not path_exists(spark, deltas):  # columns for a stream without rows
        append(spark.createDataFrame([], stream.schema), -1)
    run_available_now(stream, append, checkpoint)


def _numbered(spark: SparkSession, root: str, key: str) -> list[int]:
    """The numbers n of the folders ``key=n`` under ``root``."""
    if not path_exists(spark, root):
        return []
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in
             p.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n[len(key) + 1:]) for n in names if n.startswith(f"{key}="))


def read_additive_agg(spark: SparkSession, deltas: str, group: Sequence[str],
                      sums: Sequence[str]) -> DataFrame:
    """The totals of all deltas: one row per group, a null group included."""
    rows, folds = spark.read.option("basePath", deltas).parquet(deltas), \
        _numbered(spark, f"{deltas}/_folded", "upto")
    if folds:
        rows = rows.where(F.col("batch") > folds[-1]).select(*group, *sums).unionByName(
            spark.read.parquet(f"{deltas}/_folded/upto={folds[-1]}"))
    return rows.groupBy(*group).agg(*[F.sum(n).alias(n) for n in sums])


def fold_additive_agg(spark: SparkSession, deltas: str, group: Sequence[str],
                      sums: Sequence[str]) -> None:
    """Adds all deltas up into one table, so that reading does not slow down as
    batches come; the deltas it covers, and older folds, are then removed.  Not
    while a reader is at work."""
    batches, folds = _numbered(spark, deltas, "batch"), _numbered(spark, f"{deltas}/_folded", "upto")
    last = batches[-1]
    if folds and last <= folds[-1]:
        return
    read_additive_agg(spark, deltas, group, sums).write.mode("overwrite").parquet(f"{deltas}/_folded/.new")
    sc = spark.sparkContext
    src, dst = (sc._jvm.org.apache.hadoop.fs.Path(f"{deltas}/_folded/{n}") for n in (".new", f"upto={last}"))
    src.getFileSystem(sc._jsc.hadoopConfiguration()).rename(src, dst)
    for n in batches[:-1]:  # the last one keeps the columns of ``batch``
        remove_path(spark, f"{deltas}/batch={n}")
    for n in folds:
        remove_path(spark, f"{deltas}/_folded/upto={n}")


def skip_existing_periods(spark: SparkSession, df: DataFrame, landing: str, period: str,
                          schema: StructType) -> DataFrame:
    """period_skip_existing: rows of periods already present under
    ``landing`` are dropped before writing (anti-join on the period values
    found there), so re-running a landing job does not duplicate a period."""
    if not path_exists(spark, landing):
        return df
    existing = spark.read.schema(schema).parquet(landing).select(period).distinct()
    found = existing.withColumnRenamed(period, "__period")
    return df.join(found, F.col(period).eqNullSafe(F.col("__period")), "left_anti")


def skipped_periods(spark: SparkSession, df: DataFrame, landing: str, period: str,
                    schema: StructType) -> DataFrame:
    """What ``skip_existing_periods`` would leave out: the period and its rows in
    ``df``, for the load's report."""
    if not path_exists(spark, landing):
        return df.limit(0).groupBy(period).agg(F.count(F.lit(1)).alias("rows"))
    existing = spark.read.schema(schema).parquet(landing).select(F.col(period).alias("__period")).distinct()
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("rows")) \
        .join(existing, F.col(period).eqNullSafe(F.col("__period")), "left_semi")
