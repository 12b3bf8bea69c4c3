"""Streaming dedup that loses no row: kept, duplicate or late, each row once.

``dropDuplicatesWithinWatermark`` drops late rows without a trace.  Here every
row leaves with an ``outcome``:

* ``late``       its event time is under the watermark (the newest event time of
                 earlier micro-batches less ``delay``), so its key may be forgotten;
* ``duplicate``  its key has been seen within the time to live;
* ``kept``       the first of its key.

Keys are dealt into shards, the unit of state (``transformWithState``): a shard
remembers 128 bits and the last event time of each key, and forgets a key once the
watermark has passed that time (a row that repeats it then is late).  Its memory is
its share of the keys within ``delay``; more shards make shares smaller.  Rows of
one key share a shard; they are read one after another and take no memory.

``write_outcomes`` writes a micro-batch under its id and outcome and replaces what
an earlier try of the same batch left, so a replayed batch is not doubled.

Null keys are equal.  A row without event time is never late, and its key counts as
seen at the newest event time of its shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from civitas.session import path_exists
from civitas.streaming.files import run_available_now

SHARDS = 64
OUTCOMES = ("kept", "duplicate", "late")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Remember(StatefulProcessor):
    """One shard: a packed table of (128-bit key, last event time)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "keys binary, times binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import numpy as np
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held: dict[bytes, int] = {}
        if self._seen.exists():
            keys, times = self._seen.get()
            times = np.frombuffer(bytes(times), "<i8")
            alive = np.flatnonzero(times >= watermark).tolist()
            keys = bytes(keys)
            held = {keys[16 * i:16 * i + 16]: int(times[i]) for i in alive}
        newest = max(held.values(), default=watermark)
        for r in rows:
            at, k = r["__at"], r["__k1"].to_bytes(8, "little", signed=True) \
                + r["__k2"].to_bytes(8, "little", signed=True)
            newest = newest if at is None else max(newest, at)
            if at is not None and at < watermark:
                outcome = "late"
            else:
                outcome = "duplicate" if k in held else "kept"
                held[k] = max(held.get(k, at if at is not None else newest), at if at is not None else newest)
            yield Row(row=r["row"], outcome=outcome)
        self._seen.update((b"".join(held), np.fromiter(held.values(), "<i8", len(held)).tobytes()))

    def close(self) -> None:
        pass


def stream_outcomes(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str,
                    shards: int = SHARDS) -> DataFrame:
    """The rows of ``stream`` with their ``outcome``.  ``event_time`` is a TIMESTAMP
    column; ``delay`` bounds lateness and is the time to live of a key."""
    schema = stream.schema
    # the watermark rides on a column of its own, which is gone before the state:
    # Spark drops late rows by that column only, and here they are an output
    rows = stream.withColumn("__wm", F.col(event_time)).withWatermark("__wm", delay).select(
        F.pmod(F.xxhash64(F.lit(3), *keys), F.lit(shards)).alias("__shard"),
        F.xxhash64(*keys).alias("__k1"), F.xxhash64(F.lit(7), *keys).alias("__k2"),
        F.unix_micros(event_time).alias("__at"), F.struct(*schema.names).alias("row"))
    out = rows.groupBy("__shard").transformWithState(
        statefulProcessor=_Remember(),
        outputStructType=StructType([StructField("row", schema), StructField("outcome", StringType())]),
        outputMode="Append", timeMode="EventTime")
    return out.select("row.*", "outcome")


def write_outcomes(out: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: one folder per micro-batch and outcome."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("outcome").parquet(f"{out}/batch={batch_id}")
    return sink


def read_outcomes(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All rows written so far with ``batch`` and ``outcome``; none before the
    first batch."""
    full = StructType([*schema.fields, StructField("batch", StringType()),
                       StructField("outcome", StringType())])
    if not path_exists(spark, out):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", out).parquet(out)


def dedup_available_now(spark: SparkSession, stream: DataFrame, keys: Sequence[str], event_time: str,
                        delay: str, out: str, checkpoint: str, shards: int = SHARDS) -> None:
    """Takes what is there, writes each row under its outcome and stops."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # the store that this kind of state needs
    try:
        run_available_now(stream_outcomes(stream, keys, event_time, delay, shards),
                          write_outcomes(out), checkpoint)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
