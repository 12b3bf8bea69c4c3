"""Streaming dedup: each row leaves once, as kept, duplicate or late."""

import datetime as dt
import os
import random
from collections import Counter

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from civitas.session import work_dir
from civitas.streaming.dedup_state import dedup_available_now, read_outcomes
from civitas.streaming.files import stream_period_files

SCHEMA = StructType([StructField("id", LongType()), StructField("t", TimestampType()),
                     StructField("v", DoubleType()), StructField("s", StringType())])
BASE = dt.datetime(2024, 1, 1)
DELAY = dt.timedelta(days=5)


def _land(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/landing")


def _run(spark, root):
    stream = stream_period_files(spark, f"{root}/landing", SCHEMA)
    dedup_available_now(spark, stream, ["id"], "t", "5 days", f"{root}/out", f"{root}/ck", shards=3)


def _outcomes(spark, root):
    return Counter((r.id, r.t, r.v, r.s, r.outcome) for r in
                   read_outcomes(spark, f"{root}/out", SCHEMA).collect())


def test_every_row_leaves_once_also_after_a_replay(spark):
    rng, root = random.Random(4), work_dir(spark, "t-outcomes")
    assert read_outcomes(spark, f"{root}/out", SCHEMA).count() == 0
    batches = []
    for i in range(2):
        batches.append([(2 ** 53 + rng.randrange(60), BASE + dt.timedelta(days=6 * i, hours=rng.randrange(300)),
                         rng.random(), f"{i}-{j}") for j in range(80)])
        _land(spark, root, batches[-1])
        _run(spark, root)
    rows = [r for b in batches for r in b]
    got = _outcomes(spark, root)
    assert Counter(k[:4] for k in got.elements()) == Counter(rows)

    # the rule, from the rows alone: the watermark is that of the batches before
    watermark = max(r[1] for r in batches[0]) - DELAY
    late = {r for r in batches[1] if r[1] < watermark}
    assert {k[:4] for k in got if k[4] == "late"} == late
    kept = [k[0] for k in got.elements() if k[4] == "kept"]
    on_time = [r for r in rows if r not in late]
    assert set(kept) == {r[0] for r in on_time}
    # a key is kept anew only when the watermark has passed its last row
    old = {i for i in kept if kept.count(i) > 1}
    assert all(max(r[1] for r in batches[0] if r[0] == i) < watermark for i in old)

    # the last batch is done again, as after a crash before its commit
    commits = sorted((f for f in os.listdir(f"{root}/ck/commits") if f.isdigit()), key=int)
    last = commits[-1]
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{root}/ck/commits/{f}"):
            os.remove(f"{root}/ck/commits/{f}")
    _run(spark, root)
    assert _outcomes(spark, root) == got


def test_null_keys_and_times(spark):
    root = work_dir(spark, "t-outcomes2")
    _land(spark, root, [(None, BASE, 1.0, "a"), (None, BASE, 2.0, "b"), (1, None, 3.0, "c"), (1, BASE, 4.0, "d"),
                        (None, None, 5.0, "e")])
    _run(spark, root)
    got = _outcomes(spark, root)
    assert sum(got.values()) == 5 and not any(k[4] == "late" for k in got)
    assert Counter((k[0], k[4]) for k in got.elements()) == \
        {(None, "kept"): 1, (None, "duplicate"): 2, (1, "kept"): 1, (1, "duplicate"): 1}
