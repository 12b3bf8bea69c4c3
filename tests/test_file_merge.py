"""Merges by file: what is touched, what stays, sketches without false negatives."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from civitas.operators import file_merge as fm
from civitas.session import path_exists, plain_names, remove_path, work_dir

SCHEMA = "k long, p string, v string"


def _table(spark, rows, **kw):
    path = work_dir(spark, "t-merge") + "/t"
    fm.write_keyed_files(spark, spark.createDataFrame(rows, SCHEMA), path, ["k"], ["p"], **kw)
    return path


def _rows(spark, path, version=None):
    return sorted((tuple(r) for r in fm.read_keyed_files(spark, path, version).collect()), key=repr)


def _bytes(spark, files):
    out = {}
    for f in files:
        name = plain_names(spark, [f])[0].removeprefix("file:")
        with open(name, "rb") as h:
            out[f] = (os.stat(name).st_mtime_ns, hashlib.sha256(h.read()).hexdigest())
    return out


def test_only_files_with_a_touched_key_are_rewritten(spark):
    base = [(i, f"p{i // 250}", "old") for i in range(1000)]
    path = _table(spark, base)
    before = _bytes(spark, fm.live_files(spark, path))
    assert len(before) >= 4
    batch = [(10, "p0", "new"), (260, "p3", "moved"), (5000, "p9 %", "added")]
    res = fm.merge_keyed_files(spark, spark.createDataFrame(batch, SCHEMA), path, ["k"], ["p"])
    after = _bytes(spark, fm.live_files(spark, path))
    stayed = {f for f in before if f in after}
    assert res.files_kept == len(stayed) > 0 and all(before[f] == after[f] for f in stayed)
    assert res.files_removed == len(before) - len(stayed)
    # files that hold neither key 10 nor key 260 all stayed
    holds = {r[0] for r in fm._read(spark, path, fm.table_schema(spark, path), list(before)).where(
        "k in (10, 260)").select(F.col("_metadata.file_path")).collect()}
    assert set(before) - stayed == holds
    want = {k: (k, p, v) for k, p, v in base} | {k: (k, p, v) for k, p, v in batch}
    assert _rows(spark, path) == sorted(want.values(), key=repr)
    assert _rows(spark, path, 0) == sorted(base, key=repr)          # the earlier version is whole
    fm.merge_keyed_files(spark, spark.createDataFrame(batch, SCHEMA), path, ["k"], ["p"])
    assert _rows(spark, path) == sorted(want.values(), key=repr)    # replayed
    assert fm.vacuum(spark, path) > 0
    assert _rows(spark, path) == sorted(want.values(), key=repr)


def test_new_keys_rewrite_nothing(spark):
    path = _table(spark, [(i, "a", "x") for i in range(300)])
    res = fm.merge_keyed_files(spark, spark.createDataFrame([(-5, "a", "y"), (900, "b", "y")], SCHEMA),
                               path, ["k"], ["p"])
    assert res.files_removed == 0 and fm.read_keyed_files(spark, path).count() == 302


@pytest.mark.parametrize("seed", [1, 2])
def test_sketch_has_no_false_negative(spark, seed):
    """Every key, asked alone or among strangers, finds the files that hold it."""
    rng = random.Random(seed)
    odd = [(None, "a"), (0.0, "z"), (-0.0, None), (float("nan"), "n"), (None, None)]
    rows = odd + [(rng.choice([1.0, -1.0]) * rng.random() * 10 ** rng.randrange(9),
                   "".join(rng.choice("abé ") for _ in range(rng.randrange(5)))) for _ in range(1500)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "x double, s string, i int")
    path = work_dir(spark, "t-sketch") + "/t"
    fm.write_keyed_files(spark, df.repartition(5), path, ["x", "s"])
    live = fm.live_files(spark, path)
    table = fm.read_keyed_files(spark, path)
    where = table.select("x", "s", F.col("_metadata.file_path").alias("f")).collect()
    for r in rng.sample(where, 12) + [r for r in where if r.x is None or r.x == 0 or r.x != r.x]:
        asked = spark.createDataFrame([(-r.x if r.x == 0 else r.x, r.s)], "x double, s string")
        assert r.f in fm.candidate_files(spark, path, asked, ["x", "s"], live)
    every = fm.candidate_files(spark, path, table.select("x", "s"), ["x", "s"], live)
    assert set(every) == set(live)


def test_sketch_words_hold_every_key(spark):
    df = spark.range(5000).select("id", F.lit("f").alias("file"))
    path = work_dir(spark, "t-words")
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).select("id", "_metadata")
    sketch = fm.sketch_files(rows, ["id"])
    missed = fm._hashed(rows, ["id"], F.col("_metadata.file_path").alias("f")).join(
        sketch, (F.col("f") == F.col("file")) & (F.col("hash").bitwiseAND(F.col("words") - 1) == F.col("word"))
        & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        & F.col("key").between(F.col("lo"), F.col("hi")), "left_anti")
    assert missed.count() == 0
    assert sketch.groupBy("file").agg(F.max("words").alias("w")).where("w * 64 < 8 * 1000").count() == 0


def test_files_without_a_sketch_and_dead_files(spark):
    path = _table(spark, [(i, "a", "x") for i in range(200)])
    # a merge that died after writing its files: they are in no version
    fm._add_files(spark, spark.createDataFrame([(1, "a", "ghost"), (999, "a", "ghost")], SCHEMA), path, ["k"], ["p"])
    assert fm.read_keyed_files(spark, path).where("v = 'ghost'").count() == 0
    remove_path(spark, f"{path}/_sketches")
    assert not path_exists(spark, f"{path}/_sketches")
    fm.merge_keyed_files(spark, spark.createDataFrame([(7, "b", "new")], SCHEMA), path, ["k"], ["p"])
    got = fm.read_keyed_files(spark, path).where("k = 7").collect()
    assert [(r.p, r.v) for r in got] == [("b", "new")]
    assert fm.read_keyed_files(spark, path).count() == 200


def test_columns_and_null_keys(spark):
    path = _table(spark, [(1, "a", "x"), (None, "a", "n")])
    more = spark.createDataFrame([(None, "b", "m", 5)], "k long, p string, v string, extra int")
    fm.merge_keyed_files(spark, more, path, ["k"], ["p"])
    assert _rows(spark, path) == sorted([(None, "b", "m", 5), (1, "a", "x", None)], key=repr)
    less = spark.createDataFrame([(2, "c")], "k long, p string")
    fm.merge_keyed_files(spark, less, path, ["k"], ["p"], drop_missing=True)
    assert fm.read_keyed_files(spark, path).columns == ["k", "p"]
    assert _rows(spark, path) == sorted([(None, "b"), (1, "a"), (2, "c")], key=repr)
    with pytest.raises(ValueError, match="k: bigint -> string"):
        fm.merge_keyed_files(spark, spark.createDataFrame([("1", "a")], "k string, p string"), path, ["k"], ["p"])
    fm.merge_keyed_files(spark, less.limit(0), path, ["k"], ["p"])
    assert fm.read_keyed_files(spark, path).count() == 3


def test_empty_table_and_duplicates_in_a_batch(spark):
    path = _table(spark, [])
    assert _rows(spark, path) == []
    rows = [(1, "a", "1"), (1, "b", "2"), (1, "c", "0")]
    fm.merge_keyed_files(spark, spark.createDataFrame(rows, SCHEMA), path, ["k"], ["p"], prefer=[F.col("v")])
    assert _rows(spark, path) == [(1, "b", "2")]
