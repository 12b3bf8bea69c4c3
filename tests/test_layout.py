"""Files a filter must read after clustering; joins without an exchange."""

import random

import pytest
from pyspark.sql import functions as F

from civitas.operators.layout import interleave, save_bucketed, write_zordered
from civitas.session import work_dir


def test_interleaved_bits(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 16), rng.randrange(1 << 16)) for _ in range(50)] + [(0, 0), (65535, 65535)]
    got = [r.z for r in spark.createDataFrame(rows, "a int, b int").select(
        interleave([F.col("a"), F.col("b")]).alias("z")).collect()]
    assert got == [sum(((a >> i) & 1) << 2 * i | ((b >> i) & 1) << 2 * i + 1 for i in range(16)) for a, b in rows]
    with pytest.raises(ValueError):
        interleave([F.col("a")] * 4, 16)


def _files_that_may_hold(df, col, v):
    lims = df.groupBy(F.col("_metadata.file_path")).agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
    return sum(r.lo <= v <= r.hi for r in lims), len(lims)


def test_point_filters_on_either_key_skip_files(spark):
    df = spark.range(60_000).select((F.xxhash64("id") % 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"))
    z, line = work_dir(spark, "t-z") + "/z", work_dir(spark, "t-z") + "/line"
    write_zordered(df, z, ["a", "b"], 64)
    df.repartitionByRange(64, "a", "b").write.parquet(line)
    zt, lt = spark.read.parquet(z), spark.read.parquet(line)
    assert zt.count() == 60_000
    for col in "ab":
        hit, n = _files_that_may_hold(zt, col, 137)
        assert n >= 60 and hit <= n // 3, (col, hit, n)
    assert _files_that_may_hold(lt, "b", 137)[0] >= 60      # sorted by (a, b): every file holds every b


def test_zorder_of_nulls_one_value_and_no_rows(spark):
    rows = [(None, 1.5), (2.0, None), (2.0, 1.5)]
    for df in (spark.createDataFrame(rows, "a double, b double"), spark.createDataFrame([], "a double, b double")):
        path = work_dir(spark, "t-z2") + "/t"
        write_zordered(df, path, ["a", "b"], 4)
        assert spark.read.parquet(path).count() == df.count()


def test_bucketed_join_has_no_exchange(spark):
    fact = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    dim = spark.range(250).select(F.col("id").alias("d"), (F.col("id") * 2).alias("x"))
    f, d = save_bucketed(fact, ["k"], 6, "t-fact"), save_bucketed(dim, ["d"], 6, "t-dim")
    left, right = spark.table(f), spark.table(d).hint("merge")
    out = left.join(right, left.k == right.d, "left").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = fact.join(dim, F.col("k") == F.col("d"), "left").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
