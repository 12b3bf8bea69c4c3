"""A file stream processed with availableNow equals the batch result."""

from pyspark.sql import functions as F

from civitas.operators.upsert import read_target
from civitas.session import work_dir
from civitas.streaming.files import (read_additive_agg, stream_additive_agg, stream_period_files,
                                     stream_upsert)


def test_stream_upsert_equals_batch(spark):
    root = work_dir(spark, "t-stream")
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "p int, k int, v string")
    df.where("k < 25").write.partitionBy("p").parquet(f"{root}/landing")
    df.where("k >= 15").write.mode("append").partitionBy("p").parquet(f"{root}/landing")
    stream = stream_period_files(spark, f"{root}/landing", df.schema, max_files_per_trigger=3)
    stream_upsert(spark, stream, f"{root}/t", ["k"], ["p"], f"{root}/ckpt")
    got = sorted(tuple(r) for r in read_target(spark, f"{root}/t").select("p", "k", "v").collect())
    assert got == sorted(rows)
    # a restart with the same checkpoint finds nothing new and changes nothing
    stream = stream_period_files(spark, f"{root}/landing", df.schema)
    stream_upsert(spark, stream, f"{root}/t", ["k"], ["p"], f"{root}/ckpt")
    assert sorted(tuple(r) for r in read_target(spark, f"{root}/t")
                  .select("p", "k", "v").collect()) == got


def test_additive_aggregate_counts_every_late_row(spark):
    import datetime as dt
    root = work_dir(spark, "t-additive")
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(70)]
    rows = [(days[i % 70], f"e{i % 3}", float(i)) for i in range(700)] + [(None, None, 1.0)]
    df = spark.createDataFrame(rows, "dia date, kind string, v double")
    # the newest days land first, then the older ones, then one very late row
    for part in (df.where("dia >= '2024-02-01'"), df.where("dia < '2024-02-01' or dia is null")):
        part.write.mode("append").partitionBy("dia").parquet(f"{root}/landing")
    sums = {"n": F.count(F.lit(1)), "total": F.sum("v")}

    def run():
        stream = stream_period_files(spark, f"{root}/landing", df.schema, max_files_per_trigger=20)
        stream_additive_agg(spark, stream, f"{root}/deltas", [F.col("dia"), F.col("kind")], sums,
                            f"{root}/ckpt")
        return {tuple(r) for r in read_additive_agg(spark, f"{root}/deltas", ["dia", "kind"],
                                                    ["n", "total"]).collect()}
    expect = lambda d: {tuple(r) for r in d.groupBy("dia", "kind").agg(
        F.count(F.lit(1)), F.sum("v")).collect()}
    assert run() == expect(df)
    late = spark.createDataFrame([(days[0], "e0", 5.0)], df.schema)
    late.write.mode("append").partitionBy("dia").parquet(f"{root}/landing")
    assert run() == expect(df.unionByName(late))


def test_additive_aggregate_of_an_empty_stream_and_folds(spark):
    from pyspark.sql import functions as F

    from civitas.session import work_dir
    from civitas.streaming.files import (fold_additive_agg, read_additive_agg, stream_additive_agg,
                                         stream_period_files)
    root = work_dir(spark, "t-fold")
    schema = spark.createDataFrame([], "g string, v long").schema

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        run()

    def run():
        stream_additive_agg(spark, stream_period_files(spark, f"{root}/in", schema), f"{root}/d", [F.col("g")],
                            {"n": F.count(F.lit(1)), "s": F.sum("v")}, f"{root}/ck")

    def read():
        return sorted((tuple(r) for r in read_additive_agg(spark, f"{root}/d", ["g"], ["n", "s"]).collect()), key=repr)

    spark.createDataFrame([], schema).write.parquet(f"{root}/in")
    run()
    assert read() == []
    land([("a", 1), (None, 2)])
    land([("a", 10)])
    want = [("a", 2, 11), (None, 1, 2)]
    assert read() == sorted(want, key=repr)
    for _ in range(2):
        fold_additive_agg(spark, f"{root}/d", ["g"], ["n", "s"])
        assert read() == sorted(want, key=repr)
    land([("b", 5)])
    want.append(("b", 1, 5))
    assert read() == sorted(want, key=repr)
    fold_additive_agg(spark, f"{root}/d", ["g"], ["n", "s"])
    assert read() == sorted(want, key=repr)


def test_skipped_periods_are_reported(spark):
    from civitas.session import work_dir
    from civitas.streaming.files import skip_existing_periods, skipped_periods
    root = work_dir(spark, "t-skip") + "/landing"
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "k int, p int")
    assert skipped_periods(spark, df, root, "p", df.schema).count() == 0
    df.where("p = 1 or p is null").write.partitionBy("p").parquet(root)
    got = {tuple(r) for r in skipped_periods(spark, df, root, "p", df.schema).collect()}
    assert got == {(1, 2), (None, 1)}
    assert [r.k for r in skip_existing_periods(spark, df, root, "p", df.schema).collect()] == [3]
