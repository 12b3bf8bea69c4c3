"""Operator properties: determinism, no fan-out, exact quantiles under skew."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from civitas.operators.analytics import outlier_iqr
from civitas.operators.dedup import dedup_on_keys, earliest_per_key, latest_per_key
from civitas.operators.link import (join_crossref, join_on_derived_key,
                                    join_priority_fallback)
from civitas.operators.quantiles import exact_quantiles
from civitas.operators.topk import topk_per_group, topn_other_bucket
from civitas.functions import normalize_name_sql


def test_latest_per_key_ties_and_nulls(spark):
    rows = [(1, "2024-01-02", "a"), (1, "2024-01-02", "b"), (1, None, "z"),
            (2, None, "x"), (2, "2023-05-01", "y")]
    df = spark.createDataFrame(rows, "k int, d string, v string")
    outs = set()
    for n in (1, 3, 7):
        r = latest_per_key(df.repartition(n), ["k"], ["d"]).orderBy("k").collect()
        outs.add(tuple((x.k, x.v) for x in r))
    assert outs == {((1, "b"), (2, "y"))}   # same winner on any partitioning, nulls last
    e = earliest_per_key(df, ["k"], ["d"]).orderBy("k").collect()
    assert [(x.k, x.v) for x in e] == [(1, "a"), (2, "y")]


def test_dedup_independent_of_order(spark):
    rows = [(i % 5, random.random()) for i in range(200)]
    a = dedup_on_keys(spark.createDataFrame(rows, "k int, v double"), ["k"]).collect()
    random.shuffle(rows)
    b = dedup_on_keys(spark.createDataFrame(rows, "k int, v double").repartition(5), ["k"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_priority_fallback_no_fanout(spark):
    ent = spark.createDataFrame([(1, "ANA"), (2, "BIA"), (3, "CAIO"), (4, "")], "e int, key string")
    reg_a = spark.createDataFrame([("ANA", 10), ("ANA", 11), ("", 99)], "key string, id_a int")
    reg_b = spark.createDataFrame([("ANA", 20), ("BIA", 21), ("BIA", 22)], "key string, id_b int")
    r = join_priority_fallback(ent, "key", reg_a, "id_a", reg_b, "id_b").orderBy("e").collect()
    assert [(x.e, x.linked_id, x.link_source) for x in r] == [
        (1, 10, "A"), (2, 21, "B"), (3, None, None), (4, None, None)]


def test_blank_names_never_match(spark):
    left = spark.createDataFrame([(1, ""), (2, None), (3, "José")], "i int, n string")
    right = spark.createDataFrame([("", 7), (None, 8), ("JOSE", 9)], "m string, j int")
    r = join_on_derived_key(left, right, normalize_name_sql("n"), normalize_name_sql("m")).collect()
    assert {(x.i, x.j) for x in r} == {(1, None), (2, None), (3, 9)}


def test_crossref_totals_not_multiplied(spark):
    a = spark.createDataFrame([(1, 10.0)] * 3, "k int, v double")
    b = spark.createDataFrame([(1, 5.0)] * 4, "k int, w double")
    r = join_crossref(a, "k", [F.sum("v").alias("sv")], b, "k", [F.sum("w").alias("sw")]).collect()
    assert (r[0].sv, r[0].sw) == (30.0, 20.0)


def _np_nearest(vals, p):
    s = sorted(vals)
    idx = int(np.floor(p * (len(s) - 1) + 0.5))  # half away from zero for >= 0
    return s[idx]


def test_exact_quantiles_skewed(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(3000)]      # a third+ of rows
    rows += [(f"g{i % 40}", round(rng.uniform(0, 1000), 2)) for i in range(2000)]
    rows += [("one", 5.0), ("dup", 2.0), ("dup", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    lin = {r.g: r for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], "linear").collect()}
    near = {r.g: r for r in exact_quantiles(df, ["g"], "v", [0.25, 0.75], "nearest").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vals in groups.items():
        assert lin[g].n == len(vals)
        for p, name in ((0.1, "q100"), (0.5, "q500"), (0.9, "q900")):
            assert abs(lin[g][name] - float(np.quantile(vals, p))) < 1e-9
        assert near[g].q250 == _np_nearest(vals, 0.25)
        assert near[g].q750 == _np_nearest(vals, 0.75)


def test_topk_per_group_equals_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = topk_per_group(df, ["g"], order, 4).select("g", "id").collect()
    w = Window.partitionBy("g").orderBy(*order)
    exp = df.withColumn("r", F.row_number().over(w)).where("r <= 4").select("g", "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exp))


def test_other_bucket(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 1, "k string")
    r = topn_other_bucket(df, "k", F.count(F.lit(1)), 2).groupBy("grouped").count().collect()
    assert dict(map(tuple, r)) == {"a": 5, "b": 3, "Outros": 1}


def test_outlier_iqr_skips_small_groups(spark):
    rows = [("small", 1.0), ("small", 2.0), ("small", 100.0)]
    rows += [("big", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]]
    df = spark.createDataFrame(rows, "g string, v double")
    out = outlier_iqr(df, ["g"], "v").collect()
    assert [(r.g, r.v) for r in out] == [("big", 100.0)]
    assert out[0].mediana_grupo == 5.0


def test_approx_variants_within_bounds(spark):
    from civitas.operators.aggregates import count_distinct_approx
    from civitas.operators.quantiles import approx_quantiles
    rng = random.Random(5)
    rows = [("g", rng.randint(0, 5000)) for _ in range(20000)]
    df = spark.createDataFrame(rows, "g string, v int")
    n_exact = len({v for _, v in rows})
    n_approx = df.agg(count_distinct_approx("v", 0.02).alias("n")).first().n
    assert abs(n_approx - n_exact) / n_exact < 0.08
    q = approx_quantiles(df, ["g"], "v", [0.5], accuracy=10000).first()
    exact = float(np.quantile([v for _, v in rows], 0.5))
    assert abs(q.q500 - exact) <= 5000 / 10000 * 20 + 1


def test_count_distinct_many_matches_count_distinct(spark):
    from civitas.operators.aggregates import count_distinct_many
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 11}", rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 30))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    got = {r.g: (r.na, r.nb, r.nbc, r.s) for r in count_distinct_many(
        df, ["g"], {"na": "a", "nb": "b", "nbc": F.when(F.col("a") == 1, F.col("b"))},
        [F.sum("b").alias("s")]).collect()}
    exp = {r.g: (r.na, r.nb, r.nbc, r.s) for r in df.groupBy("g").agg(
        F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"),
        F.count_distinct(F.when(F.col("a") == 1, F.col("b"))).alias("nbc"),
        F.sum("b").alias("s")).collect()}
    assert got == exp


def test_exact_quantiles_clustered_values(spark):
    # 5000 distinct values packed near zero and one far outlier: the first
    # level puts nearly everything in one bin, the second level splits it
    rng = random.Random(13)
    vals = [round(rng.uniform(0, 0.001), 9) for _ in range(5000)] + [1e9]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    r = exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], "linear").first()
    for p, name in ((0.1, "q100"), (0.5, "q500"), (0.99, "q990")):
        assert abs(r[name] - float(np.quantile(vals, p))) < 1e-15
    r1 = exact_quantiles(df, ["g"], "v", [0.5], "nearest").first()
    assert r1.q500 == _np_nearest(vals, 0.5)


def test_null_groups_and_all_null_groups(spark):
    from civitas.operators.aggregates import count_distinct_many
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 3.0, "b"), ("x", None, None), ("x", None, None),
                                ("y", 2.0, "a"), ("y", None, None)], "g string, v double, k string")
    got = {r.g: (r.n, r.q500) for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: (2, 2.0), "x": (0, None), "y": (1, 2.0)}
    got = {r.g: (r.nk, r.nv) for r in count_distinct_many(df, ["g"], {"nk": "k", "nv": "v"}).collect()}
    assert got == {None: (2, 2), "x": (0, 0), "y": (1, 1)}
    assert exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def test_distinct_counts_make_no_row_per_count(spark):
    from civitas.operators.aggregates import count_distinct_many
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "y"), ("b", None, None)],
                               "g string, k int, v string")
    out = count_distinct_many(df, ["g"], {"nk": "k", "nv": "v"}, [F.max("v").alias("m")])
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == [
        ("a", "y", 1, 2), ("b", None, 0, 0), (None, "y", 1, 1)]


def test_monthly_means_past_an_int(spark, tmp_path):
    from civitas.plans import QUERIES
    for price, kind in ((1e11, "bigint"), (1000.0, "int")):
        d = tmp_path / kind
        spark.createDataFrame([(1, 1, "F", price, dt.datetime(2000, 1, 5), "5-LOW"),
                               (2, 1, "F", price, dt.datetime(2000, 2, 5), "5-LOW")],
                              "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                              "o_orderdate timestamp_ntz, o_orderpriority string") \
            .write.parquet(str(d / "orders.parquet"))
        out = QUERIES["q_agg_two_level"](spark, str(d))
        assert dict(out.dtypes)["media_mensal"] == kind
        assert out.first().media_mensal == int(price)
