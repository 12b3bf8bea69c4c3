"""SURVEY 5(c) properties checked on generated data (hypothesis)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civitas.operators.dedup import dedup_on_keys
from civitas.operators.quantiles import exact_quantiles
from civitas.operators.upsert import read_target, upsert_by_key
from civitas.session import work_dir

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]),
                            st.integers(min_value=-50, max_value=50)),
                  min_size=1, max_size=120)


@SETTINGS
@given(rows=values)
def test_exact_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0], "linear").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(float(v))
    assert set(got) == set(groups)
    for g, vals in groups.items():
        for p, name in ((0.0, "q000"), (0.3, "q300"), (0.5, "q500"), (1.0, "q1000")):
            assert abs(got[g][name] - float(np.quantile(vals, p))) < 1e-9


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.text(max_size=3)),
                     min_size=1, max_size=60),
       parts=st.integers(1, 6))
def test_dedup_same_for_any_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows, "k int, o int, v string")
    a = sorted(map(tuple, dedup_on_keys(df, ["k"], prefer=["o"]).collect()))
    b = sorted(map(tuple, dedup_on_keys(df.repartition(parts), ["k"], prefer=["o"]).collect()))
    assert a == b and len(a) == len({k for k, _, _ in rows})


@SETTINGS
@given(a=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 2)), min_size=1, max_size=25,
                  unique_by=lambda t: t[0]),
       b=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 2)), min_size=1, max_size=25,
                  unique_by=lambda t: t[0]))
def test_upsert_sequence_equals_union(spark, a, b):
    root = work_dir(spark, "t-prop-upsert")
    sa = spark.createDataFrame([(k, p, "a") for k, p in a], "k int, p int, v string")
    sb = spark.createDataFrame([(k, p, "b") for k, p in b], "k int, p int, v string")
    upsert_by_key(spark, sa, f"{root}/seq", ["k"], ["p"])
    upsert_by_key(spark, sb, f"{root}/seq", ["k"], ["p"], keys_may_move=True)
    # one upsert of a ∪ b where b's rows win on a shared key
    both = sa.withColumn("o", F.lit(0)).unionByName(sb.withColumn("o", F.lit(1)))
    upsert_by_key(spark, both, f"{root}/one", ["k"], ["p"], prefer=["o"])
    seq = sorted(tuple(r) for r in read_target(spark, f"{root}/seq").select("k", "p", "v").collect())
    one = sorted(tuple(r) for r in read_target(spark, f"{root}/one").select("k", "p", "v").collect())
    assert seq == one
