"""Dense ids, mergeable distinct counts and totals by level against brute force."""

import random

from pyspark.sql import functions as F

from civitas.operators.distinct_state import (dense_ids, distinct_mart, roll_up, roll_up_levels,
                                              totals_by_level)

SCHEMA = "y int, m int, g string, x string, z long"


def _fact(seed, n=3000):
    rng = random.Random(seed)
    return [(rng.choice([2020, 2021, None]), rng.randrange(1, 13), rng.choice(["a", "b", None, "only null"]),
             rng.choice([None, f"v{rng.randrange(700)}"]), rng.randrange(100_000)) for _ in range(n)]


def _cut(rows):
    return [(y, m, g, None if g == "only null" else x, z) for y, m, g, x, z in rows]


def test_ids_have_no_gaps_and_stay(spark):
    one = spark.createDataFrame([(f"a{i % 500}",) for i in range(2000)] + [(None,)], "x string").repartition(7)
    ids = dense_ids(one, "x")
    first = {r.x: r.id for r in ids.collect()}
    assert sorted(first.values()) == list(range(1, 501))
    two = spark.createDataFrame([(f"a{i}",) for i in range(400, 900)], "x string").repartition(3)
    both = {r.x: r.id for r in dense_ids(two, "x", ids).collect()}
    assert sorted(both.values()) == list(range(1, 901)) and {k: both[k] for k in first} == first
    assert dense_ids(one.limit(0), "x").count() == 0
    assert {r.x: r.id for r in dense_ids(two.limit(0), "x", ids).collect()} == first


def test_rolled_up_counts_equal_the_facts(spark):
    loads = [_cut(_fact(s)) for s in (1, 2, 3)]
    ids_x = ids_z = mart = None
    for rows in loads:
        df = spark.createDataFrame(rows, SCHEMA)
        ids_x, ids_z = dense_ids(df, "x", ids_x), dense_ids(df, "z", ids_z)
        part = distinct_mart(df, ["y", "m", "g"], {"n": F.count(F.lit(1))}, {"nx": ("x", ids_x), "nz": ("z", ids_z)})
        mart = part if mart is None else mart.unionByName(part)
    every = [r for rows in loads for r in rows]
    levels = {"m": ["y", "m", "g"], "y": ["y", "g"], "g": ["g"], "all": []}
    got = {(r.nivel, r.y, r.m, r.g): (r.n, r.nx, r.nz) for r in
           roll_up_levels(mart, levels, ["n"], ["nx", "nz"]).collect()}
    want = {}
    for name, dims in levels.items():
        groups = {}
        for y, m, g, x, z in every:
            key = (name, y if "y" in dims else None, m if "m" in dims else None, g if "g" in dims else None)
            n, xs, zs = groups.setdefault(key, [0, set(), set()])
            groups[key][0] += 1
            xs.add(x)
            zs.add(z)
        want |= {k: (n, len(xs - {None}), len(zs - {None})) for k, (n, xs, zs) in groups.items()}
    assert got == want
    assert any(k[3] == "only null" and v[1] == 0 for k, v in got.items())


def test_buckets_beyond_one_bitmap(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    mart = distinct_mart(df, ["g"], {"n": F.count(F.lit(1))}, {"nx": ("x", dense_ids(df, "x"))})
    assert mart.agg(F.max("__bucket")).first()[0] >= 3
    assert sorted((r.g, r.n, r.nx) for r in roll_up(mart, ["g"], ["n"], ["nx"]).collect()) == \
        [(0, 50_000, 50_000), (1, 50_000, 50_000)]
    assert [tuple(r) for r in roll_up(mart, [], ["n"], ["nx"]).collect()] == [(100_000, 100_000)]


def test_null_group_and_total_stay_apart(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4), (None, None, 8)],
                               "p string, q string, v int")
    out = totals_by_level(df, {"pq": ["p", "q"], "p": ["p"], "q": ["q"], "all": []}, [F.sum("v").alias("s")], "lvl")
    got = {tuple(r) for r in out.collect()}
    assert got == {("pq", "a", "x", 1), ("pq", "a", None, 2), ("pq", None, "x", 4), ("pq", None, None, 8),
                   ("p", "a", None, 3), ("p", None, None, 12), ("q", None, "x", 5), ("q", None, None, 10),
                   ("all", None, None, 15)}
