"""As-of join equals the brute-force latest-start-at-or-before lookup."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from civitas.operators import asof
from civitas.operators.asof import asof_join, asof_scan, flatten_periods
from civitas.session import materialize_table


def test_asof_matches_brute_force(spark):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    periods = []
    for pid in range(300):
        key = "hot" if pid % 3 else f"k{pid % 7}"           # one key holds 2/3 of periods
        start = base + dt.timedelta(days=rng.randint(0, 200))
        periods.append((key, start, f"a{pid}", pid))
    events = [("hot" if i % 2 else f"k{i % 9}", base + dt.timedelta(days=rng.randint(-10, 230)), i)
              for i in range(800)]
    p = spark.createDataFrame(periods, "key string, start timestamp_ntz, attr string, pid int")
    e = spark.createDataFrame(events, "key string, t timestamp_ntz, eid int")
    got = {r.eid: (r.attr, r.pid) for r in
           asof_join(e, p, "key", "t", "start", ["attr", "pid"], tie_break=["pid"]).collect()}
    for key, t, eid in events:
        cands = [(s, pid, a) for k, s, a, pid in periods if k == key and s <= t]
        exp = (max(cands)[2], max(cands)[1]) if cands else (None, None)
        assert got[eid] == exp, (eid, got[eid], exp)


def test_asof_with_end_leaves_gaps(spark):
    p = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10), "x")],
                              "key string, s timestamp_ntz, e timestamp_ntz, v string")
    ev = spark.createDataFrame([("a", dt.datetime(2024, 1, 5), 1), ("a", dt.datetime(2024, 3, 1), 2),
                                ("b", dt.datetime(2024, 1, 5), 3)], "key string, t timestamp_ntz, i int")
    got = {r.i: r.v for r in asof_join(ev, p, "key", "t", "s", ["v"], end_time="e").collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_asof_day_buckets_same_result(spark):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    periods = [("k", base + dt.timedelta(hours=rng.randint(0, 2000)), f"a{i}", i) for i in range(60)]
    events = [("k", base + dt.timedelta(hours=rng.randint(0, 2100)), i) for i in range(300)]
    p = spark.createDataFrame(periods, "key string, start timestamp_ntz, attr string, pid int")
    e = spark.createDataFrame(events, "key string, t timestamp_ntz, eid int")
    by_month = {r.eid: r.attr for r in asof_join(e, p, "key", "t", "start", ["attr"],
                                                   tie_break=["pid"]).collect()}
    by_day = {r.eid: r.attr for r in asof_join(e, p, "key", "t", "start", ["attr"],
                                                 tie_break=["pid"], bucket="day").collect()}
    assert by_month == by_day


def _random_case(spark, seed, n_periods=300, n_events=800):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    periods = []
    for pid in range(n_periods):
        start = base + dt.timedelta(hours=rng.randint(0, 900))
        end = rng.choice([None, start + dt.timedelta(hours=rng.choice([0, 1, 5, 40, 400, -3]))])
        periods.append(("hot" if pid % 3 else f"k{pid % 7}", start, end, f"a{pid}", pid))
    periods.append((None, base, None, "null key", -1))
    periods.append(("hot", None, None, "no start", -2))
    events = [("hot" if i % 2 else f"k{i % 9}", base + dt.timedelta(hours=rng.randint(-50, 1500)), i)
              for i in range(n_events)] + [(None, base, -1), ("hot", None, -2)]
    p = spark.createDataFrame(periods, "key string, start timestamp_ntz, stop timestamp_ntz, attr string, pid int")
    e = spark.createDataFrame(events, "key string, t timestamp_ntz, eid int")
    return periods, events, p, e


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_scan_matches_brute_force(spark, partitions):
    periods, events, p, e = _random_case(spark, partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        plain = {r.eid: r.pid for r in asof_scan(e, p, "key", "t", "start", ["attr", "pid"],
                                                 tie_break=["pid"]).collect()}
        ended = {r.eid: r.pid for r in asof_scan(e, p, "key", "t", "start", ["pid"], ["pid"], "stop").collect()}
        nested = {r.eid: r.pid for r in asof_scan(e, p, "key", "t", "start", ["pid"], ["pid"], "stop",
                                                  overlapping=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(plain) == len(events)
    for key, t, eid in events:
        rows = [(s, pid, x) for k, s, x, _, pid in periods
                if k is not None and k == key and s is not None and t is not None and s <= t]
        last = max(rows, key=lambda r: r[:2], default=None)
        assert plain[eid] == (last and last[1])
        assert ended[eid] == (last[1] if last and (last[2] is None or t < last[2]) else None)
        still = [r for r in rows if r[2] is None or t < r[2]]
        assert nested[eid] == max(still, key=lambda r: r[:2], default=(None, None))[1]


def test_flattened_periods_do_not_overlap_and_dates_work(spark):
    d = dt.date
    p = spark.createDataFrame([("a", d(2024, 1, 1), d(2024, 2, 1), "outer"), ("a", d(2024, 1, 5), d(2024, 1, 9), "in"),
                               ("a", d(2024, 1, 9), d(2024, 1, 9), "empty"), ("a", d(2024, 3, 1), None, "open")],
                              "k string, s date, e date, v string")
    got = {r["__t"]: r["__p"] and r["__p"]["a0"] for r in flatten_periods(p, "k", "s", "e", ["v"]).collect()}
    assert got == {d(2024, 1, 1): "outer", d(2024, 1, 5): "in", d(2024, 1, 9): "outer", d(2024, 2, 1): None,
                   d(2024, 3, 1): "open"}


def test_a_hot_key_lies_in_many_ranges(spark):
    """One key, one instant for a third of the events: no range holds them all."""
    e = spark.range(30_000).select(F.lit("k").alias("key"), F.expr(
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, if(id % 3 = 0, 0, id))").alias("t"), "id")
    p = spark.createDataFrame([("k", dt.datetime(2023, 1, 1), "x")], "key string, s timestamp_ntz, v string")
    merge_small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge_small, "false")
    try:
        out = asof_scan(e, p, "key", "t", "s", ["v"])
    finally:
        spark.conf.set(merge_small, "true")
    assert out.where("v = 'x'").count() == 30_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line]
    assert window and all("__k" not in line.split("windowspecdefinition(")[1].split(" ASC")[0].split(",")[0]
                          for line in window)
    path = [f for f in out.inputFiles()]
    sizes = [r["count"] for r in spark.read.parquet(*path).groupBy("__range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 15_000


def test_scan_of_empty_tables(spark):
    _, events, p, e = _random_case(spark, 9, 5, 5)
    assert asof_scan(e.limit(0), p, "key", "t", "start", ["attr"]).count() == 0
    got = asof_scan(e, p.limit(0), "key", "t", "start", ["attr"], end_time="stop", overlapping=True).collect()
    assert len(got) == len(events) and all(r.attr is None for r in got)


def test_pieces_grow_with_the_points_inside_a_period_not_with_its_time(spark, monkeypatch):
    made = {}

    def kept(df, purpose):
        made[purpose] = materialize_table(df, purpose)
        return made[purpose]
    monkeypatch.setattr(asof, "materialize_table", kept)
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    p = spark.createDataFrame([("a", day(i * 90), day(i * 90 + 400), i) for i in range(8)],
                              "k string, s timestamp_ntz, e timestamp_ntz, v int")
    got = {r["__t"]: r["__p"] and r["__p"]["a0"] for r in flatten_periods(p, "k", "s", "e", ["v"]).collect()}
    assert all(got[day(i * 90)] == i for i in range(8)) and got[day(400)] == 4 and got[day(7 * 90 + 400)] is None
    assert made["asof-pieces"].count() <= 8 * 2 * 4   # each was cut into about 40 pieces of time
