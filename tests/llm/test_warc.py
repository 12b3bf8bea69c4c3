"""Archives against brute force, determinism, rolling, commit, defined cases."""

import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from civitas.llm import queries, warc
from conftest import SF_SMALL


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    by = {}
    for i, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        keep = max((x for x in by[p] if x is not None), default=None)
        revisit = keep is not None and i != keep
        out.append((i, len(p), sha(p), "revisit" if revisit else "response",
                    keep if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    out = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in queries.op3_warc(spark, SF_SMALL).collect()]
    assert sorted(out, key=repr) == expected(rows)


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h{i % 7}/\n{i}" if i % 9 else None,
             None if i % 50 == 0 else ("same" if i % 3 == 0 else f"é page {i} " * (i % 40)))
            for i in range(600)] + [(None, "u", "same"), (None, "v", "alone"), (1005, "w", "x"), (1005, "w", "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_cases_rolling_and_round_trip(spark, pages, tmp_path):
    rows, df = pages
    out = f"file://{tmp_path}/a"
    m = warc.write_archives(df, out, shard_bytes=8_000, roll_bytes=1_500).collect()
    assert len(m) > 10 and max(r.seq for r in m) > 0
    assert sum(r.records for r in m) == len(rows)
    read = warc.read_archives(spark, out)
    assert got(read) == expected([(i, h) for i, _, h in rows])
    by_id = {i: h for i, _, h in rows}
    for r in read.collect():
        if r.record_type == "response" and r.id is not None:
            assert r.payload.decode() == (by_id[r.id] or "")
    assert not os.path.exists(tmp_path / "a" / "_tmp")


def test_same_bytes_for_any_partitioning(pages, tmp_path):
    _, df = pages
    runs = [warc.write_archives(df.repartition(n), f"{tmp_path}/{n}", shard_bytes=8_000)
            .select("name", "sha256").collect() for n in (1, 5)]
    assert sorted(runs[0]) == sorted(runs[1]) and len(runs[0]) > 3


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/o", revisit_bytes=3)
    kinds = {r.id: r.record_type for r in warc.read_archives(spark, f"{tmp_path}/o").collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_and_damage(spark, pages, tmp_path):
    _, df = pages
    warc.write_archives(df.where("false"), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n")


def test_an_id_repeated_often_is_sampled_once(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 2 * 7).alias("id"))
    seen = []
    plain = np.array
    monkeypatch.setattr(warc.np, "array", lambda x, *a, **k: (seen.append(len(x)), plain(x, *a, **k))[1])
    bounds = warc.shard_bounds(df, 2000, 8)
    assert max(seen) <= 2 and bounds == sorted(set(bounds))


def test_query_rolls_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(i, "u", rng.bytes(3000).hex()) for i in range(200)],
                                  "page_id long, url string, html string")
    done = warc.write_archives(pages, str(tmp_path / "w"), roll_bytes=100_000).collect()
    assert max(r.seq for r in done) >= 2 and sum(r.records for r in done) >= 200
    back = warc.read_archives(spark, str(tmp_path / "w"), payloads=False)
    assert back.select("id").distinct().count() == 200
