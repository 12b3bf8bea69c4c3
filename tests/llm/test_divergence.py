"""Divergences against a brute force in Python integers, spills, blocks, defined cases."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from civitas.llm import divergence, queries
from conftest import SF_SMALL

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, min_docs, top=10):
    """docs: (lang, source, text)"""
    groups, df, count = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        n = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(n[s][t] for s in sources) for t in kept}

        def probabilities(c):
            whole = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (k + 2) // whole for t, k in c.items()}
        p, q = {s: probabilities(c) for s, c in n.items()}, probabilities(total)

        def ranked(source, part, rows):
            rows.sort(key=lambda x: (-x[1], x[0].encode()))
            for i, (item, v) in enumerate(rows if part == "pair" else rows[:top], 1):
                out.add((lang, source, part, item, v, i))
        for s in sources:
            ranked(s, "pair", [(t, sum((p[s][w] - p[t][w]) ** 2 // (p[s][w] + p[t][w]) for w in kept))
                               for t in sources if t != s])
            ranked(s, "term", [(w, (p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])) for w in kept
                               if n[s][w] > 0 and p[s][w] > q[w]])
    return out


def _run(df, **kw):
    rows = divergence.source_divergence(df, "lang", "source", "text", **kw).collect()
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_brute_force_and_oracle(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    df = queries.QUERIES["op12_source_divergence"](spark, SF_SMALL)
    assert df.schema.simpleString() == \
        "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    got = {tuple(r) for r in df.collect()}
    assert got == brute([(r.lang, r.source, r.text) for r in rows], 10)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    assert set(con.execute(queries.ORACLES["op12_source_divergence"]).fetchall()) == got


@pytest.mark.parametrize("spill", [1, 50, 500_000])
def test_spills_change_nothing(spark, spill):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()
    df = spark.createDataFrame(rows).repartition(3)
    assert _run(df, min_docs=2, spill=spill) == brute([(r.lang, r.source, r.text) for r in rows], 2)


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 20)  # 10 sources: five blocks of two
    monkeypatch.setattr(divergence, "SHARE", 1)
    rows = [("en", f"s{i % 10}", f"Alpha beta {'gamma ' * (i % 4)}{chr(97 + i % 26) * 3} "
             + " ".join(chr(0xE0 + i % 9) * k for k in range(1, 40))) for i in range(80)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert _run(df, min_docs=3) == brute(rows, 3)


def test_defined_cases(spark):
    rows = [(None, None, None), (None, "a", "x X x"), ("", "b", "x é É ÀB"), ("de", "one", "x"),
            ("fr", "a", ""), ("fr", "b", None), ("fr", "c", "1 2 [_]"),
            ("en", "a", "k" * 3_000_000 + " l l"), ("en", "b", "l" + " l" * 700_000), ("en", "b", "l")] \
        + [("tie", s, "m n o") for s in "ab" for _ in range(2)] + [("tie", "a", "n"), ("tie", "b", "m")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "lang string, source string, text string, rank int, term string")
    assert _run(df, min_docs=1) == brute(rows, 1)
    assert _run(df, min_docs=10) == brute(rows, 10)
    assert _run(df.limit(0)) == set()


def test_terms_as_the_pattern_says():
    text = "A[b]`c_d{e} ÀÉé\x7f\x00z 日本 x1y'Z"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [t.decode() for part in divergence.terms_of(text.encode()) for t in part] == TERM.findall(low)


def test_exact_beyond_double_precision():
    c = np.array([0, 1, 9_007_199_254_740_993 // 2, 4 * 10 ** 15], np.int64)
    total = 8_999_999_999_999_999
    assert divergence.probability(c, total).tolist() == [1 + 10 ** 9 * (int(k) + 2) // total for k in c]


def test_add_up_of_partial_stripes():
    rows = pa.RecordBatch.from_arrays(
        [pa.array(["a", "a", "a", "b"]), pa.array(["", "t", "t", "t"]), pa.array([3, 1, 2, 5]),
         pa.array([["s"], ["s", "r"], ["r"], ["q"]]), pa.array([[3], [1, 4], [5], [9]])],
        schema=divergence.ARROW)
    got = [(r["lang"], r["term"], r["df"], dict(zip(r["sources"], r["counts"])))
           for r in divergence.add_up(rows).to_pylist()]
    assert got == [("a", "", 3, {"s": 3}), ("a", "t", 3, {"s": 1, "r": 9}), ("b", "t", 5, {"q": 9})]
