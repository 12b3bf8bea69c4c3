"""Held-out accuracy, fusion by hand, smoothing, defined cases."""

import math
import re
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from civitas.llm import langid, queries
from conftest import SF_SMALL

WORDS = {"en": "the and of with from this that", "fr": "le les une dans avec pour que",
         "de": "der die und nicht mit von eine"}


@pytest.fixture(scope="module")
def small(spark):
    rows = []
    for i in range(120):
        lang = sorted(WORDS)[i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i + j * j) % 7] for j in range(12)), lang, f"www.{lang}{i % 2}.example.{lang}"))
    rows += [(500, "the", "fr", "www.en0.example.en"), (501, None, "fr", None), (502, "123 --", "de-AT", "x"),
             (503, "中文文字" * 60, None, "www.en0.example.en"), (504, "der und die von", None, None),
             (504, "der und die von", None, None), (None, "les une dans", "xx", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, host string") \
        .withColumn("micro", F.lit(1))


def test_defined_cases(small):
    got = {}
    for r in langid.identify(small, "doc_id", "text", "lang", "host").collect():
        got.setdefault(r.id, []).append(r)
    assert sum(map(len, got.values())) == small.count()
    for i in range(120):
        assert got[i][0].lang == sorted(WORDS)[i % 3] and got[i][0].accepted
    assert got[500][0].lang == "en"                       # text and host against one declaration
    assert not got[501][0].accepted and got[501][0].n_grams == 0
    assert not got[502][0].accepted
    assert got[503][0].text_lang == langid.UND and not got[503][0].accepted
    assert got[504][0] == got[504][1] and got[504][0].lang == "de"
    assert got[None][0].lang == "fr"


def test_empty_and_unlabelled_tables(spark, small):
    assert langid.identify(small.where("false"), "doc_id", "text", "lang", "host").count() == 0
    rows = langid.identify(small.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text",
                           "lang", "host").collect()
    assert all(r.lang is None and not r.accepted for r in rows) and len(rows) == small.count()


def test_a_rare_language_stays_one_in_a_large_table(spark):
    text = F.when(F.col("id") < 40_000, WORDS["en"]).otherwise(WORDS["fr"])
    df = spark.range(40_003).select(
        "id", F.concat_ws(" ", text, text).alias("text"),
        F.when(F.col("id") < 40_000, "en").otherwise("fr").alias("lang"))
    assert langid.fit_text_model(df, "id", "text", "lang").langs == ["en", "fr"]
    out = langid.identify(df, "id", "text", "lang")
    assert [(r.lang, r.accepted) for r in out.where("id >= 40000").collect()] == [("fr", True)] * 3


def test_priors_are_smoothed_by_level(spark):
    rows = [("a.x.org", "x.org", [900_000, 100_000], 5), ("b.x.org", "x.org", [0, 1_000_000], 5),
            ("c.y.org", "y.org", [500_000, 500_000], 5), ("d.y.org", "y.org", [1_000_000, 0], 0)]
    df = spark.createDataFrame(rows, "host string, domain string, micro array<long>, n_grams long")
    priors, top = langid.host_priors(df, 2)
    t = np.array([1.4 + 1, 1.6 + 1])
    assert np.allclose(top, t / t.sum())
    k = langid.KAPPA
    dom = (np.array([0.9, 1.1]) + k * top) / (2 + k)
    host = (np.array([0.9, 0.1]) + k * dom) / (1 + k)
    got = {r.p_host: r.prior for r in priors.collect()}
    assert np.allclose(got["a.x.org"], host) and set(got) == {"a.x.org", "b.x.org", "c.y.org"}
    table = langid.likelihood_table(df, "domain", 2, 1)
    assert math.isclose(math.exp(table["x.org"][0]), (0.9 + .5) / (0.9 + 1.0), rel_tol=1e-9)
    assert set(table) == {"x.org", ""}


def test_held_out_accuracy_of_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 40")
    model = langid.fit_text_model(even, "doc_id", "text", "lang", sample_per_lang=40)
    blind = odd.withColumn("declared", F.lit(None).cast("string"))
    out = langid.identify(blind, "doc_id", "text", "declared", model=model)
    right = out.join(odd.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id")
    share = right.agg(F.avg((F.col("true") == F.col("text_lang")).cast("int"))).first()[0]
    assert share > 0.98


def test_queries_cover_all_rows(spark):
    out = queries.op1_language_id(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert out.count() == docs.count()
    assert out.join(docs.select("doc_id", F.col("lang").alias("is_in")), "doc_id") \
        .where("lang <> is_in or not accepted").count() == 0
    assert queries.language_id_pages(spark, SF_SMALL).where("accepted").count() \
        == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()


def test_long_texts_in_pieces(monkeypatch):
    whole = np.concatenate(list(langid.trigrams("the quick brown fox " * 50)))
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (np.concatenate(list(langid.trigrams("the quick brown fox " * 50))) == whole).all()


def brute(rows, model):
    """(lang, posterior, accepted, text_lang, n_grams) per row (text, lang, host),
    from the formula alone."""
    names, k = [*model.langs, langid.UND], len(model.langs) + 1
    seen = []
    for text, lang, host in rows:
        ll, n = model.log_likelihood(text or "")
        p = np.exp(langid.TEMPER * (ll - ll.max()))
        m = re.match(r"\s*([A-Za-z]{2,8})", lang or "")
        declared = m and (m[1].lower() if m[1].lower() in model.langs else "other")
        host = host.lower() if host is not None else None
        labels = host.split(".") if host is not None else []
        domain, suffix = (".".join(labels[-2:]), labels[-1]) if len(labels) > 1 else (None, None)
        seen.append((ll, n, np.rint(p / p.sum() * 1e6) / 1e6, declared, host, domain, suffix))

    def sums(key):
        out = {}
        for row in seen:
            if row[1]:
                out[key(row)] = out.get(key(row), 0) + row[2]
        return out
    hosts, domains = sums(lambda r: (r[4], r[5])), sums(lambda r: r[5])
    top = sum(domains.values(), np.zeros(k)) + 1
    top = top / top.sum()
    near = {d: (m + langid.KAPPA * top) / (m.sum() + langid.KAPPA) for d, m in domains.items()}
    prior = {h: (m + langid.KAPPA * near[h[1]]) / (m.sum() + langid.KAPPA) for h, m in hosts.items()}

    def table(at):
        m = sums(lambda r: r[at])
        whole = sum(m.values(), np.zeros(k)) + langid.ALPHA * (len(m) + 1)
        return {**{v: np.log((x + langid.ALPHA) / whole) for v, x in m.items()}, "": np.log(langid.ALPHA / whole)}
    said, ends = table(3), table(6)
    out = []
    for ll, n, _, declared, host, domain, suffix in seen:
        x = np.log(prior.get((host, domain), top)) + said.get(declared, said[""]) + ends.get(suffix, ends[""]) \
            + langid.TEMPER * ll
        x[-1] += math.log(langid.UND_PRIOR)
        post = 1 / np.exp(x - x.max()).sum()
        lang = names[int(x.argmax())]
        out.append((lang, post, lang != langid.UND and round(post, 6) >= langid.MIN_POSTERIOR and n > 0,
                    names[int(ll.argmax())], n))
    return out


def check_fused(got, rows, model):
    """``got``: id -> rows of the operator; ``rows``: (id, text, lang, host)."""
    want = brute([r[1:] for r in rows], model)
    assert sum(map(len, got.values())) == len(rows)
    for (ident, *_), (lang, post, accepted, text_lang, n) in zip(rows, want):
        assert any(g.lang == lang and abs(g.posterior - post) < 2e-6 and g.accepted == accepted
                   and g.text_lang == text_lang and g.n_grams == n for g in got[ident]), ident


def by_id(rows, col):
    out = {}
    for r in rows:
        out.setdefault(r[col], []).append(r)
    return out


def test_fused_posterior_equals_the_formula(small):
    model = langid.fit_text_model(small, "doc_id", "text", "lang")
    got = by_id(langid.identify(small, "doc_id", "text", "lang", "host", model=model).collect(), "id")
    check_fused(got, [tuple(r)[:4] for r in small.collect()], model)


def test_queries_equal_the_formula(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = langid.fit_text_model(docs, "doc_id", "text", "lang")
    got = by_id(queries.op1_language_id(spark, SF_SMALL).collect(), "doc_id")
    check_fused(got, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], model)

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = []
    for r in queries.op2_main_text(spark, SF_SMALL).collect():
        marked = re.search(r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", pages[r.page_id].html or "")
        rows.append((r.page_id, r.text, marked[1] if marked else "", urlsplit(r.url).hostname))
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, host string")
    model = langid.fit_text_model(df, "page_id", "text", "declared")
    check_fused(by_id(queries.language_id_pages(spark, SF_SMALL).collect(), "page_id"), rows, model)
