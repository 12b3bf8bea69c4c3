"""Language id by Bayesian evidence fusion.

log P(l | row) = log prior(l | host) + log P(declared | l) + log P(suffix | l)
               + T * log P(text | l)  + constant

* Text: letter trigrams in hashed buckets, one multinomial per language, fitted
  on a sample of labelled rows of about ``SAMPLE_PER_LANG`` rows per language
  (rows whose id hash is under a threshold set by the language's count), plus
  the class ``und`` with all buckets equally likely.  T < 1 because neighbouring
  trigrams overlap.
* Host prior: soft counts of the text's posterior by host, smoothed towards the
  registered domain, that towards all rows.  Grouped sums of whole millionths,
  so partitioning cannot change them; hosts are joined, never collected.
* Declared markup language and address suffix: smoothed tables of how often
  each value is seen with each language, from the same sums.

A row is accepted if its best language is not ``und``, has a posterior of
``MIN_POSTERIOR`` or more, and the text has letters.

Defined cases: null text is empty; a row without letters keeps the language its
other evidence says but is not accepted.  Null declared, host or suffix are
values of their own (no evidence: they are as likely as the table says).  A declared value of fewer than ``MIN_LABELLED`` rows is no
language of its own, however large the table; of more than ``MAX_LANGS`` values
the commonest are languages.  Ties
go to the first language in name order.  Repeated rows get equal results.  With
no labelled row every language is null and nothing is accepted.  Only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.llm.common import key128, text_or_empty
from civitas.session import materialize_table

BUCKETS = 1 << 14
SAMPLE_PER_LANG = 500
MAX_LANGS = 200
MIN_LABELLED = 2       # rows a declared value needs to be a language, in a table of any size
MAX_SUFFIXES = 2_000
TEMPER = 1 / 3
KAPPA = 20.0           # rows that a parent's prior counts for
ALPHA = 0.5
MIN_POSTERIOR = 0.5
UND = "und"
UND_PRIOR = 1e-3
CHUNK = 1 << 20
MICRO = 1_000_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str):
    """Bucket numbers of the trigrams around each letter, chunk by chunk; what is
    not a letter counts as a space."""
    letter = _letters()
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
    for i in range(0, max(1, len(a) - 2), CHUNK):
        c = a[i:i + CHUNK + 2]
        ok = letter[c]
        c = np.where(ok, c, 32).astype(np.uint32)
        h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B)
             + c[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        yield ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18))[ok[1:-1]]


@dataclass
class TextModel:
    langs: list[str]          # without und
    log_p: np.ndarray         # buckets x (languages + und)

    def log_likelihood(self, text: str) -> tuple[np.ndarray, int]:
        out, n = np.zeros(len(self.langs) + 1), 0
        for g in trigrams(text):
            out += np.take(self.log_p, g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        return out, n


def normal_lang(c: Column) -> Column:
    """The primary subtag in lower case; blank is null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]{2,8})", 1)),
                    F.lit(""))


def fit_text_model(df: DataFrame, id_col: str, text_col: str, lang_col: str,
                   sample_per_lang: int = SAMPLE_PER_LANG) -> TextModel:
    rows = df.select(F.xxhash64(F.col(id_col)).alias("h"), text_or_empty(text_col).alias("text"),
                     normal_lang(F.col(lang_col)).alias("lang"))
    n = rows.where("lang is not null").groupBy("lang").count() \
        .orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    share = {r.lang: min(1.0, sample_per_lang / r["count"]) for r in n
             if r["count"] >= MIN_LABELLED}
    langs = sorted(share)
    if not langs:
        return TextModel([], np.zeros((BUCKETS, 1)))
    bound = {k: int(v * 2 ** 63) - 1 for k, v in share.items()}
    under = F.create_map(*[F.lit(x) for k in langs for x in (k, bound[k])])
    sample = rows.where(F.col("h").bitwiseAND(F.lit(2 ** 63 - 1)) <= under[F.col("lang")])

    def per_task(batches):
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in trigrams(t):
                    counts[langs.index(lang)] += np.bincount(g, minlength=BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()),
                                          "bucket": pa.array(bucket, pa.int32()),
                                          "n": pa.array(counts[lang, bucket], pa.int64())})

    found = sample.select("text", "lang").mapInArrow(per_task, "lang int, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(langs), BUCKETS), 0.1)
    got = found.toPandas()  # at most MAX_LANGS * BUCKETS sums
    counts[got["lang"].to_numpy(int), got["bucket"].to_numpy(int)] += got["n"].to_numpy()
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return TextModel(langs, np.vstack([log_p, np.full((1, BUCKETS), -np.log(BUCKETS))]).T.copy())


def score_texts(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replaces the column ``text`` by ``ll`` (log-likelihoods), ``micro`` (the
    text's own posterior in millionths) and ``n_grams``."""
    keep = [c for c in rows.columns if c != "text"]
    at, kept = rows.columns.index("text"), [rows.columns.index(c) for c in keep]

    def per_task(batches):
        for b in batches:
            found = [model.log_likelihood(t.as_py()) for t in b.column(at)]
            ll = [x for x, _ in found]
            post = [np.exp(TEMPER * (x - x.max())) for x in ll]
            micro = [np.rint(p / p.sum() * MICRO).astype(np.int64) for p in post]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in kept],
                 pa.array([x.tolist() for x in ll], pa.list_(pa.float64())),
                 pa.array([x.tolist() for x in micro], pa.list_(pa.int64())),
                 pa.array([n for _, n in found], pa.int64())],
                names=[*keep, "ll", "micro", "n_grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(per_task, f"{kinds}, ll array<double>, micro array<long>, n_grams long")


def _sums(k: int) -> list[Column]:
    return [F.array(*[F.sum(F.col("micro")[i]) for i in range(k)]).alias("m")]


def _vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def host_priors(scored: DataFrame, k: int) -> DataFrame:
    """host, domain, prior (array by language): host smoothed towards its
    domain, that towards all rows."""
    seen = scored.where("n_grams > 0")
    hosts = seen.groupBy("host", "domain").agg(*_sums(k))
    domains = hosts.groupBy("domain").agg(
        F.array(*[F.sum(F.col("m")[i]) for i in range(k)]).alias("d"))
    total = domains.agg(F.array(*[F.sum(F.col("d")[i]) for i in range(k)]).alias("t")).first().t
    t = np.array([x or 0 for x in total], float) / MICRO + 1
    top = t / t.sum()

    def towards(m: Column, prior: Column) -> Column:
        whole = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(float(MICRO))
        return F.zip_with(m, prior, lambda x, p: (x / F.lit(float(MICRO)) + KAPPA * p)
                          / (whole + KAPPA))

    domains = domains.select(F.col("domain").alias("dom"),
                             towards(F.col("d"), _vector(top)).alias("dp"))
    return hosts.join(domains, hosts["domain"].eqNullSafe(domains["dom"])) \
        .select(F.col("host").alias("p_host"), F.col("domain").alias("p_domain"),
                towards(F.col("m"), F.col("dp")).alias("prior")), top


def likelihood_table(scored: DataFrame, col: str, k: int, most: int) -> dict[str | None, list[float]]:
    """log P(value | language) for the ``most`` commonest values of ``col``;
    under '' for all others."""
    got = scored.where("n_grams > 0").groupBy(col).agg(F.count(F.lit(1)).alias("n"), *_sums(k)) \
        .orderBy(F.desc("n"), col).limit(most).collect()
    m = np.array([r.m for r in got], float).reshape(len(got), k) / MICRO + ALPHA
    m = np.vstack([m, np.full((1, k), ALPHA)])
    log_p = np.log(m / m.sum(axis=0))
    return {**{r[col]: log_p[i].tolist() for i, r in enumerate(got)}, "": log_p[-1].tolist()}


def _lookup(col: Column, values: dict[str | None, list[float]]) -> Column:
    known = sorted(k for k in values if k)
    other = _vector(values[""])
    found = F.create_map(*[x for k in known for x in (F.lit(k), _vector(values[k]))])[col] \
        if known else F.lit(None).cast("array<double>")
    return F.when(col.isNull(), _vector(values.get(None, values[""]))) \
        .otherwise(F.coalesce(found, other))


def identify(df: DataFrame, id_col: str, text_col: str, lang_col: str, host_col: str | None = None,
             min_posterior: float = MIN_POSTERIOR, model: TextModel | None = None,
             sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """One row per row: id, k1, k2 (the text's key), lang, posterior, accepted,
    text_lang (what the text alone says), n_grams."""
    model = model or fit_text_model(df, id_col, text_col, lang_col, sample_per_lang)
    names, k = [*model.langs, UND], len(model.langs) + 1
    host = F.lower(F.col(host_col)) if host_col else F.lit(None).cast("string")
    labels = F.split(host, "\\.")
    n = F.size(labels)
    rows = df.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
        normal_lang(F.col(lang_col)).alias("declared"), host.alias("host"),
        F.when(n > 1, F.concat_ws(".", F.slice(labels, n - 1, F.lit(2)))).alias("domain"),
        F.when(n > 1, F.element_at(labels, -1)).alias("suffix"))
    rows = rows.select("id", *key128(F.col("text")), "text",
                       F.when(F.col("declared").isin(*model.langs) | F.col("declared").isNull(),
                              F.col("declared")).otherwise("other").alias("declared"),
                       "host", "domain", "suffix")
    scored = materialize_table(score_texts(rows, model), "langid-scores")
    if not model.langs:
        return scored.select("id", "k1", "k2", F.lit(None).cast("string").alias("lang"),
                             F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"),
                             F.lit(None).cast("string").alias("text_lang"), "n_grams")
    priors, top = host_priors(scored, k)
    declared = likelihood_table(scored, "declared", k, MAX_LANGS + 2)
    suffix = likelihood_table(scored, "suffix", k, MAX_SUFFIXES)
    joined = scored.join(priors, scored["host"].eqNullSafe(priors["p_host"])
                         & scored["domain"].eqNullSafe(priors["p_domain"]), "left")
    guard = F.array(*[F.lit(0.0)] * (k - 1), F.lit(float(np.log(UND_PRIOR))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(F.transform(F.coalesce("prior", _vector(top)), lambda p: F.log(p)),
                add(add(_lookup(F.col("declared"), declared), _lookup(F.col("suffix"), suffix)),
                    add(F.transform("ll", lambda x: x * TEMPER), guard)))
    out = joined.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    whole = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    lang = _vector_names(names)
    return out.select(
        "id", "k1", "k2", lang[F.array_position("fused", F.col("best")).cast("int") - 1].alias("lang"),
        F.round(1 / whole, 6).alias("posterior"), "n_grams",
        lang[F.array_position("ll", F.array_max("ll")).cast("int") - 1].alias("text_lang"),
    ).select("id", "k1", "k2", "lang", "posterior",
             ((F.col("lang") != UND) & (F.col("posterior") >= min_posterior)
              & (F.col("n_grams") > 0)).alias("accepted"), "text_lang", "n_grams")


def _vector_names(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names])
