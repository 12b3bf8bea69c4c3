"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import small_batches
from civitas.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@register("op7_exact_dedup", """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       coalesce(doc_id = max(doc_id) over w, max(doc_id) over w is null) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm.exact_dedup import exact_classes
    return exact_classes(table(spark, sf_dir, "documents"), "doc_id", "text", keep="largest")


@register("op8_chat_format", r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t, r, '\### Assistant: </turn> ok'
  from (values (0, 'user'), (1, 'assistant')) as v(t, r)
), steps as (
  select *, lag(role) over w as before, row_number() over w as n,
         replace(replace(replace(text, '&', '&0'), '<', '&1'), '>', '&2') as etext,
         replace(replace(replace(role, '&', '&0'), '<', '&1'), '>', '&2') as erole
  from rows window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), ''))
         as loss_sha256,
       cast(sum(length(etext) + length(erole) + 16) as bigint) as formatted_chars,
       bool_and(case when before is null then role in ('system', 'user')
                     when before = 'system' or before = 'assistant' then role = 'user'
                     when before = 'user' then role = 'assistant' else false end)
         and arg_max(role, n) = 'assistant' as valid
from steps group by conv_id
""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, digested from the
    formatted output read back."""
    from civitas.llm import chat
    probe = F.lit("\\### Assistant: </turn> ok")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        probe.alias("text"))
    t = chat.ChatTemplate()
    out = chat.format_conversations(rows.unionByName(extra), t)
    out = out.withColumn("formatted", chat.formatted_text(F.col("segments")))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"), t)) \
        .withColumn("loss", chat.loss_text(F.col("segments"), t))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"],
                                                    F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


def tokenizer_file() -> str:
    """The public byte-level vocabulary; the operator takes any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import bpe
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    vocab = bpe.Vocabulary.read(tokenizer_file())
    codec = bpe.publish(spark, vocab, bpe.frequent_words(docs, "text"))
    out = bpe.decode(bpe.encode(docs, "doc_id", "text", codec), "doc_id", codec)
    return out.select("doc_id", bpe.n_tokens().alias("n_tokens"),
                      F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                      F.sha2(F.col("text"), 256).alias("decoded_sha256"))


@register("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import pii
    small_batches(spark)
    out = pii.personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE],
                      F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"),
                      pii.joined().alias("spans"))


ROLL_BYTES = 4 << 20    # of the query: shards of these pages roll over several files


@register("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, then read back; every figure comes from the archives."""
    from civitas.llm import warc
    from civitas.session import work_dir
    small_batches(spark)
    out = work_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), out, roll_bytes=ROLL_BYTES)
    return warc.read_archives(spark, out, payloads=False).select(
        F.col("id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
        "refers_to")


@register("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import main_text
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    weights = main_text.fit_weights(pages, "page_id", "html")
    out = main_text.extract_main_text(pages, weights)
    return out.select("page_id", "url", "text",
                      F.char_length("text").cast("long").alias("n_chars"))


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its declared language and its source as the host."""
    from civitas.llm import langid
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, "doc_id", "text", "lang", "source")
    return out.select(F.col("id").alias("doc_id"), "lang", "posterior", "accepted", "text_lang",
                      "n_grams")


@register("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: main text, markup language, host and address suffix."""
    from civitas.llm import langid, main_text
    from civitas.session import materialize_table
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    texts = main_text.extract_main_text(pages, main_text.fit_weights(pages, "page_id", "html"))
    marked = pages.select("page_id", F.regexp_extract(
        F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"))
    rows = materialize_table(
        texts.join(marked, "page_id").withColumn("host", F.try_parse_url("url", F.lit("HOST"))),
        "page-texts")
    out = langid.identify(rows, "page_id", "text", "declared", "host")
    return out.select(F.col("id").alias("page_id"), "lang", "posterior", "accepted", "text_lang",
                      "n_grams")


@register("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import near_dedup
    small_batches(spark)
    out = near_dedup.near_classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size",
                      F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


@register("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: the matches."""
    from civitas.llm import decontam
    small_batches(spark)
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"),
                      F.round("lcs", 6).alias("lcs"), F.round("answer", 6).alias("answer"))


@register("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import lm_score
    small_batches(spark)
    out = lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id")


def rank_file() -> str:
    """The public byte-level ranks; the operator takes any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op11_rank_bpe")
def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import bpe, rank_bpe
    small_batches(spark)
    ranks = rank_bpe.publish(spark, rank_file())
    out = rank_bpe.decode(rank_bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", ranks),
                          "doc_id", ranks)
    return out.select("doc_id", bpe.n_tokens().alias("n_tokens"),
                      F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                      F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))


@register("op12_source_divergence", r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), w as (
  select r, lang, source,
         unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term from w group by lang, term having count(distinct r) >= 10
), n as (
  select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all
), groups as (
  select distinct lang, source from d
), v as (
  select lang, count(*) as v from kept group by lang
), p as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(n.n, 0) + 2)) //
           (sum(coalesce(n.n, 0)) over (partition by g.lang, g.source) + 2 * v.v) as p
  from groups g join kept k on k.lang = g.lang join v on v.lang = g.lang
  left join n on n.lang = g.lang and n.source = g.source and n.term = k.term
), q as (
  select k.lang, k.term,
         1 + (1000000000::hugeint * (sum(n.n) + 2)) //
           (sum(sum(n.n)) over (partition by k.lang) + 2 * max(v.v)) as q
  from kept k join v on v.lang = k.lang join n on n.lang = k.lang and n.term = k.term
  group by k.lang, k.term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), results as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q)
  from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part
                               order by value desc, encode(item)) as rank
  from results
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 10
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import divergence
    small_batches(spark)
    return divergence.source_divergence(table(spark, sf_dir, "documents"), "lang", "source", "text")


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civitas.llm import whitening
    small_batches(spark)
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.withColumnRenamed("id", "vec_id")


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
