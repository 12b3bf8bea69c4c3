"""Analytical composites over votes, timelines and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions import vote_flags
from civitas.functions.dates import trunc_hour_ntz
from civitas.operators.aggregates import count_rows, exact_ratio_sql
from civitas.operators.analytics import (deliberation_timeline, divisive, outlier_iqr,
                                         outlier_median_ratio, presence_scorecard,
                                         salary_distribution, timeline_summary)
from civitas.operators.link import join_left_dim
from civitas.operators.quantiles import quantiles_of_counts, value_counts
from civitas.operators.topk import topn
from civitas.operators.trigram import build_trigram_index, search_trigrams
from civitas.plans.clean import EVENT_VOTE
from civitas.plans.registry import register
from civitas.session import work_dir
from civitas.sources.tables import table


def _x(num, den, digits, scale=0):
    return exact_ratio_sql(num, den, digits, scale, "duckdb")


@register("q_presence", f"""
with v as (select user_id,
  coalesce(trim(event_type) = 'click', false) as voto_afirmativo,
  coalesce(trim(event_type) = 'view', false) as voto_negativo,
  coalesce(trim(event_type) in ('error'), false) as ausente,
  coalesce(trim(event_type) in ('signup'), false) as presente_sem_voto
  from events)
select user_id, count(*) as total_votacoes,
  sum(case when voto_afirmativo then 1 else 0 end) as total_sim,
  sum(case when voto_negativo then 1 else 0 end) as total_nao,
  sum(case when presente_sem_voto then 1 else 0 end) as total_abstencao,
  sum(case when ausente then 1 else 0 end) as total_ausente,
  {_x("sum(case when not ausente then 1 else 0 end) * 100", "count(*)", 1)} as taxa_presenca,
  {_x("sum(case when voto_afirmativo or voto_negativo or presente_sem_voto then 1 else 0 end) * 100", "count(*)", 1)} as taxa_presenca_qualquer
from v group by user_id
""")
def q_presence(spark, d):
    """presence_scorecard for all members at once, agg_rate_pct (both
    chambers' presence definitions)."""
    e = table(spark, d, "events").select("user_id", "event_type")
    flags = vote_flags("event_type", **EVENT_VOTE)
    votes = e.select("user_id", *[v.alias(k) for k, v in flags.items()])
    return presence_scorecard(votes, ["user_id"])


@register("q_session_dedup", """
select date_trunc('hour', ts) as sessao, count(*) as n_eventos, count(distinct user_id) as n_membros,
       max(value) as valor_max, max(event_type) as tipo, max(props) as props
from events group by 1
order by sessao desc limit 50
""")
def q_session_dedup(spark, d, n: int = 50):
    """agg_session_dedup (repeated session attributes collapsed by max),
    agg_any_value (max is the repeatable form of any_value, nulls skipped) +
    topn_recent: the latest n sessions."""
    e = table(spark, d, "events")
    s = e.groupBy(trunc_hour_ntz("ts").alias("sessao")).agg(
        count_rows().alias("n_eventos"),
        F.count_distinct("user_id").cast("bigint").alias("n_membros"),
        F.max("value").alias("valor_max"), F.max("event_type").alias("tipo"),
        F.max("props").alias("props"))
    return topn(s, [F.col("sessao").desc()], n)


_TIMELINE_SQL = """
with v as (select l.l_partkey, p.p_type, l.l_orderkey, cast(l.l_shipdate as date) as data,
                  l.l_returnflag, cast(l.l_quantity as integer) as sim,
                  cast(floor(l.l_discount * 100) as integer) as nao
           from lineitem l left join part p on l.l_partkey = p.p_partkey),
s as (select p_type, l_partkey, l_orderkey, max(data) as data_sessao, max(l_returnflag) as resultado,
             max(sim) as votos_sim, max(nao) as votos_nao
      from v group by 1, 2, 3),
t as (select p_type as sigla_materia, l_partkey as materia_identificacao,
             count(distinct l_orderkey) as num_sessoes,
             min(data_sessao) as primeira_sessao, max(data_sessao) as ultima_sessao,
             datediff('day', min(data_sessao), max(data_sessao)) as dias_deliberacao,
             first(resultado order by data_sessao desc, l_orderkey desc) as resultado_final,
             max(votos_sim) as max_sim, max(votos_nao) as max_nao,
             abs(max(votos_sim) - max(votos_nao)) as margem
      from s where p_type is not null and l_partkey is not null group by 1, 2)"""


def _timeline(spark, d):
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    v = join_left_dim(li, p, li.l_partkey == p.p_partkey).select(
        F.col("p_type").alias("sigla_materia"), F.col("l_partkey").alias("materia_identificacao"),
        "l_orderkey", F.col("l_shipdate").cast("date").alias("data"), "l_returnflag",
        F.col("l_quantity").cast("int").alias("sim"),
        F.floor(F.col("l_discount") * 100).cast("int").alias("nao"))
    return deliberation_timeline(v, ["sigla_materia", "materia_identificacao"], "l_orderkey",
                                 "data", "l_returnflag", "sim", "nao")


@register("q_timeline", _TIMELINE_SQL + "\nselect * from t")
def q_timeline(spark, d):
    """deliberation_timeline / agg_span_days / agg_last_by_order /
    date_diff_days: bill = part, session = order, vote date = ship date."""
    return _timeline(spark, d)


@register("q_timeline_summary", _TIMELINE_SQL + f"""
select sigla_materia, count(*) as num_materias,
  {_x("sum(dias_deliberacao)", "count(dias_deliberacao)", 1)} as media_dias,
  max(dias_deliberacao) as max_dias,
  count(case when num_sessoes > 1 then 1 end) as multi_sessao,
  first(materia_identificacao order by dias_deliberacao desc, materia_identificacao asc) as mais_demorada,
  first(materia_identificacao order by dias_deliberacao asc, materia_identificacao asc)
      filter (where num_sessoes > 1) as mais_rapida_multi,
  median(dias_deliberacao) as mediana_dias
from t group by 1 having count(*) >= 5
""")
def q_timeline_summary(spark, d):
    """timeline_summary, agg_median_group (exact, skew-safe), agg_having_min_n,
    spotlight_extremes (argmax / argmin in the same aggregate)."""
    return timeline_summary(_timeline(spark, d), "sigla_materia", "materia_identificacao", 5)


@register("q_divisive", """
with s as (select date_trunc('hour', ts) as sessao,
                  count(case when event_type = 'click' then 1 end) as sim,
                  count(case when event_type = 'view' then 1 end) as nao,
                  max(event_type) as resultado
           from events group by 1),
t as (select strftime(sessao, '%a') as sigla_materia, cast(sessao as date) as materia_identificacao,
             count(distinct sessao) as num_sessoes,
             min(cast(sessao as date)) as primeira_sessao, max(cast(sessao as date)) as ultima_sessao,
             datediff('day', min(cast(sessao as date)), max(cast(sessao as date))) as dias_deliberacao,
             first(resultado order by cast(sessao as date) desc, sessao desc) as resultado_final,
             max(sim) as max_sim, max(nao) as max_nao, abs(max(sim) - max(nao)) as margem
      from s group by 1, 2)
select * from t
where margem is not null and margem <= 10 and max_sim is not null and max_nao is not null
order by margem asc, materia_identificacao asc limit 30
""")
def q_divisive(spark, d):
    """divisive_votes / filter_close_margin: hourly sessions of events are
    votes (yes = clicks, no = views) on a daily "bill"; the 30 closest."""
    e = table(spark, d, "events")
    s = e.groupBy(trunc_hour_ntz("ts").alias("sessao")).agg(
        F.count_if(F.col("event_type") == "click").cast("bigint").alias("sim"),
        F.count_if(F.col("event_type") == "view").cast("bigint").alias("nao"),
        F.max("event_type").alias("resultado"))
    v = s.select(F.date_format(F.col("sessao").cast("date"), "EEE").alias("sigla_materia"),
                 F.col("sessao").cast("date").alias("materia_identificacao"),
                 "sessao", F.col("sessao").cast("date").alias("data"), "resultado", "sim", "nao")
    t = deliberation_timeline(v, ["sigla_materia", "materia_identificacao"], "sessao", "data",
                              "resultado", "sim", "nao")
    return divisive(t, "materia_identificacao", 10, 30)


_NEAREST_SQL = """
r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as rn,
             count(*) over (partition by event_type) as n from events where value is not null),
q as (select event_type, max(n) as n,
             max(case when rn = round(0.25 * (n - 1)) then value end) as q1,
             max(case when rn = round(0.75 * (n - 1)) then value end) as q3
      from r group by 1),
m as (select event_type, median(value) as mediana_grupo from events group by 1),
st as (select q.event_type, q.n, q.q1, q.q3, m.mediana_grupo, q.q3 + 1.5 * (q.q3 - q.q1) as limite_iqr
       from q join m on q.event_type = m.event_type where q.n >= 4)"""


@register("q_outlier_iqr", f"""
with {_NEAREST_SQL}
select e.event_id, e.event_type, e.user_id, e.value, st.mediana_grupo, st.limite_iqr,
       e.value - st.mediana_grupo as desvio_mediana
from events e join st on e.event_type = st.event_type
where e.value > st.limite_iqr
""")
def q_outlier_iqr(spark, d):
    """outlier_iqr / agg_quantile_nearest: values above Q3 + 1.5 IQR per
    event type (groups of >= 4), nearest-rank quartiles, interpolated median.
    union_groups: every group in one grouped query, no per-group loop."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    out = outlier_iqr(e, ["event_type"], "value", min_n=4, k=1.5, quantile_method="nearest")
    return out.select("event_id", "event_type", "user_id", "value", "mediana_grupo",
                      "limite_iqr", "desvio_mediana")


@register("q_salary_distribution", """
select event_type, count(value) as n,
       quantile_cont(value, 0.0) as minimo, quantile_cont(value, 0.25) as q1,
       quantile_cont(value, 0.5) as mediana, quantile_cont(value, 0.75) as q3,
       quantile_cont(value, 1.0) as maximo
from events group by 1
""")
def q_salary_distribution(spark, d):
    """salary_distribution: five-number summary per group (exact)."""
    e = table(spark, d, "events").select("event_type", "value")
    return salary_distribution(e, ["event_type"], "value")


@register("q_outlier_median", """
with m as (select user_id, median(value) as mediana_cat from events group by 1)
select e.event_id, e.user_id, e.event_type, e.value, m.mediana_cat, e.value / m.mediana_cat as razao_mediana
from events e left join m on e.user_id = m.user_id
where e.value / m.mediana_cat > 3.0
""")
def q_outlier_median(spark, d):
    """outlier_median_ratio / join_group_stat_back: value more than 3x its
    member's median, on all rows (no row cap)."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    out = outlier_median_ratio(e, ["user_id"], "value", 3.0)
    return out.select("event_id", "user_id", "event_type", "value", "mediana_cat",
                      "razao_mediana")


EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LICENSE_RE = r"(MIT|Apache|GNU General Public) License"


@register("q_search", f"""
with src as (select d.source, max(l.quality) as q_fonte
             from documents d join labels l on d.doc_id = l.doc_id
             where d.source is not null and d.source <> '' group by 1),
x as (select d.doc_id, d.lang, d.source, l.quality as q_id,
             regexp_matches(d.text, '{EMAIL_RE}') as tem_email,
             upper(d.text) like '%LICENSE%' as tem_licenca,
             nullif(regexp_extract(d.text, '{LICENSE_RE}', 1), '') as licenca
      from documents d left join labels l on d.doc_id = l.doc_id)
select x.doc_id, x.lang, x.tem_email, x.tem_licenca, x.licenca,
       coalesce(x.q_id, src.q_fonte) as qualidade,
       case when x.q_id is not null then 'id' when src.q_fonte is not null then 'nome' end as origem
from x left join src on x.q_id is null and x.source = src.source
""")
def q_search(spark, d):
    """search_text_ci (case-insensitive literal; plain upper() suffices here:
    the engines differ only on the sharp s, which can neither make nor break
    the word searched), search_regex (emails,
    license names) over whole texts, name_fallback_lookup: the label by
    document id, else by the document's source name (second join only for
    the unmatched rows, the registry unique per name)."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("q_id"))
    src = (docs.select("doc_id", "source").join(labels, "doc_id")
               .where(F.col("source").isNotNull() & (F.col("source") != ""))
               .groupBy("source").agg(F.max("q_id").alias("q_fonte")))
    x = docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "q_id",
        F.col("text").rlike(EMAIL_RE).alias("tem_email"),
        F.upper("text").contains("LICENSE").alias("tem_licenca"),
        F.nullif(F.regexp_extract("text", LICENSE_RE, 1), F.lit("")).alias("licenca"))
    j = x.join(src, F.col("q_id").isNull() & (x.source == src.source), "left")
    return j.select("doc_id", "lang", "tem_email", "tem_licenca", "licenca",
                    F.coalesce("q_id", "q_fonte").alias("qualidade"),
                    F.when(F.col("q_id").isNotNull(), "id")
                     .when(F.col("q_fonte").isNotNull(), "nome").alias("origem"))


@register("q_search_pages", f"""
select page_id, url like 'https://%' as https, url like '%?%' as tem_query,
       nullif(regexp_extract(url, '/([a-z]{{2}})/', 1), '') as idioma,
       upper(html) like '%LICENSE%' as tem_licenca,
       regexp_matches(html, '{EMAIL_RE}') as tem_email,
       length(html) as tamanho
from pages where url like 'http%'
""".replace("{{", "{").replace("}}", "}"))
def q_search_pages(spark, d):
    """filter_like on URLs, search over the whole HTML of every page."""
    p = table(spark, d, "pages").where(F.col("url").like("http%"))
    return p.select("page_id", F.col("url").like("https://%").alias("https"),
                    F.col("url").like("%?%").alias("tem_query"),
                    F.nullif(F.regexp_extract("url", r"/([a-z]{2})/", 1), F.lit("")).alias("idioma"),
                    F.upper("html").contains("LICENSE").alias("tem_licenca"),
                    F.col("html").rlike(EMAIL_RE).alias("tem_email"),
                    F.length("html").cast("bigint").alias("tamanho"))


SEARCH_TERMS = ("License", "@example", "SRC1", "ção", "th", "Zq", "é", "no such words")


@register("q_search_terms", "\nunion all\n".join(
    f"select '{t}' as term, doc_id from documents where contains(lower(text), lower('{t}')) "
    f"or contains(lower(source), lower('{t}'))" for t in SEARCH_TERMS))
def q_search_terms(spark, d):
    """search_text_ci for a caller's terms on two columns: an inverted index of
    trigrams is built over all documents; long terms are looked up in it and
    verified, short ones scanned."""
    docs = table(spark, d, "documents")
    path = work_dir(spark, "trigram-index")
    build_trigram_index(docs, "doc_id", ["text", "source"], path)
    return search_trigrams(docs, path, "doc_id", ["text", "source"], SEARCH_TERMS) \
        .withColumnRenamed("id", "doc_id")


@register("q_outlier_null_group", """
with e as (select event_id, nullif(event_type, 'view') as tipo, value from events),
q as (select tipo, count(value) as n, median(value) as mediana,
             quantile_disc(value, 0.75) as q3_disc from e group by 1),
s as (select tipo, list(value order by value) as v, count(value) as n from e where value is not null group by 1),
st as (select s.tipo, q.mediana, v[cast(round(0.25 * (s.n - 1)) as bigint) + 1] as q1,
              v[cast(round(0.75 * (s.n - 1)) as bigint) + 1] as q3
       from s join q on s.tipo is not distinct from q.tipo where s.n >= 4)
select 'iqr' as regra, e.event_id, e.tipo, e.value, st.mediana as referencia
from e join st on e.tipo is not distinct from st.tipo where e.value > q3 + 1.5 * (q3 - q1)
union all
select 'mediana', e.event_id, e.tipo, e.value, st.mediana
from e join st on e.tipo is not distinct from st.tipo where e.value / st.mediana > 3.0
""")
def q_outlier_null_group(spark, d):
    """outlier_iqr, outlier_median_ratio and join_group_stat_back where a group's
    name is null: its outliers are found like any other's."""
    e = table(spark, d, "events").select(
        "event_id", F.expr("nullif(event_type, 'view')").alias("tipo"), "value")
    cols = ["event_id", "tipo", "value"]
    iqr = outlier_iqr(e, ["tipo"], "value").select(
        F.lit("iqr").alias("regra"), *cols, F.col("mediana_grupo").alias("referencia"))
    ratio = outlier_median_ratio(e, ["tipo"], "value", 3.0).select(
        F.lit("mediana").alias("regra"), *cols, F.col("mediana_cat").alias("referencia"))
    return iqr.unionByName(ratio)


@register("q_quantile_state", """
select nullif(l_returnflag, 'N') as situacao, count(l_extendedprice) as n,
       quantile_cont(l_extendedprice, 0.5) as mediana, quantile_cont(l_extendedprice, 0.9) as p90
from lineitem group by 1
""")
def q_quantile_state(spark, d):
    """agg_median_group / agg_quantile_nearest kept current: three loads add
    their value counts to a state; quantiles are read from the state alone and
    equal those of all rows."""
    li = table(spark, d, "lineitem").select(
        F.expr("nullif(l_returnflag, 'N')").alias("situacao"), "l_extendedprice",
        F.year("l_shipdate").alias("ano"))
    state = f"{work_dir(spark, 'quantile-state')}/state"
    for load in (F.coalesce(F.col("ano") <= 1996, F.lit(True)), F.col("ano").between(1997, 1998),
                 F.col("ano") >= 1999):
        value_counts(li.where(load), ["situacao"], "l_extendedprice").write.mode("append").parquet(state)
    return quantiles_of_counts(spark.read.parquet(state), ["situacao"], [0.5, 0.9], "linear",
                               names=["mediana", "p90"])
