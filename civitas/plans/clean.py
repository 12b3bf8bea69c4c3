"""Cleaning and parsing queries: the scalar functions of SURVEY 2.10."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions import (blank_to_null, bool_parse_3, brl_to_decimal,
                               brl_to_number_lenient, cap_value, coalesce_label,
                               date_dmy, date_iso_prefix, date_two_formats,
                               digits_only, doc_format, doc_type, flag_map,
                               flag_prefix, id_to_text, label_map, lookup_label,
                               mask_sentinel, money_format, month_key, month_label,
                               normalize_name_nfkd, normalize_name_sql, null_flag,
                               null_to_blank, parse_identifier, stable_id, surrogate_md5,
                               to_money,
                               upper_trim, vote_flags, year_from_date_or_text)
from civitas.functions.dates import format_ntz
from civitas.functions.text import NAME_ACCENTS_FROM, NAME_ACCENTS_TO
from civitas.operators.aggregates import count_rows, sum_money
from civitas.plans.registry import register
from civitas.sources.tables import table


@register("q_staging_clean", """
select coalesce(cast(c.c_custkey as varchar), '') as customer_id,
       upper(trim(c.c_name)) as nome,
       nullif(trim(c.c_mktsegment), '') as segmento,
       coalesce(c.c_mktsegment, '') as segmento_txt,
       c.c_nationkey as c_nationkey,
       cast(cast(c.c_acctbal as decimal(12,2)) as double) as saldo,
       coalesce(n.n_name, cast(c.c_nationkey as varchar)) as pais
from customer c left join nation n on c.c_nationkey = n.n_nationkey
where c.c_custkey is not null and nullif(trim(c.c_name), '') is not null
""")
def q_staging_clean(spark, d):
    """scan_parquet (explicit schema), project_rename_cast,
    filter_required_key, upper_trim, blank_to_null, null_to_blank,
    prefer_other_source (dimension value, else raw code)."""
    c = table(spark, d, "customer")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    staged = (c.where(F.col("c_custkey").isNotNull() & blank_to_null("c_name").isNotNull())
               .select(id_to_text("c_custkey").alias("customer_id"),
                       upper_trim("c_name").alias("nome"),
                       blank_to_null("c_mktsegment").alias("segmento"),
                       null_to_blank("c_mktsegment").alias("segmento_txt"),
                       "c_nationkey",
                       to_money("c_acctbal", 12, 2).cast("double").alias("saldo")))
    joined = staged.join(nation,
                         staged.c_nationkey == nation.n_nationkey, "left")
    return joined.select("customer_id", "nome", "segmento", "segmento_txt", "c_nationkey",
                         "saldo", F.coalesce("n_name", F.col("c_nationkey").cast("string"))
                         .alias("pais"))


@register("q_brl_parse", r"""
with t as (
  select o_orderkey, o_totalprice,
         translate(format('{:,.2f}', o_totalprice), ',.', '.,') as valor_texto
  from orders),
p as (
  select *,
    cast(try_cast(replace(replace(trim(valor_texto), '.', ''), ',', '.') as decimal(18,2)) as double) as valor_estrito,
    regexp_replace(trim('R$ ' || valor_texto), '[R$\s]', '', 'g') as lx,
    cast(o_totalprice as varchar) as nx
  from t)
select o_orderkey, valor_texto, valor_estrito,
  cast(try_cast(replace(replace(trim('R$ ' || valor_texto), '.', ''), ',', '.') as decimal(18,2)) as double) as estrito_prefixado,
  cast(coalesce(try_cast(case when contains(lx, ',') then replace(replace(lx, '.', ''), ',', '.') else lx end as decimal(18,2)), 0) as double) as valor_leniente,
  cast(coalesce(try_cast(case when contains(nx, ',') then replace(replace(nx, '.', ''), ',', '.') else nx end as decimal(18,2)), 0) as double) as numero_leniente,
  case when valor_estrito > 400000.0 then null else valor_estrito end as valor_limitado,
  'R$ ' || translate(format('{:,.2f}', valor_estrito), ',.', '.,') as valor_formatado,
  round(abs(valor_estrito - o_totalprice), 2) as diferenca
from p
where valor_estrito > 0
""")
def q_brl_parse(spark, d):
    """brl_to_decimal (strict), brl_to_number_lenient (R$ prefix, numeric text
    guarded), cap_value, money_format, round_abs, filter_positive_amount."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    t = o.withColumn("valor_texto",
                     F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    strict = brl_to_decimal("valor_texto", 18, 2).cast("double")
    p = t.withColumn("valor_estrito", strict)
    prefixed = F.concat(F.lit("R$ "), F.col("valor_texto"))
    return (p.where(F.col("valor_estrito") > 0)
             .select("o_orderkey", "valor_texto", "valor_estrito",
                     brl_to_decimal(prefixed, 18, 2).cast("double").alias("estrito_prefixado"),
                     brl_to_number_lenient(prefixed).cast("double").alias("valor_leniente"),
                     brl_to_number_lenient(F.col("o_totalprice").cast("string"))
                     .cast("double").alias("numero_leniente"),
                     cap_value("valor_estrito", 400000.0).alias("valor_limitado"),
                     money_format("valor_estrito").alias("valor_formatado"),
                     F.round(F.abs(F.col("valor_estrito") - F.col("o_totalprice")), 2)
                     .alias("diferenca")))


@register("q_name_fold", f"""
select doc_id,
  md5(upper(trim(replace(replace(replace(translate(coalesce(text, ''), '{NAME_ACCENTS_FROM}', '{NAME_ACCENTS_TO}'), '.', ''), '-', ' '), '  ', ' ')))) as nome_sql_md5,
  length(upper(trim(replace(replace(replace(translate(coalesce(text, ''), '{NAME_ACCENTS_FROM}', '{NAME_ACCENTS_TO}'), '.', ''), '-', ' '), '  ', ' ')))) as nome_sql_len,
  md5(upper(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g')))) as nome_nfkd_md5,
  md5(lower(text)) as lower_md5
from documents
""")
def q_name_fold(spark, d):
    """normalize_name_sql (the macro), normalize_name_nfkd (Latin blocks),
    lower — over every document's whole text; digests keep the result small."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    sql_form = normalize_name_sql("text")
    return docs.select("doc_id",
                       F.md5(sql_form).alias("nome_sql_md5"),
                       F.length(sql_form).cast("bigint").alias("nome_sql_len"),
                       F.md5(normalize_name_nfkd("text")).alias("nome_nfkd_md5"),
                       F.md5(F.lower("text")).alias("lower_md5"))


_DOC_RAW_SQL = r"""
case c_custkey % 4
  when 0 then lpad(cast(c_custkey as varchar), 11, '0')
  when 1 then regexp_replace(lpad(cast(c_custkey as varchar), 14, '0'), '^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$', '\1.\2.\3/\4-\5')
  when 2 then '-4'
  else cast(c_custkey as varchar) end"""


@register("q_doc_type", rf"""
with r as (select c_custkey, {_DOC_RAW_SQL} as doc_raw from customer),
d as (select *, regexp_replace(doc_raw, '[^0-9]', '', 'g') as digitos from r)
select c_custkey, doc_raw, digitos,
  case when length(digitos) = 14 then 'CNPJ' when length(digitos) = 11 then 'CPF' else 'unknown' end as tipo_documento,
  case when length(digitos) = 11 then regexp_replace(digitos, '^(\d{{3}})(\d{{3}})(\d{{3}})(\d{{2}})$', '\1.\2.\3-\4')
       when length(digitos) = 14 then regexp_replace(digitos, '^(\d{{2}})(\d{{3}})(\d{{3}})(\d{{4}})(\d{{2}})$', '\1.\2.\3/\4-\5')
       else digitos end as doc_formatado,
  case when trim(doc_raw) in ('-4') then null else doc_raw end as doc_mascarado
from d
""".replace("{{", "{").replace("}}", "}"))
def q_doc_type(spark, d):
    """digits_only, doc_type, doc_format, mask_sentinel over tax ids derived
    from the customer key in four shapes (CPF, formatted CNPJ, sentinel, short)."""
    c = table(spark, d, "customer").select("c_custkey")
    key = F.col("c_custkey").cast("string")
    raw = (F.when(F.col("c_custkey") % 4 == 0, F.lpad(key, 11, "0"))
            .when(F.col("c_custkey") % 4 == 1, doc_format(F.lpad(key, 14, "0")))
            .when(F.col("c_custkey") % 4 == 2, F.lit("-4"))
            .otherwise(key))
    r = c.withColumn("doc_raw", raw)
    return r.select("c_custkey", "doc_raw",
                    digits_only("doc_raw").alias("digitos"),
                    doc_type("doc_raw").alias("tipo_documento"),
                    doc_format("doc_raw").alias("doc_formatado"),
                    mask_sentinel("doc_raw").alias("doc_mascarado"))


def _parts_sql(*cols):
    return ", ".join(f"coalesce(cast({c} as varchar), '')" for c in cols)


@register("q_stable_ids", f"""
select l_orderkey, l_linenumber,
  substr(sha256('li_' || concat_ws('|', {_parts_sql('l_orderkey', 'l_linenumber')})), 1, 16) as line_id,
  md5(concat_ws('|', {_parts_sql('l_orderkey', 'l_partkey', 'l_suppkey', 'l_shipdate', 'l_extendedprice', 'l_returnflag')})) as line_md5
from lineitem
""")
def q_stable_ids(spark, d):
    """stable_id (sha256 prefix), surrogate_md5 — udf_rowwise re-aimed:
    built-in expressions, no row UDF."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     stable_id("li", "l_orderkey", "l_linenumber").alias("line_id"),
                     surrogate_md5("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
                                   "l_extendedprice", "l_returnflag").alias("line_md5"))


@register("q_dates", """
with r as (
  select o_orderkey, o_orderdate,
    case o_orderkey % 5
      when 0 then strftime(o_orderdate, '%Y-%m-%d')
      when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
      when 2 then strftime(o_orderdate, '%d/%m/%Y')
      when 3 then '31/02/' || cast(year(o_orderdate) as varchar)
      else '' end as data_texto,
    month(o_orderdate) + case when o_orderkey % 7 = 0 then 12 else 0 end as mes_raw,
    case when o_orderkey % 3 = 0 then cast(year(o_orderdate) as varchar) else 'n/a' end as ano_texto
  from orders)
select o_orderkey, data_texto,
  try_cast(left(data_texto, 10) as date) as data_iso,
  cast(try_strptime(data_texto, '%d/%m/%Y') as date) as data_dmy,
  coalesce(cast(try_strptime(data_texto, '%d/%m/%Y') as date), try_cast(left(data_texto, 10) as date)) as data,
  case when mes_raw between 1 and 12 then make_date(year(o_orderdate), mes_raw, 1) end as mes_ref,
  coalesce(try_cast(ano_texto as integer),
           year(coalesce(cast(try_strptime(data_texto, '%d/%m/%Y') as date), try_cast(left(data_texto, 10) as date)))) as ano
from r
""")
def q_dates(spark, d):
    """date_iso_prefix, date_dmy, date_two_formats (bad rows -> null, never a
    failed job), month_key (month 13 guarded), year_from_date_or_text."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    txt = (F.when(k % 5 == 0, format_ntz("o_orderdate", "yyyy-MM-dd"))
            .when(k % 5 == 1, format_ntz("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k % 5 == 2, format_ntz("o_orderdate", "dd/MM/yyyy"))
            .when(k % 5 == 3, F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string")))
            .otherwise(F.lit("")))
    r = o.select("o_orderkey", "o_orderdate", txt.alias("data_texto"),
                 (F.month("o_orderdate") + F.when(k % 7 == 0, 12).otherwise(0)).alias("mes_raw"),
                 F.when(k % 3 == 0, F.year("o_orderdate").cast("string"))
                  .otherwise(F.lit("n/a")).alias("ano_texto"))
    r = r.withColumn("data", date_two_formats("data_texto"))
    return r.select("o_orderkey", "data_texto",
                    date_iso_prefix("data_texto").alias("data_iso"),
                    date_dmy("data_texto").alias("data_dmy"),
                    "data",
                    month_key(F.year("o_orderdate"), "mes_raw").alias("mes_ref"),
                    year_from_date_or_text("ano_texto", "data").alias("ano"))


# Category labels for the test binding (our own data, a broadcast lookup table).
PART_TYPE_LABELS = {"ECONOMY": "Econômica", "PROMO": "Promocional", "LARGE": "Grande",
                    "MEDIUM": "Média", "SMALL": "Pequena"}
RETURN_FLAG_LABELS = {"R": "Devolvido", "A": "Aceito"}


def _values_sql(mapping):
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


@register("q_category_map", f"""
with m(k, v) as (values {_values_sql(PART_TYPE_LABELS)})
select coalesce(m.v, lower(trim(p.p_type))) as categoria,
       coalesce(case l.l_returnflag {' '.join(f"when '{k}' then '{v}'" for k, v in RETURN_FLAG_LABELS.items())} end, l.l_returnflag) as situacao,
       coalesce((['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'])[month(l.l_shipdate)], 'N/D') as mes,
       count(*) as n_itens,
       cast(sum(cast(l.l_extendedprice as decimal(18,2))) as double) as total
from lineitem l left join part p on l.l_partkey = p.p_partkey
left join m on upper(trim(p.p_type)) = m.k
group by all
""")
def q_category_map(spark, d):
    """category_map (lookup table + lower(trim) fallback), label_map,
    month_label, coalesce_label, then a grouped total."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate",
                                            "l_extendedprice")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    j = lookup_label(spark, j, upper_trim("p_type"), PART_TYPE_LABELS, "categoria",
                     default=F.lower(F.trim("p_type")))
    j = j.select("categoria",
                 label_map("l_returnflag", RETURN_FLAG_LABELS).alias("situacao"),
                 coalesce_label(month_label(F.month("l_shipdate"))).alias("mes"),
                 "l_extendedprice")
    return j.groupBy("categoria", "situacao", "mes").agg(
        count_rows().alias("n_itens"), sum_money("l_extendedprice").alias("total"))


# Vote labels of the binding: event types stand for the vote a member cast.
EVENT_VOTE = dict(yes="click", no="view", absent=("error",), present_no_vote=("signup",))


@register("q_vote_flags", """
select event_id, user_id,
  coalesce(trim(event_type) = 'click', false) as voto_afirmativo,
  coalesce(trim(event_type) = 'view', false) as voto_negativo,
  coalesce(trim(event_type) in ('error'), false) as ausente,
  coalesce(trim(event_type) in ('signup'), false) as presente_sem_voto,
  case trim(case when value >= 50 then 'S' when value < 10 then 'N' else '?' end)
       when 'S' then true when 'N' then false end as flag_alto,
  case when upper(trim(case when value > 100 then 'sim' when value < 5 then 'NÃO' else 'talvez' end)) in ('SIM','S','TRUE','1') then true
       when upper(trim(case when value > 100 then 'sim' when value < 5 then 'NÃO' else 'talvez' end)) in ('NAO','NÃO','N','FALSE','0') then false end as flag_texto,
  coalesce(starts_with(event_type, 'sign'), false) as eh_cadastro,
  json_extract_string(props, '$.k') is not null as tem_k
from events
""")
def q_vote_flags(spark, d):
    """vote_flags (two-valued), flag_map and bool_parse_3 (three-valued),
    flag_prefix, null_flag."""
    e = table(spark, d, "events")
    flags = vote_flags("event_type", **EVENT_VOTE)
    sn = (F.when(F.col("value") >= 50, "S").when(F.col("value") < 10, "N").otherwise("?"))
    word = (F.when(F.col("value") > 100, "sim").when(F.col("value") < 5, "NÃO")
             .otherwise("talvez"))
    return e.select("event_id", "user_id", *[v.alias(k) for k, v in flags.items()],
                    flag_map(sn).alias("flag_alto"),
                    bool_parse_3(word).alias("flag_texto"),
                    flag_prefix("event_type", "sign").alias("eh_cadastro"),
                    null_flag(F.get_json_object("props", "$.k")).alias("tem_k"))


_IDENT_SQL = """
case {k} % 3
  when 0 then upper(left({n}, 3)) || ' ' || cast({k} as varchar) || '/' || cast(1990 + {k} % 30 as varchar)
  when 1 then upper(left({n}, 3)) || ' ' || cast({k} as varchar)
  else {n} end"""


@register("q_parse_identifier", rf"""
with ids as (
  select 'supplier' as entidade, s_suppkey as chave, {_IDENT_SQL.format(k='s_suppkey', n='s_name')} as identificacao from supplier
  union all
  select 'customer', c_custkey, {_IDENT_SQL.format(k='c_custkey', n='c_name')} from customer)
select entidade, chave, identificacao,
  nullif(case when instr(identificacao, ' ') > 0
              then left(identificacao, instr(identificacao, ' ') - 1) else identificacao end, '') as sigla,
  nullif(split_part(resto, '/', 1), '') as numero,
  try_cast(nullif(split_part(resto, '/', 2), '') as integer) as ano
from (select *, case when instr(identificacao, ' ') > 0
                     then substr(identificacao, instr(identificacao, ' ') + 1) else '' end as resto
      from ids) as ids
""".replace("{{", "{").replace("}}", "}"))
def q_parse_identifier(spark, d):
    """parse_identifier: ``TYPE NUMBER/YEAR`` with missing parts tolerated,
    over identifiers built from both registries (union_diagonal)."""
    def ids(tbl, k, n, ent):
        key, name = F.col(k), F.col(n)
        ident = (F.when(key % 3 == 0, F.concat(F.upper(F.left(name, F.lit(3))), F.lit(" "),
                                               key.cast("string"), F.lit("/"),
                                               (F.lit(1990) + key % 30).cast("string")))
                  .when(key % 3 == 1, F.concat(F.upper(F.left(name, F.lit(3))), F.lit(" "),
                                               key.cast("string")))
                  .otherwise(name))
        return table(spark, d, tbl).select(F.lit(ent).alias("entidade"), key.alias("chave"),
                                           ident.alias("identificacao"))
    u = ids("supplier", "s_suppkey", "s_name", "supplier").unionByName(
        ids("customer", "c_custkey", "c_name", "customer"))
    sigla, numero, ano = parse_identifier("identificacao")
    return u.select("entidade", "chave", "identificacao", sigla.alias("sigla"),
                    numero.alias("numero"), ano.alias("ano"))
