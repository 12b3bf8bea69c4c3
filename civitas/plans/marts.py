"""Aggregates, top-k and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions import brl_to_decimal, coalesce_label, month_windows, period_label, to_money
from civitas.functions.dates import year_between
from civitas.operators.aggregates import (avg_coalesced, avg_round, count_distinct_many,
                                          exact_ratio_sql, coalesce_max,                                           count_if, count_rows, gross_pay, rollup_additive,
                                          sum_if_money, sum_money, unpivot_components)
from civitas.operators.dedup import earliest_per_key
from civitas.operators.distinct_state import totals_by_level
from civitas.operators.link import join_counts_zero_fill, join_left_dim
from civitas.operators.quality import dq_report
from civitas.operators.topk import topk_per_group, topn, topn_other_bucket, topn_sum
from civitas.plans._sql import avg4, money_sum
from civitas.plans.registry import register
from civitas.schemas import TABLES
from civitas.session import materialize_table
from civitas.sources.tables import adhoc_sql, list_tables, register_views, table

AS_OF = "2001-06-01"


@register("q_agg_monthly", f"""
select year(l_shipdate) as ano, coalesce(l_returnflag, 'N/D') as situacao,
       {money_sum('l_extendedprice')} as total, count(*) as n_itens
from lineitem group by 1, 2
""")
def q_agg_monthly(spark, d):
    """agg_wide_null_group (six-column monthly mart, null groups labelled),
    agg_sum_count, then agg_rollup_from_agg of its additive measures to
    (year, flag) — equal to aggregating the fact directly
    (totals_by_year_entity / payroll_breakdowns are this shape)."""
    li = table(spark, d, "lineitem")
    mart = li.groupBy(F.year("l_shipdate").alias("ano"), F.month("l_shipdate").alias("mes"),
                      coalesce_label("l_returnflag").alias("situacao"),
                      coalesce_label("l_linestatus").alias("status"),
                      coalesce_label(F.col("l_discount").cast("string")).alias("desconto"),
                      coalesce_label(F.col("l_tax").cast("string")).alias("imposto")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
        count_rows().alias("n_itens"))
    out = rollup_additive(mart, ["ano", "situacao"], ["total", "n_itens"])
    return out.select("ano", "situacao", F.col("total").cast("double").alias("total"),
                      F.col("n_itens").cast("bigint").alias("n_itens"))


@register("q_agg_author", f"""
select o.o_custkey,
  count(distinct l.l_orderkey) as n_pedidos,
  count(distinct l.l_partkey) as n_pecas,
  count(distinct l.l_suppkey) as n_fornecedores,
  coalesce(max(case when l.l_linestatus = 'F' then o.o_orderstatus end), max(o.o_orderpriority)) as atributo,
  bool_or(l.l_returnflag = 'R') as tem_devolucao,
  {avg4('l.l_discount', zero_null=True)} as desconto_medio
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
group by o.o_custkey
""")
def q_agg_author(spark, d):
    """agg_count_distinct (three, without row expansion),
    agg_coalesce_max, agg_bool_or, agg_avg_coalesced per buyer."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus",
                                            "l_returnflag", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    # each count reads the joined rows once more
    j = materialize_table(li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey"), "author-lines")
    return count_distinct_many(
        j, ["o_custkey"],
        {"n_pedidos": "l_orderkey", "n_pecas": "l_partkey", "n_fornecedores": "l_suppkey"},
        [coalesce_max(F.when(F.col("l_linestatus") == "F", F.col("o_orderstatus")),
                      "o_orderpriority").alias("atributo"),
         F.bool_or(F.col("l_returnflag") == "R").alias("tem_devolucao"),
         avg_coalesced("l_discount").alias("desconto_medio")])


@register("q_agg_phase", """
select year(l_shipdate) as ano,
  cast(sum(case when l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2)) end) as double) as empenhado,
  cast(sum(case when l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) end) as double) as pago,
  cast(sum(case when l_linestatus = 'X' then cast(l_extendedprice as decimal(18,2)) end) as double) as cancelado,
  count(case when l_returnflag = 'R' then 1 end) as n_devolvidos,
  count(case when l_linestatus = 'X' then 1 end) as n_cancelados,
  count(distinct case when l_linestatus = 'F' then l_suppkey end) as fornecedores_pagos,
  count(distinct case when l_returnflag = 'R' then l_orderkey end) as pedidos_devolvidos
from lineitem group by 1
""")
def q_agg_phase(spark, d):
    """agg_phase_split_sum (committed vs paid in one scan),
    agg_conditional_count (count -> 0, sum -> null when nothing matches),
    agg_conditional_distinct (count_distinct_many over when(cond, c);
    count_distinct_if is the single-aggregate form)."""
    li = table(spark, d, "lineitem").withColumn("ano", F.year("l_shipdate"))
    st, fl = F.col("l_linestatus"), F.col("l_returnflag")
    return count_distinct_many(
        li, ["ano"],
        {"fornecedores_pagos": F.when(st == "F", F.col("l_suppkey")),
         "pedidos_devolvidos": F.when(fl == "R", F.col("l_orderkey"))},
        [sum_if_money(st == "O", "l_extendedprice").alias("empenhado"),
         sum_if_money(st == "F", "l_extendedprice").alias("pago"),
         sum_if_money(st == "X", "l_extendedprice").alias("cancelado"),
         count_if(fl == "R").alias("n_devolvidos"),
         count_if(st == "X").alias("n_cancelados")])


_CONTRACT_SQL = """
  count(*) as n_contratos,
  cast(sum(try_cast(replace(replace(translate(format('{:,.2f}', o_totalprice), ',.', '.,'), '.', ''), ',', '.') as decimal(18,2))) as double) as total,
  """ + avg4("o_totalprice") + """ as media,
  max(o_totalprice) as maior,
  min(year(o_orderdate)) as ano_min, max(year(o_orderdate)) as ano_max"""


@register("q_agg_contracts", f"""
select o_orderstatus as orgao, {_CONTRACT_SQL}
from orders where year(o_orderdate) between 1996 and 2000 group by 1
union all
select 'TOTAL', {_CONTRACT_SQL}
from orders where year(o_orderdate) between 1996 and 2000
""")
def q_agg_contracts(spark, d):
    """filter_between, sum_multi_row_amendment (sum of money parsed from
    text), agg_avg_max, agg_global_kpi (keyless aggregate) per status + total."""
    o = table(spark, d, "orders").where(year_between("o_orderdate", 1996, 2000))
    o = o.withColumn("valor_texto", F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    aggs = [count_rows().alias("n_contratos"),
            F.sum(brl_to_decimal("valor_texto", 18, 2)).cast("double").alias("total"),
            avg_round("o_totalprice").alias("media"),
            F.max("o_totalprice").alias("maior"),
            F.min(F.year("o_orderdate")).alias("ano_min"),
            F.max(F.year("o_orderdate")).alias("ano_max")]
    by_status = o.groupBy(F.col("o_orderstatus").alias("orgao")).agg(*aggs)
    total = o.agg(*aggs).select(F.lit("TOTAL").alias("orgao"), "*")
    return by_status.unionByName(total)


@register("q_agg_two_level", f"""
with m as (select o_orderstatus, year(o_orderdate) as ano, month(o_orderdate) as mes,
                  sum(cast(o_totalprice as decimal(18,2))) as total_mes
           from orders group by 1, 2, 3),
y as (select o_orderstatus, ano, cast(sum(total_mes) as double) as total_ano,
             cast({avg4('total_mes', digits=0)} as integer) as media_mensal,
             count(*) as meses,
             {exact_ratio_sql("sum(cast(total_mes * 100 as hugeint))", "count(distinct mes)", 2, 2, "duckdb")} as total_por_mes
      from m group by 1, 2),
r as (select o_orderstatus, min(ano * 100 + mes) as primeiro_periodo, max(ano * 100 + mes) as ultimo_periodo,
             count(distinct ano) > 1 as varios_anos
      from m group by 1)
select y.*, r.primeiro_periodo, r.ultimo_periodo, r.varios_anos
from y join r on y.o_orderstatus = r.o_orderstatus
""")
def q_agg_two_level(spark, d):
    """agg_two_level (monthly sums -> yearly sum and integer monthly mean),
    agg_ratio_of_aggs (sum / distinct months), agg_min_max_range.  The mean is an
    ``int`` as in the SQL; where one is past that type, which the SQL cannot
    answer, the column is a ``bigint``."""
    o = table(spark, d, "orders")
    m = o.groupBy("o_orderstatus", F.year("o_orderdate").alias("ano"),
                  F.month("o_orderdate").alias("mes")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_mes"))
    m = materialize_table(m, "monthly-totals")  # a row per status and month
    y = m.groupBy("o_orderstatus", "ano").agg(
        F.sum("total_mes").cast("double").alias("total_ano"),
        avg_round("total_mes", 0).cast("bigint").alias("media_mensal"),
        count_rows().alias("meses"),
        F.expr(exact_ratio_sql("sum(cast(total_mes * 100 as decimal(38,0)))",
                               "count(distinct mes)", 2, 2)).alias("total_por_mes"))
    if (y.agg(F.max(F.abs("media_mensal"))).first()[0] or 0) < 2 ** 31:
        y = y.withColumn("media_mensal", F.col("media_mensal").cast("int"))
    r = m.groupBy("o_orderstatus").agg(
        F.min(F.col("ano") * 100 + F.col("mes")).alias("primeiro_periodo"),
        F.max(F.col("ano") * 100 + F.col("mes")).alias("ultimo_periodo"),
        (F.count_distinct("ano") > 1).alias("varios_anos"))
    return y.join(r, "o_orderstatus")


@register("q_top_n", """
with li as (
  select l_suppkey,
    try_cast(replace(replace(trim(translate(format('{:,.2f}', l_extendedprice), ',.', '.,')), '.', ''), ',', '.') as decimal(18,2)) as valor
  from lineitem)
select s.s_suppkey, s.s_name, s.s_nationkey, cast(sum(li.valor) as double) as total, count(*) as n_itens
from li left join supplier s on li.l_suppkey = s.s_suppkey
group by s.s_suppkey, s.s_name, s.s_nationkey
order by total desc nulls last, s_suppkey asc nulls last limit 15
""")
def q_top_n(spark, d):
    """Flagship: clean (locale money text -> decimal), aggregate by the payee's
    key, denormalise the aggregate, top 15 payees (topn_sum with the key as
    tie-break; planned as TakeOrderedAndProject)."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    li = li.select("l_suppkey", brl_to_decimal(
        F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), 18, 2).alias("valor"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    paid = li.groupBy("l_suppkey").agg(F.sum("valor").alias("valor"), count_rows().alias("n"))
    f = join_left_dim(paid, s, paid.l_suppkey == s.s_suppkey)
    # keys without a supplier fall together in one null row
    top = topn_sum(f, ["s_suppkey", "s_name", "s_nationkey"], F.sum("valor"), 15,
                   extra_aggs=[F.sum("n").alias("n_itens")])
    return top.select("s_suppkey", "s_name", "s_nationkey",
                      F.col("total").cast("double").alias("total"), "n_itens")


@register("q_top_rows", """
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
       coalesce(o.o_orderpriority, 'N/D') as prioridade
from lineitem l left join orders o on l.l_orderkey = o.o_orderkey
where year(l.l_shipdate) between 1996 and 2000 and l.l_returnflag <> 'N'
order by l.l_extendedprice desc, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
limit 100
""")
def q_top_rows(spark, d, n: int = 100, descending: bool = True):
    """topn_rows / topn_within_filtered / rank_asc_or_desc / order_multi:
    the n largest receipts of a period, one label excluded, labels defaulted."""
    li = table(spark, d, "lineitem").where(year_between("l_shipdate", 1996, 2000)
                                           & (F.col("l_returnflag") != "N"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    price = F.col("l_extendedprice").desc() if descending else F.col("l_extendedprice").asc()
    top = topn(li, [price, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], n)
    # the limit comes first: orders is only filtered by the n keys, not shuffled
    keys = top.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    few = earliest_per_key(o.join(F.broadcast(keys), "o_orderkey", "left_semi"), ["o_orderkey"],
                           [F.col("o_orderpriority")])
    return top.join(few, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                      coalesce_label("o_orderpriority").alias("prioridade"))


@register("q_top_recent", """
select o_custkey, o_orderkey, o_orderdate, o_totalprice, rank_in_group
from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank_in_group
      from orders)
where rank_in_group <= 3
""")
def q_top_recent(spark, d, k: int = 3):
    """topn_recent for every member at once: latest k orders per customer; each
    task sends its k best rows of a customer, so a hot customer stays small."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return topk_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(),
                                             F.col("o_orderkey").desc()], k).withColumn(
        "rank_in_group", F.col("rank_in_group").cast("bigint"))


@register("q_top_other", f"""
with f as (select year(l.l_shipdate) as ano, p.p_brand, l.l_extendedprice
           from lineitem l left join part p on l.l_partkey = p.p_partkey),
top as (select p_brand from f group by p_brand order by count(*) desc, p_brand asc nulls last limit 8)
select ano, case when top.p_brand is not null then f.p_brand else 'Outros' end as marca,
       count(*) as n_itens, {money_sum('l_extendedprice')} as total
from f left join top on f.p_brand = top.p_brand
group by 1, 2
""")
def q_top_other(spark, d):
    """topn_other_bucket (top 8 brands kept, the rest 'Outros', re-aggregated
    by year): the facts are reduced to (brand, year) once, both the top 8 and
    the result come from that frame; 8 rows are broadcast."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    f = join_left_dim(li, p, li.l_partkey == p.p_partkey).withColumn("ano", F.year("l_shipdate"))
    f = f.groupBy("p_brand", "ano").agg(count_rows().alias("n"),
                                        F.sum(to_money("l_extendedprice")).alias("valor"))
    g = topn_other_bucket(f, "p_brand", F.sum("n"), 8, out="marca")
    return g.groupBy("ano", "marca").agg(F.sum("n").alias("n_itens"),
                                         F.sum("valor").cast("double").alias("total"))


@register("q_unpivot", """
with c as (
  select l_returnflag,
    sum(cast(l_extendedprice as decimal(12,2))) as bruto,
    sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))) as desconto,
    sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * cast(l_tax as decimal(4,2))) as imposto,
    sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as liquido,
    sum(cast(0 as decimal(12,2))) as ajuste
  from lineitem group by 1)
select l_returnflag, componente, valor from (
  select l_returnflag, 'bruto' as componente, cast(bruto as double) as valor from c union all
  select l_returnflag, 'desconto', cast(desconto as double) from c union all
  select l_returnflag, 'imposto', cast(imposto as double) from c union all
  select l_returnflag, 'liquido', cast(liquido as double) from c union all
  select l_returnflag, 'ajuste', cast(ajuste as double) from c union all
  select l_returnflag, 'total_com_imposto', cast(liquido + imposto as double) from c)
where valor > 0
""")
def q_unpivot(spark, d):
    """agg_all_components (one pass over all components), gross_pay (fold of
    coalesced parts), agg_unpivot_components (wide -> long, > 0 only)."""
    li = table(spark, d, "lineitem")
    # narrow decimals keep every product exact (no scale trimming past 38 digits)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    parts = li.select("l_returnflag", price.alias("bruto"), (price * disc).alias("desconto"),
                      (price * (1 - disc) * tax).alias("imposto"),
                      (price * (1 - disc)).alias("liquido"),
                      F.lit(0).cast("decimal(12,2)").alias("ajuste"))
    parts = parts.withColumn("total_com_imposto", gross_pay("liquido", "imposto"))
    comps = ["bruto", "desconto", "imposto", "liquido", "ajuste", "total_com_imposto"]
    wide = parts.groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in comps])
    long = unpivot_components(wide, ["l_returnflag"], comps, "componente", "valor")
    return long.select("l_returnflag", "componente", F.col("valor").cast("double").alias("valor"))


@register("q_trend_join", f"""
with o as (select year(o_orderdate) as ano, month(o_orderdate) as mes,
                  {money_sum('o_totalprice')} as total_pedidos, count(*) as n_pedidos from orders group by 1, 2),
l as (select year(l_shipdate) as ano, month(l_shipdate) as mes,
             {money_sum('l_extendedprice')} as total_itens, count(*) as n_itens from lineitem group by 1, 2)
select o.ano, o.mes, total_pedidos, n_pedidos, total_itens, n_itens
from o left join l on o.ano = l.ano and o.mes = l.mes
""")
def q_trend_join(spark, d):
    """join_frames_two_key / payroll_trend: two monthly series, left join."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("ano"),
                                          F.month("o_orderdate").alias("mes")).agg(
        sum_money("o_totalprice").alias("total_pedidos"), count_rows().alias("n_pedidos"))
    li = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("ano"),
                                             F.month("l_shipdate").alias("mes")).agg(
        sum_money("l_extendedprice").alias("total_itens"), count_rows().alias("n_itens"))
    return o.join(li, ["ano", "mes"], "left")


GEO_EXCLUDED = ("NATION_0", "EX")


@register("q_geo", f"""
select r.r_name as regiao, n.n_name as nacao, {money_sum('l.l_extendedprice')} as total,
       count(*) as n_itens, count(distinct l.l_suppkey) as n_fornecedores
from lineitem l
join supplier s on l.l_suppkey = s.s_suppkey
join nation n on s.s_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
where n.n_name is not null and n.n_name not in ('NATION_0', 'EX')
  and l.l_returnflag in ('R', 'A') and r.r_name in ('AMERICA', 'ASIA', 'EUROPE')
  and year(l.l_shipdate) >= 1996 and year(l.l_shipdate) <= 2000
group by 1, 2
""")
def q_geo(spark, d, year_from: int | None = 1996, year_to: int | None = 2000,
          flags=("R", "A"), regions=("AMERICA", "ASIA", "EUROPE")):
    """geo_rollup by supplier nation; filter_in_list (valid names, sentinels
    excluded, null-safe), filter_range_optional (either bound may be None),
    filter_multi_select (chained isin)."""
    li = table(spark, d, "lineitem").where(year_between("l_shipdate", year_from, year_to))
    if flags:
        li = li.where(F.col("l_returnflag").isin(*flags))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").where(F.col("n_name").isNotNull()
                                        & ~F.col("n_name").isin(*GEO_EXCLUDED))
    r = table(spark, d, "region")
    if regions:
        r = r.where(F.col("r_name").isin(*regions))
    geo = (n.join(r, n.n_regionkey == r.r_regionkey)
            .select("n_nationkey", "n_name", "r_name"))
    sup = s.join(geo, s.s_nationkey == geo.n_nationkey)
    f = li.join(sup, li.l_suppkey == sup.s_suppkey)
    return f.groupBy(F.col("r_name").alias("regiao"), F.col("n_name").alias("nacao")).agg(
        sum_money("l_extendedprice").alias("total"), count_rows().alias("n_itens"),
        F.count_distinct("l_suppkey").cast("bigint").alias("n_fornecedores"))


@register("q_roster", f"""
with m as (select o_custkey, cast(min(o_orderdate) as date) as inicio,
                  cast(max(o_orderdate) as date) + interval 730 day as fim
           from orders group by 1),
c as (select c.c_custkey, c.c_mktsegment, m.inicio, cast(m.fim as date) as fim
      from customer c left join m on c.c_custkey = m.o_custkey)
select c_mktsegment as segmento, year(fim) as ano_fim,
  count(*) as n_membros,
  count(case when coalesce(fim >= date '{AS_OF}', true) then 1 end) as n_ativos,
  count(case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 end) as n_exercicio,
  count(case when year(inicio) in (1995, 1996) then 1 end) as n_inicio_95_96,
  {exact_ratio_sql(f"sum(datediff('day', inicio, date '{AS_OF}')) * 100", "count(inicio) * 36525", 4, 0, "duckdb")} as tempo_medio_anos
from c group by 1, 2
""")
def q_roster(spark, d, as_of: str = AS_OF):
    """rosters, active_by_end_date (end null or >= as_of, as_of a parameter),
    extract_year, filter_status_set, filter_year_prefix, agg_mean_age."""
    o = table(spark, d, "orders")
    m = o.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("inicio"),
                                   F.date_add(F.max("o_orderdate").cast("date"), 730).alias("fim"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    r = c.join(m, c.c_custkey == m.o_custkey, "left")
    asof = F.lit(as_of).cast("date")
    active = F.coalesce(F.col("fim") >= asof, F.lit(True))
    return r.groupBy(F.col("c_mktsegment").alias("segmento"), F.year("fim").alias("ano_fim")).agg(
        count_rows().alias("n_membros"),
        count_if(active).alias("n_ativos"),
        count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("n_exercicio"),
        count_if(F.year("inicio").isin(1995, 1996)).alias("n_inicio_95_96"),
        # mean of days / 365.25, rounded exactly: sum(days)*100 / (n * 36525)
        F.expr(exact_ratio_sql(f"sum(datediff(date'{as_of}', inicio)) * 100",
                               "count(inicio) * 36525", 4, 0)).alias("tempo_medio_anos"))


@register("q_profile", f"""
select o_custkey, year(o_orderdate) as ano, count(*) as n_pedidos,
       {money_sum('o_totalprice')} as total, max(o_orderdate) as ultimo_pedido
from orders group by 1, 2
""")
def q_profile(spark, d, entity_id: int | None = None):
    """entity_profile_reads for every entity at once, or filter_point for
    one (``entity_id``): orders per customer and year."""
    o = table(spark, d, "orders")
    if entity_id is not None:
        o = o.where(F.col("o_custkey") == F.lit(entity_id))
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("ano")).agg(
        count_rows().alias("n_pedidos"), sum_money("o_totalprice").alias("total"),
        F.max("o_orderdate").alias("ultimo_pedido"))


@register("q_committee", f"""
with cur as (select distinct o_custkey from orders
             where o_orderdate >= timestamp '{AS_OF}' - interval 365 day and o_orderdate < timestamp '{AS_OF}'),
m as (select c.c_nationkey, c.c_custkey, c.c_mktsegment from customer c join cur on c.c_custkey = cur.o_custkey),
per as (select n.n_nationkey, n.n_name,
               count(m.c_custkey) as membros_atuais,
               count(case when m.c_mktsegment = 'BUILDING' then 1 end) as titulares
        from nation n left join m on n.n_nationkey = m.c_nationkey group by 1, 2)
select per.*, (select {exact_ratio_sql("sum(membros_atuais)", "count(*)", 4, 0, "duckdb")} from per) as media_membros
from per
""")
def q_committee(spark, d, as_of: str = AS_OF):
    """committee_membership: current members per committee (zero-filled),
    role counts, and the mean members per committee on every row."""
    o = table(spark, d, "orders")
    asof = F.lit(as_of).cast("timestamp_ntz")
    cur = (o.where((F.col("o_orderdate") >= asof - F.expr("interval 365 days"))
                   & (F.col("o_orderdate") < asof))
            .select("o_custkey").distinct())
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    m = c.join(cur, c.c_custkey == cur.o_custkey, "left_semi")
    counts = m.groupBy("c_nationkey").agg(
        count_rows().alias("membros_atuais"),
        count_if(F.col("c_mktsegment") == "BUILDING").alias("titulares"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    per = join_counts_zero_fill(n, counts.withColumnRenamed("c_nationkey", "n_nationkey"),
                                "n_nationkey", ["membros_atuais", "titulares"])
    mean = per.agg(F.expr(exact_ratio_sql("sum(membros_atuais)", "count(*)", 4, 0)))
    # the one-row global aggregate is a scalar subquery: computed once and
    # used as a value on every row (no join, no nested loop)
    return per.withColumn("media_membros", mean.scalar())


@register("q_months", f"""
with w as (
  select o_orderkey, cast(o_orderdate as date) as inicio,
         cast(o_orderdate + interval 2 month as date) as fim from orders),
m as (
  select w.*, cast(unnest(generate_series(date_trunc('month', inicio), date_trunc('month', fim), interval 1 month)) as date) as mes
  from w),
j as (
  select greatest(mes, inicio) as ini, least(last_day(mes), fim, date '{AS_OF}') as fimj from m)
select strftime(ini, '%Y-%m') as periodo, count(*) as n_janelas,
       sum(datediff('day', ini, fimj) + 1) as dias
from j where fimj >= ini group by 1
""")
def q_months(spark, d, as_of: str = AS_OF):
    """month_windows (month ranges of each order's 2-month span, capped at
    the span end and at as_of), period_label, agg_monthly_count."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("inicio"),
        F.add_months(F.col("o_orderdate").cast("date"), 2).alias("fim"))
    w = o.select("inicio", F.explode(month_windows("inicio", "fim", as_of)).alias("w"))
    w = w.select(F.greatest("w.month_start", "inicio").alias("ini"),
                 F.col("w.month_end").alias("fimj")).where(F.col("fimj") >= F.col("ini"))
    return w.groupBy(period_label(F.year("ini"), F.month("ini")).alias("periodo")).agg(
        count_rows().alias("n_janelas"),
        F.sum(F.datediff("fimj", "ini") + 1).cast("bigint").alias("dias"))


@register("q_load_stats", """
with s as (select c_mktsegment, count(*) as n, count(*) - count(c_custkey) as nulos,
                  min(c_acctbal) as mn, max(c_acctbal) as mx, sum(cast(c_acctbal as decimal(18,2))) as soma,
                  count(c_acctbal) as nv
           from customer group by 1)
select sum(n) as n_linhas, round(100.0 * sum(nulos) / sum(n), 4) as pct_chave_nula,
       5 as n_colunas, 5 >= 2 and sum(n) > 0 as esquema_valido,
       min(mn) as saldo_min, max(mx) as saldo_max,
       """ + exact_ratio_sql("sum(cast(soma * 100 as hugeint))", "sum(nv)", 4, 2, "duckdb") + """ as saldo_medio,
       arg_max(c_mktsegment, (n, c_mktsegment)) as segmento_top,
       count(c_mktsegment) as n_segmentos
from s
""")
def q_load_stats(spark, d):
    """load_stats (rows, % null key, min/mean/max, top category, number of
    categories) in one two-level aggregation; schema_sniff_validate (>= 2
    columns and rows present).  The category list itself is q_distinct_values
    (rows, not one concatenated cell)."""
    c = table(spark, d, "customer")
    s = c.groupBy("c_mktsegment").agg(
        count_rows().alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("nulos"),
        F.min("c_acctbal").alias("mn"), F.max("c_acctbal").alias("mx"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("soma"),
        F.count("c_acctbal").alias("nv"))
    ncols = len(c.columns)
    return s.agg(
        F.sum("n").cast("bigint").alias("n_linhas"),
        F.round(F.lit(100.0) * F.sum("nulos") / F.sum("n"), 4).alias("pct_chave_nula"),
        F.lit(ncols).alias("n_colunas"),
        (F.lit(ncols >= 2) & (F.sum("n") > 0)).alias("esquema_valido"),
        F.min("mn").alias("saldo_min"), F.max("mx").alias("saldo_max"),
        F.expr(exact_ratio_sql("sum(cast(soma * 100 as decimal(38,0)))", "sum(nv)", 4, 2))
        .alias("saldo_medio"),
        F.max_by("c_mktsegment", F.struct("n", "c_mktsegment")).alias("segmento_top"),
        F.count("c_mktsegment").cast("bigint").alias("n_segmentos"))


@register("q_dq", """
select 'customer' as table_name, 'c_custkey' as column_name, 'not_null' as check_name, 'error' as severity, count(*) - count(c_custkey) as failures from customer
union all select 'customer', 'c_name', 'not_null', 'error', count(*) - count(c_name) from customer
union all select 'customer', 'c_mktsegment', 'accepted_values', 'error',
  count(distinct case when c_mktsegment not in ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') then c_mktsegment end) from customer
union all select 'customer', 'c_custkey', 'unique', 'error', (select count(*) from (select c_custkey from customer group by 1 having count(*) > 1))
union all select 'customer', 'c_name', 'unique', 'error', (select count(*) from (select c_name from customer group by 1 having count(*) > 1))
union all select 'orders', 'o_orderkey', 'not_null', 'error', count(*) - count(o_orderkey) from orders
union all select 'orders', 'o_custkey', 'not_null', 'error', count(*) - count(o_custkey) from orders
union all select 'orders', 'o_orderstatus', 'accepted_values', 'warn',
  count(distinct case when o_orderstatus not in ('F', 'O') then o_orderstatus end) from orders
union all select 'orders', 'o_orderkey', 'unique', 'error', (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1))
""")
def q_dq(spark, d):
    """dq_not_null, dq_unique, dq_accepted_values (with a warn severity)."""
    c = dq_report(table(spark, d, "customer"), "customer",
                  not_null=["c_custkey", "c_name"], unique=[["c_custkey"], ["c_name"]],
                  accepted_values={"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE",
                                                    "HOUSEHOLD", "MACHINERY"]})
    o = dq_report(table(spark, d, "orders"), "orders",
                  not_null=["o_orderkey", "o_custkey"], unique=[["o_orderkey"]],
                  accepted_values={"o_orderstatus": ["F", "O"]},
                  severity={"accepted_values:o_orderstatus": "warn"})
    return c.unionByName(o)


ADHOC_TEXT = """
select n.n_name as nacao, count(*) as n_fornecedores, {avg} as saldo_medio
from supplier s join nation n on s.s_nationkey = n.n_nationkey
where s.s_acctbal > {min_saldo}
group by n.n_name
"""


@register("q_adhoc", ADHOC_TEXT.format(min_saldo="0", avg=avg4("s.s_acctbal", 2)))
def q_adhoc(spark, d, min_saldo: float = 0.0):
    """adhoc_sql over registered views with a named parameter (bound, not
    spliced); list_tables is the catalog listing of the same views."""
    register_views(spark, d, ["supplier", "nation"])
    from civitas.operators.aggregates import avg_exact_sql
    text = ADHOC_TEXT.format(min_saldo=":min_saldo", avg=avg_exact_sql("s.s_acctbal", 2))
    return adhoc_sql(spark, text,
                     {"min_saldo": min_saldo})


@register("q_top_filter", f"""
with f as (select l.*, p.p_type from lineitem l join part p on l.l_partkey = p.p_partkey),
top as (select p_type from f group by 1
        order by sum(cast(l_extendedprice as decimal(18,2))) desc, p_type asc limit 3)
select year(l_shipdate) as ano, p_type, count(*) as n_itens, {money_sum('l_extendedprice')} as total
from f where p_type in (select p_type from top) group by 1, 2
""")
def q_top_filter(spark, d, k: int = 3):
    """topn_then_filter: the k largest categories (semi join with the k-row top
    frame) with totals by year, all from one reduction of the facts to
    (category, year)."""
    from civitas.operators.topk import topn_then_filter
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    f = li.join(p, li.l_partkey == p.p_partkey)
    f = f.groupBy(F.year("l_shipdate").alias("ano"), "p_type").agg(
        count_rows().alias("n_itens"), F.sum(to_money("l_extendedprice")).alias("valor"))
    kept = topn_then_filter(f, "p_type", F.sum("valor"), k)
    return kept.select("ano", "p_type", "n_itens", F.col("valor").cast("double").alias("total"))


@register("q_distinct_values", """
select distinct c_mktsegment as valor, 'c_mktsegment' as coluna from customer where c_mktsegment is not null
union all
select distinct cast(year(o_orderdate) as varchar), 'ano' from orders where o_orderdate is not null
""")
def q_distinct_values(spark, d):
    """distinct_values: the sorted distinct values offered as filters
    (segments; order years, latest first) as rows — a distributed distinct
    followed by a sort, never a list gathered into one cell."""
    seg = (table(spark, d, "customer").where(F.col("c_mktsegment").isNotNull())
           .select(F.col("c_mktsegment").alias("valor"), F.lit("c_mktsegment").alias("coluna"))
           .distinct())
    anos = (table(spark, d, "orders").where(F.col("o_orderdate").isNotNull())
            .select(F.year("o_orderdate").cast("string").alias("valor"), F.lit("ano").alias("coluna"))
            .distinct())
    return seg.unionByName(anos).orderBy("coluna", F.col("valor").desc())


_LEVEL_SQL = """
  cast(sum(cast(c_acctbal as decimal(18,2))) as double) as total, count(*) as n_clientes,
  cast(max(c_acctbal) as double) as maior"""
_LEVEL_ROWS = """(select case when n_nationkey > 20 then null else n_name end as pais, r_name as regiao,
  nullif(c_mktsegment, 'MACHINERY') as segmento, c_acctbal
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) as x"""


@register("q_levels", f"""
select 'segmento' as nivel, regiao, pais, segmento, {_LEVEL_SQL} from {_LEVEL_ROWS} group by regiao, pais, segmento
union all
select 'pais', regiao, pais, null, {_LEVEL_SQL} from {_LEVEL_ROWS} group by regiao, pais
union all
select 'regiao', regiao, null, null, {_LEVEL_SQL} from {_LEVEL_ROWS} group by regiao
union all
select 'por segmento', null, null, segmento, {_LEVEL_SQL} from {_LEVEL_ROWS} group by segmento
union all
select 'total', null, null, null, {_LEVEL_SQL} from {_LEVEL_ROWS}
""")
def q_levels(spark, d):
    """payroll_breakdowns / geo_rollup with totals by level in one aggregate
    (grouping sets): country, region and segment totals; an unknown country or
    segment (null) is a group of its own and no total."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.when(F.col("n_nationkey") <= 20, F.col("n_name")).alias("pais"), F.col("r_name").alias("regiao"),
        F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("segmento"), "c_acctbal")
    return totals_by_level(
        rows, {"segmento": ["regiao", "pais", "segmento"], "pais": ["regiao", "pais"], "regiao": ["regiao"],
               "por segmento": ["segmento"], "total": []},
        [sum_money("c_acctbal").alias("total"), count_rows().alias("n_clientes"),
         F.max("c_acctbal").alias("maior")])


@register("q_list_tables", "\nunion all\n".join(
    f"select '{t}' as name, count(*) as n_linhas from {t}" for t in TABLES))
def q_list_tables(spark, d):
    """list_tables: what the catalog offers for ad-hoc queries, with the rows of
    each table."""
    register_views(spark, d)
    out = None
    for r in list_tables(spark).where(F.col("is_temporary") & F.col("name").isin(list(TABLES))).collect():
        n = spark.table(r.name).agg(count_rows().alias("n_linhas")).select(F.lit(r.name).alias("name"), "n_linhas")
        out = n if out is None else out.unionByName(n)
    return out
