"""Serving functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions.dates import format_ntz
from civitas.operators.serving import (Fact, breakdowns, donors_by_candidate, geo_totals,
                                       name_fallback_lookup, on_watch_list, payroll_kpis,
                                       profile_lists, totals_by_year)
from civitas.operators.upsert import (current_watermark, full_refresh, read_target, upsert_by_key,
                                      watermark_filter)
from civitas.plans.incremental import _orders_batches
from civitas.plans.marts import q_top_rows
from civitas.plans.registry import register
from civitas.session import work_dir
from civitas.sources.tables import table


def _facts(spark, d) -> dict[str, Fact]:
    return {"pedidos": Fact(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice"),
            "itens": Fact(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice"),
            "eventos": Fact(table(spark, d, "events"), "user_id", "ts", "value")}


_FACTS_SQL = """
f as (
  select 'pedidos' as fato, o_custkey as entidade, o_orderdate as data, cast(o_totalprice as decimal(18,2)) as valor from orders
  union all select 'itens', l_suppkey, l_shipdate, cast(l_extendedprice as decimal(18,2)) from lineitem
  union all select 'eventos', user_id, ts, cast(value as decimal(18,2)) from events)"""


@register("q_payroll_kpis", f"""
with {_FACTS_SQL},
m as (select fato, max(year(data) * 100 + month(data)) as p from f group by 1)
select f.fato, cast(year(data) as integer) as ano, cast(month(data) as integer) as mes,
       count(*) as n_registros, count(distinct entidade) as n_entidades,
       cast(sum(valor) as double) as total,
       round(cast(sum(valor) as double) / count(valor), 2) as media
from f join m on f.fato = m.fato and year(data) * 100 + month(data) = m.p
group by 1, 2, 3
""")
def q_payroll_kpis(spark, d):
    """payroll_kpis over three facts, each at its own latest month."""
    return payroll_kpis(_facts(spark, d))


@register("q_totals_members", """
select cast(year(o_orderdate) as integer) as ano,
       cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total,
       count(*) as n_registros, count(distinct o_custkey) as n_membros
from orders group by 1
""")
def q_totals_members(spark, d):
    """totals_by_year_entity with the distinct members of each year."""
    return totals_by_year(_facts(spark, d)["pedidos"])


@register("q_breakdowns", """
with t as (select l_linestatus, l_returnflag, strftime(l_shipdate, '%Y-%m') as mes,
                  cast(l_extendedprice as decimal(18,2)) as v from lineitem)
select 'unidade' as dimensao, l_linestatus as valor_dim, count(*) as n_registros, cast(sum(v) as double) as total from t group by 2
union all
select 'vinculo', l_returnflag, count(*), cast(sum(v) as double) from t group by 2
union all
select 'mes', mes, count(*), cast(sum(v) as double) from t group by 2
""")
def q_breakdowns(spark, d):
    """payroll_breakdowns by unit, bond and month from one reduction."""
    li = table(spark, d, "lineitem")
    return breakdowns(li, {"unidade": "l_linestatus", "vinculo": "l_returnflag",
                           "mes": format_ntz("l_shipdate", "yyyy-MM")}, "l_extendedprice") \
        .withColumn("n_registros", F.col("n_registros").cast("bigint"))


@register("q_profile_lists", f"""
with {_FACTS_SQL}
select fato as lista, entidade, count(*) as n_registros, cast(sum(valor) as double) as total,
       cast(max(data) as date) as ultima_data
from f where entidade is not null group by 1, 2
""")
def q_profile_lists(spark, d, entity_id: int | None = None):
    """entity_profile_reads: every list, for all entities or one (filter_point)."""
    return profile_lists(_facts(spark, d), entity_id)


@register("q_profile_one", f"""
with {_FACTS_SQL}
select fato as lista, entidade, count(*) as n_registros, cast(sum(valor) as double) as total,
       cast(max(data) as date) as ultima_data
from f where entidade = 7 group by 1, 2
""")
def q_profile_one(spark, d):
    """filter_point: the profile lists of one id."""
    return q_profile_lists(spark, d, 7)


@register("q_geo_author", """
select n.n_name as lugar, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total,
       count(*) as n_registros, count(distinct o_custkey) as n_autores
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
where n.n_name is not null and n.n_name not in ('NATION_0')
group by 1
""")
def q_geo_author(spark, d, year_from: int | None = None, year_to: int | None = None):
    """geo_rollup by the author's home; both bounds None."""
    c = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = geo_totals(_facts(spark, d)["pedidos"], c, "c_custkey", "n_name", year_from, year_to,
                     exclude=["NATION_0"])
    return out.withColumn("n_registros", F.col("n_registros").cast("bigint"))


@register("q_geo_author_range", """
select n.n_name as lugar, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total,
       count(*) as n_registros, count(distinct o_custkey) as n_autores
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
where n.n_name is not null and n.n_name not in ('NATION_0') and year(o_orderdate) <= 1997
group by 1
""")
def q_geo_author_range(spark, d):
    """filter_range_optional: only the upper bound given."""
    return q_geo_author(spark, d, None, 1997)


@register("q_name_fallback", """
with f as (select s_suppkey, s_name, cast(l_extendedprice as decimal(18,2)) as v
           from lineitem join supplier on l_suppkey = s_suppkey),
a as (select 'achado' as consulta, *, 'id' as origem from f where s_suppkey = 3
      union all
      select 'perdido', *, 'nome' from f
      where upper(trim(s_name)) like '%SUPPLIER#000000002%'
        and not exists (select 1 from f where s_suppkey = -1))
select consulta, s_suppkey, s_name, origem, count(*) as n_itens, cast(sum(v) as double) as total
from a group by 1, 2, 3, 4
""")
def q_name_fallback(spark, d):
    """name_fallback_lookup: an id that is there (its name is not used) and one
    that is not (found by the first word of the name)."""
    f = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice").join(
        table(spark, d, "supplier").select("s_suppkey", "s_name"),
        F.col("l_suppkey") == F.col("s_suppkey"))
    found = name_fallback_lookup(f, "s_suppkey", "s_name", 3, "Supplier#000000002 x") \
        .withColumn("consulta", F.lit("achado"))
    lost = name_fallback_lookup(f, "s_suppkey", "s_name", -1, " supplier#000000002 x") \
        .withColumn("consulta", F.lit("perdido"))
    return found.unionByName(lost).groupBy("consulta", "s_suppkey", "s_name", "origem").agg(
        F.count(F.lit(1)).alias("n_itens"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@register("q_donor_candidate", """
select s.s_suppkey as membro, l.l_suppkey as candidato, cast(year(l_shipdate) as integer) as ano,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total, count(*) as n_doacoes
from lineitem l join supplier s on s.s_suppkey = l.l_suppkey
where s.s_acctbal > 0 group by 1, 2, 3
""")
def q_donor_candidate(spark, d):
    """donor_cross by candidate: only candidates linked to a member."""
    s = table(spark, d, "supplier").withColumn(
        "ligado", F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")))
    return donors_by_candidate(table(spark, d, "lineitem"), "l_suppkey", F.year("l_shipdate"),
                               "l_extendedprice", s, "s_suppkey", "ligado")


@register("q_watch_list", """
select l_suppkey as entidade, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total,
       count(*) as n_registros
from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0) group by 1
""")
def q_watch_list(spark, d):
    """donor_cross / follow_money against a watch-list of payees."""
    watch = table(spark, d, "supplier").where("s_acctbal < 0")
    return on_watch_list(_facts(spark, d)["itens"], watch.unionByName(watch), "s_suppkey")


@register("q_bottom_rows", """
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
       coalesce(o.o_orderpriority, 'N/D') as prioridade
from lineitem l left join orders o on l.l_orderkey = o.o_orderkey
where year(l.l_shipdate) between 1996 and 2000 and l.l_returnflag <> 'N'
order by l.l_extendedprice asc, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
limit 100
""")
def q_bottom_rows(spark, d):
    """rank_asc_or_desc: the other direction of q_top_rows."""
    return q_top_rows(spark, d, descending=False)


@register("q_upsert_lookback", """
with o as (select *, year(o_orderdate) * 100 + month(o_orderdate) as periodo from orders)
select o_orderkey, periodo,
       case when periodo > (select max(periodo) from o where o_orderdate < timestamp '1999-01-01') - 3
            then cast(round(cast(o_totalprice as decimal(18,2)) * 1.1, 2) as double)
            else o_totalprice end as o_totalprice
from o
""")
def q_upsert_lookback(spark, d):
    """watermark_filter with a lookback: a strict watermark that re-reads the
    three periods before it."""
    target = f"{work_dir(spark, 'upsert-lookback')}/fct_orders"
    b1, b2 = _orders_batches(spark, d)
    full_refresh(b1, target, ["o_orderkey"], ["ano"], ["o_orderkey"])
    wm = current_watermark(spark, target, "periodo")
    upsert_by_key(spark, watermark_filter(b2, "periodo", wm, strict=True, lookback=3), target,
                  ["o_orderkey"], ["ano"], ["o_orderkey"])
    return read_target(spark, target).select("o_orderkey", "periodo", "o_totalprice")
