"""Keys, dedup and entity linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions import normalize_name_sql, upper_trim
from civitas.functions.dates import trunc_hour_ntz
from civitas.operators.aggregates import avg_round, count_rows, exact_ratio_sql, sum_money
from civitas.operators.analytics import kpis_latest_period
from civitas.operators.dedup import dedup_on_keys, first_seen_unique, latest_per_key
from civitas.operators.fuzzy_link import link_names
from civitas.operators.link import (join_crossref, join_left_dim,
                                    join_on_derived_key, join_priority_fallback,
                                    unique_registry)
from civitas.operators.quality import dq_key_links
from civitas.plans._sql import avg4, money_sum, norm_sql
from civitas.plans.registry import register
from civitas.sources.tables import table


@register("q_augment_master", """
select coalesce(s.s_suppkey, c.c_custkey) as chave,
       coalesce(s.s_name, c.c_name) as nome,
       c.c_mktsegment as segmento,
       c.c_nationkey as nacao_secundaria,
       c.c_acctbal as saldo_secundario,
       case when s.s_suppkey is not null and c.c_custkey is not null then 'primario+secundario'
            when s.s_suppkey is not null then 'primario' else 'secundario' end as fonte
from supplier s full outer join customer c on s.s_suppkey = c.c_custkey
""")
def q_augment_master(spark, d):
    """augment_master: primary list kept, the secondary list fills three
    columns where the key matches and is appended where it does not; every
    row labelled with its provenance."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment",
                                           "c_nationkey", "c_acctbal")
    j = s.join(c, s.s_suppkey == c.c_custkey, "full_outer")
    both = F.col("s_suppkey").isNotNull() & F.col("c_custkey").isNotNull()
    return j.select(F.coalesce("s_suppkey", "c_custkey").alias("chave"),
                    F.coalesce("s_name", "c_name").alias("nome"),
                    F.col("c_mktsegment").alias("segmento"),
                    F.col("c_nationkey").alias("nacao_secundaria"),
                    F.col("c_acctbal").alias("saldo_secundario"),
                    F.when(both, "primario+secundario")
                     .when(F.col("s_suppkey").isNotNull(), "primario")
                     .otherwise("secundario").alias("fonte"))


@register("q_latest_per_key", """
select o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus
from (select *, row_number() over (partition by o_custkey
                                   order by o_orderdate desc nulls last, o_orderkey desc) as rn
      from orders)
where rn = 1
""")
def q_latest_per_key(spark, d):
    """win_latest_per_key / win_dedup_doc: latest order per customer (date
    desc nulls last, order key as the second order column)."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate",
                                         "o_totalprice", "o_orderstatus")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate"], tie_break=["o_orderkey"])


@register("q_earliest_per_key", """
select l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice
from (select *, row_number() over (partition by l_partkey
                                   order by l_shipdate asc nulls last, l_orderkey, l_linenumber) as rn
      from lineitem)
where rn = 1
""")
def q_earliest_per_key(spark, d):
    """win_dedup_earliest / first_seen_unique: the first shipment of every
    part (date, then order and line as the position; nulls last)."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber",
                                            "l_shipdate", "l_extendedprice")
    return first_seen_unique(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])


@register("q_dedup_keys", """
with u as (
  select l_orderkey, l_linenumber, l_extendedprice, l_tax, 1 as snapshot from lineitem
  union all by name
  select l_orderkey, l_linenumber,
         cast(round(cast(l_extendedprice as decimal(18,2)) * 1.01, 2) as double) as l_extendedprice, 2 as snapshot
  from lineitem where year(l_shipdate) >= 2000)
select l_orderkey, l_linenumber, l_extendedprice, l_tax, snapshot
from (select *, row_number() over (partition by l_orderkey, l_linenumber
        order by snapshot desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc nulls last,
                 l_tax desc nulls last) rn from u)
where rn = 1
""")
def q_dedup_keys(spark, d):
    """union_diagonal (the later snapshot lacks a column), win_dedup_snapshots
    / dedup_on_keys: one row per line key, newest snapshot wins; the key is
    not unique in the data, so the whole row breaks ties (same winner on any
    partitioning)."""
    li = table(spark, d, "lineitem")
    snap1 = li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax",
                      F.lit(1).alias("snapshot"))
    snap2 = (li.where(F.year("l_shipdate") >= 2000)
               .select("l_orderkey", "l_linenumber",
                       F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                               * F.lit(1.01).cast("decimal(3,2)"), 2)
                       .cast("double").alias("l_extendedprice"),
                       F.lit(2).alias("snapshot")))
    u = snap1.unionByName(snap2, allowMissingColumns=True)
    return dedup_on_keys(u, ["l_orderkey", "l_linenumber"], prefer=["snapshot"])


def _registry_sql(where: str, id_alias: str, extra: str = "") -> str:
    return f"""(select nome_key as k_{id_alias}, p_partkey as {id_alias}{extra}
       from (select *, row_number() over (partition by nome_key order by p_partkey) rn
             from (select {norm_sql('p_name')} as nome_key, p_partkey, p_brand from part where {where})
             where nome_key <> '')
       where rn = 1)"""


@register("q_priority_link", f"""
with e as (select p_partkey, {norm_sql('p_name')} as nome_key from part),
a as {_registry_sql("p_type = 'PROMO'", 'id_a', ', p_brand as brand_a')},
b as {_registry_sql("p_type in ('STANDARD', 'ECONOMY')", 'id_b')}
select e.p_partkey, e.nome_key,
       coalesce(a.id_a, b.id_b) as linked_id,
       case when a.id_a is not null then 'A' when b.id_b is not null then 'B' end as link_source
from e
left join a on e.nome_key = a.k_id_a and starts_with(a.brand_a, 'Brand#1')
left join b on e.nome_key = b.k_id_b and a.id_a is null
""")
def q_priority_link(spark, d):
    """join_priority_fallback / win_priority_pick / join_conditional: link
    every part by folded name to registry A (with an extra ON predicate),
    registry B only where A missed; registries made unique first."""
    part = table(spark, d, "part")
    key = normalize_name_sql("p_name")
    ent = part.select("p_partkey", key.alias("nome_key"))
    reg_a = part.where(F.col("p_type") == "PROMO").select(
        key.alias("nome_key"), F.col("p_partkey").alias("id_a"), F.col("p_brand").alias("brand_a"))
    reg_b = part.where(F.col("p_type").isin("STANDARD", "ECONOMY")).select(
        key.alias("nome_key"), F.col("p_partkey").alias("id_b"))
    out = join_priority_fallback(ent, "nome_key", reg_a, "id_a", reg_b, "id_b",
                                 a_condition=lambda a: a["brand_a"].startswith("Brand#1"))
    return out.select("p_partkey", "nome_key", "linked_id", "link_source")


_DECLARED_SQL = """
case c.c_custkey % 4
  when 0 then '  ' || lower(n.n_name) || ' '
  when 1 then lower(replace(n.n_name, 'A', 'Á'))
  when 2 then replace(n.n_name, '_', '-')
  else '' end"""


@register("q_name_link", f"""
with c as (select c.c_custkey, c.c_mktsegment, {_DECLARED_SQL} as declarado
           from customer c left join nation n on c.c_nationkey = n.n_nationkey),
nu as (select upper(trim(n_name)) as k, min(n_nationkey) as nk from nation
       where upper(trim(n_name)) <> '' group by 1),
nn as (select {norm_sql('n_name')} as k, min(n_nationkey) as nk from nation
       where {norm_sql('n_name')} <> '' group by 1),
l as (select c.c_mktsegment, nu.nk as nk_upper, nn.nk as nk_norm
      from c left join nu on nullif(upper(trim(c.declarado)), '') = nu.k
             left join nn on nullif({norm_sql('c.declarado')}, '') = nn.k)
select c_mktsegment,
       count(*) as n, count(nk_upper) as matched_upper,
       {exact_ratio_sql("count(nk_upper)", "count(*)", 4, 0, "duckdb")} as match_rate_upper,
       count(nk_norm) as matched_norm,
       {exact_ratio_sql("count(nk_norm)", "count(*)", 4, 0, "duckdb")} as match_rate_norm
from l group by 1
""")
def q_name_link(spark, d):
    """join_name_upper and join_name_normalized (blank keys never match, the
    registry is unique on the key), dq_key_links: match rate per segment."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey") % 4
    declared = (F.when(k == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
                 .when(k == 1, F.lower(F.replace(F.col("n_name"), F.lit("A"), F.lit("Á"))))
                 .when(k == 2, F.replace(F.col("n_name"), F.lit("_"), F.lit("-")))
                 .otherwise(F.lit("")))
    cust = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .select("c_custkey", "c_mktsegment", declared.alias("declarado")))
    reg_u = unique_registry(n.select(upper_trim("n_name").alias("ku"),
                                     F.col("n_nationkey").alias("nk_upper")), "ku", "nk_upper")
    reg_n = unique_registry(n.select(normalize_name_sql("n_name").alias("kn"),
                                     F.col("n_nationkey").alias("nk_norm")), "kn", "nk_norm")
    l1 = join_on_derived_key(cust, reg_u, upper_trim("declarado"),
                             F.col("ku"), key="__ku").drop("__ku", "ku")
    l2 = join_on_derived_key(l1, reg_n, normalize_name_sql("declarado"),
                             F.col("kn"), key="__kn").drop("__kn", "kn")
    up = dq_key_links(l2, "nk_upper", ["c_mktsegment"]).withColumnsRenamed(
        {"matched": "matched_upper", "match_rate": "match_rate_upper"})
    nm = dq_key_links(l2, "nk_norm", ["c_mktsegment"]).withColumnsRenamed(
        {"matched": "matched_norm", "match_rate": "match_rate_norm"}).drop("n")
    return up.join(nm, "c_mktsegment")


@register("q_denorm_fact", """
with ny as (select c.c_nationkey as ny_nation, year(o.o_orderdate) as ny_year, count(*) as pedidos_nacao_ano
            from orders o join customer c on o.o_custkey = c.c_custkey group by 1, 2)
select l.l_orderkey, l.l_linenumber, o.o_orderdate, s.s_name, n.n_name, ny.pedidos_nacao_ano
from lineitem l
left join orders o on l.l_orderkey = o.o_orderkey
left join supplier s on cast(l.l_suppkey as varchar) = cast(s.s_suppkey as varchar)
left join nation n on s.s_nationkey = n.n_nationkey
left join ny on s.s_nationkey = ny.ny_nation and year(l.l_shipdate) = ny.ny_year
""")
def q_denorm_fact(spark, d):
    """join_left_dim (size-checked broadcast of small dims, shuffle join of
    the two facts), join_string_int_key (text id vs integer id, cast on both
    sides), join_composite_key ((nation, year) dimension)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey",
                                            "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_key"),
                                           "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    ny = (o.join(c, o.o_custkey == c.c_custkey)
           .groupBy(F.col("c_nationkey").alias("ny_nation"),
                    F.year("o_orderdate").alias("ny_year"))
           .agg(count_rows().alias("pedidos_nacao_ano")))
    f = li.join(o.drop("o_custkey"), li.l_orderkey == o.o_orderkey, "left")
    f = join_left_dim(f.withColumn("l_key", F.col("l_suppkey").cast("string")), s,
                      F.col("l_key") == F.col("s_key"))
    f = join_left_dim(f, n, F.col("s_nationkey") == F.col("n_nationkey"))
    f = join_left_dim(f, ny, (F.col("s_nationkey") == F.col("ny_nation"))
                      & (F.year("l_shipdate") == F.col("ny_year")))
    return f.select("l_orderkey", "l_linenumber", "o_orderdate", "s_name", "n_name",
                    "pedidos_nacao_ano")


SESSION_WATERMARK = "2024-01-08 00:00:00"


@register("q_votes_fact", f"""
with s as (select date_trunc('hour', ts) as sessao, count(*) as n_votos_sessao, min(ts) as abertura
           from events group by 1)
select e.event_id, s.sessao, s.n_votos_sessao, s.abertura, e.event_type, c.c_name
from events e
join s on date_trunc('hour', e.ts) = s.sessao
left join customer c on e.user_id = c.c_custkey
where s.sessao >= timestamp '{SESSION_WATERMARK}'
""")
def q_votes_fact(spark, d):
    """join_inner_then_left: votes inner join sessions (the watermark filter
    on sessions prunes the votes too), then left join the member dimension."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    votes = e.withColumn("sessao", trunc_hour_ntz("ts"))
    sessions = (votes.groupBy("sessao")
                     .agg(count_rows().alias("n_votos_sessao"), F.min("ts").alias("abertura"))
                     .where(F.col("sessao") >= F.lit(SESSION_WATERMARK).cast("timestamp_ntz")))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    f = votes.join(sessions, "sessao", "inner")
    f = join_left_dim(f, c, f.user_id == c.c_custkey)
    return f.select("event_id", "sessao", "n_votos_sessao", "abertura", "event_type", "c_name")


@register("q_crossref", f"""
with l as (select l_suppkey as entity_id, {money_sum('l_extendedprice')} as total_fornecedor,
                  count(*) as n_itens from lineitem group by 1),
o as (select o_custkey as entity_id, {money_sum('o_totalprice')} as total_cliente,
             count(*) as n_pedidos from orders group by 1)
select l.entity_id, total_fornecedor, n_itens, total_cliente, n_pedidos
from l join o on l.entity_id = o.entity_id
""")
def q_crossref(spark, d):
    """join_crossref / donor_cross / follow_money: ids present in both facts
    (as payee and as buyer), each side pre-aggregated so totals are exact."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    return join_crossref(li, "l_suppkey", [sum_money("l_extendedprice").alias("total_fornecedor"),
                                           count_rows().alias("n_itens")],
                         o, "o_custkey", [sum_money("o_totalprice").alias("total_cliente"),
                                          count_rows().alias("n_pedidos")])


@register("q_semi_latest", f"""
with o as (select *, year(o_orderdate) as ano, month(o_orderdate) as mes from orders)
select ano, mes, count(*) as n_pedidos, {money_sum('o_totalprice')} as total,
       {avg4('o_totalprice')} as ticket_medio,
       max(o_totalprice) as maior, count(distinct o_custkey) as n_clientes
from o where (ano, mes) in (select (ano, mes) from o order by ano desc, mes desc limit 1)
group by ano, mes
""")
def q_semi_latest(spark, d):
    """join_tuple_in / payroll_kpis: KPIs of the latest (year, month)."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("ano"),
                                         F.month("o_orderdate").alias("mes"),
                                         "o_totalprice", "o_custkey")
    return kpis_latest_period(o, ["ano", "mes"], [
        count_rows().alias("n_pedidos"), sum_money("o_totalprice").alias("total"),
        avg_round("o_totalprice").alias("ticket_medio"),
        F.max("o_totalprice").alias("maior"),
        F.count_distinct("o_custkey").cast("bigint").alias("n_clientes")])


@register("q_sector_top", f"""
with pay as (select l_suppkey, {money_sum('l_extendedprice')} as total, count(*) as n_itens
             from lineitem group by 1),
j as (select s.s_nationkey as setor, s.s_suppkey, s.s_name, pay.total, pay.n_itens
      from pay join supplier s on pay.l_suppkey = s.s_suppkey),
r as (select *, row_number() over (partition by setor order by total desc, s_suppkey asc) as posicao from j)
select setor, s_suppkey, s_name, total, n_itens, posicao from r where posicao <= 3
""")
def q_sector_top(spark, d, k: int = 3):
    """sector_top: the k largest payees of every sector (nation), over the
    full data; join_inner_link: the per-payee aggregate is inner-joined to
    the registry through its link id (only linked payees are ranked)."""
    from civitas.operators.topk import topk_per_group
    pay = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        sum_money("l_extendedprice").alias("total"), count_rows().alias("n_itens"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("setor"), "s_suppkey", "s_name")
    j = pay.join(s, pay.l_suppkey == s.s_suppkey, "inner").drop("l_suppkey")
    top = topk_per_group(j, ["setor"], [F.col("total").desc(), F.col("s_suppkey").asc()], k)
    return top.select("setor", "s_suppkey", "s_name", "total", "n_itens",
                      F.col("rank_in_group").cast("bigint").alias("posicao"))


# ids and seeds as letters: names that are far from each other
_LETTERS = "translate(md5(cast({c} as {t})), '0123456789abcdef', 'ABCDEILMNOPRSTUV')"


@register("q_name_fuzzy", f"""
with reg as (select c_custkey as rid, substr({_LETTERS.format(c='c_custkey', t='varchar')}, 1, 14) as nome
             from customer),
decl as (select c_custkey, c_mktsegment, case c_custkey % 6
            when 0 then lower(nome)
            when 1 then substr(nome, 1, 4) || substr(nome, 6)
            when 2 then substr(nome, 1, 8) || 'X' || substr(nome, 10)
            when 3 then 'Z' || substr(nome, 1, 6) || 'Y' || substr(nome, 7)
            when 4 then substr({_LETTERS.format(c='c_custkey + 1000000', t='varchar')}, 3, 14)
            else null end as declarado
         from customer join reg on c_custkey = rid),
n as (select distinct upper(declarado) as l from decl where declarado is not null),
r as (select nome as r, min(rid) as rid from reg group by 1),
ol as (select l from n where l not in (select r from r)),
orr as (select r from r where r not in (select l from n)),
pr as (select l, r, levenshtein(l, r) as dist from ol, orr where levenshtein(l, r) <= 2),
bl as (select l, arg_min(r, dist) as r, min(dist) as dist from pr
       where (l, dist) in (select l, min(dist) from pr group by l) group by l having count(*) = 1),
br as (select r, arg_min(l, dist) as l from pr
       where (r, dist) in (select r, min(dist) from pr group by r) group by r having count(*) = 1),
k as (select l, rid, 'exact' as m, 0 as dist from n join r on l = r
      union all select bl.l, r.rid, 'fuzzy', bl.dist from bl join br on bl.l = br.l and bl.r = br.r
      join r on r.r = bl.r)
select c_custkey, c_mktsegment, declarado, k.rid as linked_id, k.m as link_method,
       cast(k.dist as integer) as link_distance
from decl left join k on upper(declarado) = k.l
""")
def q_name_fuzzy(spark, d):
    """join_name_normalized over misspelt names: a letter left out, replaced or
    added, names of strangers and none; exact links first, then edit distance 2
    with mutual best matches.  Every left row once (no fan-out)."""
    letters = _LETTERS.format(c="{c}", t="string")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.substr(
        F.expr(letters.format(c="c_custkey")), F.lit(1), F.lit(14)).alias("nome"))
    part = lambda a, n=None: F.substr("nome", F.lit(a), F.lit(n or 99))
    k = F.col("c_custkey") % 6
    declared = (F.when(k == 0, F.lower("nome"))
                .when(k == 1, F.concat(part(1, 4), part(6)))
                .when(k == 2, F.concat(part(1, 8), F.lit("X"), part(10)))
                .when(k == 3, F.concat(F.lit("Z"), part(1, 6), F.lit("Y"), part(7)))
                .when(k == 4, F.substr(F.expr(letters.format(c="c_custkey + 1000000")), F.lit(3), F.lit(14))))
    left = c.select("c_custkey", "c_mktsegment", declared.alias("declarado"))
    return link_names(left, "declarado", c, "nome", "c_custkey")
