"""Items the reference only designs: affiliation at event date
(SCD2 point-in-time lookup) and voting along the party line."""

from __future__ import annotations

from pyspark.sql import functions as F

from civitas.functions.dates import trunc_hour_ntz
from civitas.operators.aggregates import count_rows, exact_ratio_sql
from civitas.operators.asof import asof_scan
from civitas.operators.link import join_left_dim
from civitas.plans.registry import register
from civitas.sources.tables import table


@register("q_scd2", """
with lo as (select row_number() over () as rid, l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_custkey
            from lineitem l join orders o on l.l_orderkey = o.o_orderkey),
a as (select lo.rid, lo.l_orderkey, lo.l_linenumber, lo.l_shipdate, lo.o_custkey,
             arg_max(p.o_orderpriority, (p.o_orderdate, p.o_orderkey)) as afiliacao,
             arg_max(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) as periodo_id
      from lo left join orders p on p.o_custkey = lo.o_custkey and p.o_orderdate <= lo.l_shipdate
      group by all)
select l_orderkey, l_linenumber, l_shipdate, o_custkey, afiliacao, periodo_id from a
""")
def q_scd2(spark, d):
    """scd2_affiliation: each order opens a customer's affiliation (its
    priority) until the next order; every shipped line gets the affiliation
    in force at its ship date (prefix scan over ranges of customer and time)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders")
    events = li.join(o.select("o_orderkey", "o_custkey").hint("merge"), li.l_orderkey == o.o_orderkey) \
        .select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    periods = o.select("o_custkey", "o_orderdate", "o_orderpriority",
                       F.col("o_orderkey").alias("periodo_id"))
    out = asof_scan(events, periods, "o_custkey", "l_shipdate", "o_orderdate",
                    ["o_orderpriority", "periodo_id"], tie_break=["periodo_id"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey",
                      F.col("o_orderpriority").alias("afiliacao"), "periodo_id")


@register("q_scd2_overlap", """
with p as (select o_custkey, o_orderdate, o_orderpriority, o_orderkey,
                  case when o_orderpriority <> '5-LOW'
                       then o_orderdate + to_days(cast(left(o_orderpriority, 1) as integer) * 100) end as fim
           from orders),
lo as (select row_number() over () as rid, l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderstatus,
              o.o_custkey
       from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
select lo.l_orderkey, lo.l_linenumber, lo.o_custkey,
       arg_max(p.o_orderpriority, (p.o_orderdate, p.o_orderkey)) as afiliacao,
       arg_max(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) as periodo_id
from lo left join p on p.o_custkey = lo.o_custkey and p.o_orderdate <= lo.l_shipdate
                   and (p.fim is null or lo.l_shipdate < p.fim)
group by lo.rid, lo.l_orderkey, lo.l_linenumber, lo.o_custkey
""")
def q_scd2_overlap(spark, d):
    """scd2_affiliation with overlapping periods: an affiliation lasts 100 days
    per priority step (the lowest for good); when the newest has ended, an older
    one that is still open holds again."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders")
    events = li.join(o.select("o_orderkey", "o_custkey").hint("merge"), li.l_orderkey == o.o_orderkey) \
        .select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    days = F.left("o_orderpriority", F.lit(1)).cast("int") * 100
    periods = o.select("o_custkey", "o_orderdate", F.col("o_orderpriority").alias("afiliacao"),
                       F.col("o_orderkey").alias("periodo_id"),
                       F.when(F.col("o_orderpriority") != "5-LOW",
                              F.col("o_orderdate") + F.make_dt_interval(days)).alias("fim"))
    out = asof_scan(events, periods, "o_custkey", "l_shipdate", "o_orderdate",
                    ["afiliacao", "periodo_id"], ["periodo_id"], "fim", overlapping=True)
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "afiliacao", "periodo_id")


@register("q_party_line", """
with v as (select e.user_id, date_trunc('hour', e.ts) as sessao, e.event_type, c.c_mktsegment as partido
           from events e join customer c on e.user_id = c.c_custkey),
cnt as (select sessao, partido, event_type, count(*) as n from v group by all),
line as (select sessao, partido, arg_max(event_type, (n, event_type)) as linha from cnt group by all),
m as (select v.user_id, v.partido, count(*) as n_votos,
             count(case when v.event_type = line.linha then 1 end) as n_alinhados
      from v join line on v.sessao = line.sessao and v.partido = line.partido group by all),
coh as (select partido, sum(n_alinhados) as a, sum(n_votos) as t from m group by 1)
select m.user_id, m.partido, m.n_votos, m.n_alinhados,
       """ + exact_ratio_sql("m.n_alinhados * 100", "m.n_votos", 2, 0, "duckdb") + """ as fidelidade,
       """ + exact_ratio_sql("coh.a * 100", "coh.t", 2, 0, "duckdb") + """ as coesao_partido
from m join coh on m.partido = coh.partido
""")
def q_party_line(spark, d):
    """party_line: the party's line in a session is its members' majority
    vote (ties -> greatest label); each member's fidelity to it and the
    party's cohesion.  Votes = events, party = customer segment."""
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("partido"))
    v = join_left_dim(e, c, e.user_id == c.c_custkey).where(F.col("c_custkey").isNotNull()) \
        .select("user_id", trunc_hour_ntz("ts").alias("sessao"), "event_type", "partido")
    # the votes are reduced once; line, fidelity and cohesion all come from it
    v = v.groupBy("sessao", "partido", "user_id", "event_type").agg(count_rows().alias("k"))
    line = (v.groupBy("sessao", "partido", "event_type").agg(F.sum("k").alias("n"))
              .groupBy("sessao", "partido")
              .agg(F.max_by("event_type", F.struct("n", "event_type")).alias("linha")))
    same = F.col("event_type") == F.col("linha")
    m = (v.join(line, ["sessao", "partido"])
          .groupBy("user_id", "partido")
          .agg(F.sum("k").alias("n_votos"),
               F.coalesce(F.sum(F.when(same, F.col("k"))), F.lit(0).cast("bigint"))
               .alias("n_alinhados")))
    coh = m.groupBy("partido").agg(F.sum("n_alinhados").alias("a"), F.sum("n_votos").alias("t"))
    return (m.join(coh, "partido")
             .select("user_id", "partido", "n_votos", "n_alinhados",
                     F.expr(exact_ratio_sql("n_alinhados * 100", "n_votos", 2, 0)).alias("fidelidade"),
                     F.expr(exact_ratio_sql("a * 100", "t", 2, 0)).alias("coesao_partido")))
