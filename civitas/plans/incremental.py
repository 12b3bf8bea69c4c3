"""Incremental loads: keyed upsert with watermarks, file streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from civitas.functions.dates import ntz_as_utc_instant
from civitas.operators.distinct_state import dense_ids, distinct_mart, roll_up_levels
from civitas.operators.file_merge import merge_keyed_files, read_keyed_files, write_keyed_files
from civitas.operators.layout import save_bucketed, write_zordered
from civitas.operators.upsert import (high_watermark, ledger_watermark, record_watermark,
                                      watermark_filter)
from civitas.plans.registry import register
from civitas.schemas import TABLES
from civitas.session import materialize_table, path_exists, work_dir
from civitas.sources.tables import scan_parquet_glob, table
from civitas.streaming.dedup_state import dedup_available_now, read_outcomes
from civitas.streaming.files import (fold_additive_agg, read_additive_agg, run_available_now,
                                     skip_existing_periods, skipped_periods,
                                     stream_additive_agg, stream_dedup,
                                     stream_merge_files, stream_period_files)


def _orders_batches(spark, d):
    o = table(spark, d, "orders").withColumn("ano", F.year("o_orderdate")).withColumn(
        "periodo", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    b1 = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "periodo", "ano")
    # second delivery: overlaps the last half year, prices revised, a new column
    b2 = o.where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.round(F.col("o_totalprice").cast("decimal(18,2)") * F.lit(1.1).cast("decimal(2,1)"), 2)
        .cast("double").alias("o_totalprice"),
        "o_orderdate", "o_orderpriority", "periodo", "ano")
    return b1, b2


@register("q_upsert", """
with o as (select *, year(o_orderdate) * 100 + month(o_orderdate) as periodo from orders),
wm as (select max(periodo) as p from o where o_orderdate < timestamp '1999-01-01')
select o_orderkey, o_custkey, o_orderstatus,
       case when periodo >= (select p from wm)
            then cast(round(cast(o_totalprice as decimal(18,2)) * 1.1, 2) as double)
            else o_totalprice end as o_totalprice,
       o_orderdate,
       case when periodo >= (select p from wm) then o_orderpriority end as o_orderpriority,
       periodo, year(o_orderdate) as ano
from o
""")
def q_upsert(spark, d):
    """full_refresh (batch 1), watermark_table (Parquet ledger),
    watermark_filter_ge (the second batch re-reads the last loaded period
    only), upsert_by_key (only files with a touched key rewritten), schema_sync
    (batch 2 adds a column), sorted_write.  Returns the table's final state."""
    root = work_dir(spark, "upsert-orders")
    target, ledger = f"{root}/fct_orders", f"{root}/ledger"
    b1, b2 = _orders_batches(spark, d)
    n1 = write_keyed_files(spark, b1, target, ["o_orderkey"], ["ano"]).rows_written
    record_watermark(spark, ledger, "orders", high_watermark(read_keyed_files(spark, target), "periodo"), n1)
    wm = high_watermark(read_keyed_files(spark, target), "periodo")
    assert str(wm) == str(ledger_watermark(spark, ledger, "orders"))
    fresh = watermark_filter(b2, "periodo", wm, strict=False)
    n2 = merge_keyed_files(spark, fresh, target, ["o_orderkey"], ["ano"]).rows_written
    record_watermark(spark, ledger, "orders", high_watermark(read_keyed_files(spark, target), "periodo"), n2)
    return read_keyed_files(spark, target).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority", "periodo", "ano")


EVENTS_LANDING = StructType(TABLES["events"].fields + [StructField("dia", DateType())])


def _land(events, landing, days=None, skip_existing_of=None, spark=None):
    """Write events as one period folder per calendar date; ``days`` is an
    optional condition on ``dia``.  ``skip_existing_of``: period_skip_existing —
    periods already landed are left alone (anti-join against the periods
    present in the landing)."""
    part = events.withColumn("dia", F.col("ts").cast("date"))
    if days is not None:
        part = part.where(days)
    if skip_existing_of is not None:
        part = skip_existing_periods(spark, part, skip_existing_of, "dia", EVENTS_LANDING)
    # a few files per period; AQE splits a busy day over several tasks
    part.hint("rebalance", "dia").write.mode("append").partitionBy("dia").parquet(landing)


@register("q_stream_upsert", """
select event_id, ts, user_id, event_type, value, props, cast(ts as date) as dia from events
""")
def q_stream_upsert(spark, d):
    """stream_period_files (file source, availableNow, checkpoint in the
    shared folder), stream_upsert (foreachBatch -> merge by file; replays are
    idempotent), stream_dedup (a re-delivered week of period files collapses
    on the key), period_skip_existing, scan_parquet_glob."""
    root = work_dir(spark, "stream-events")
    landing, target = f"{root}/landing", f"{root}/fct_events"
    ev = table(spark, d, "events")
    day = F.dayofmonth("dia")
    _land(ev, landing, (day <= 20) | F.col("dia").isNull())
    _land(ev, landing, day >= 15)               # re-delivery: days 15-20 of each month twice
    _land(ev, landing, skip_existing_of=landing, spark=spark)   # nothing new: skipped
    stream = stream_period_files(spark, landing, EVENTS_LANDING, max_files_per_trigger=32)
    stream_merge_files(spark, stream, target, ["event_id"], ["dia"], f"{root}/checkpoint")
    done = read_keyed_files(spark, target)
    done = spark.createDataFrame([], EVENTS_LANDING) if done is None else done
    return done.select("event_id", "ts", "user_id", "event_type", "value", "props", "dia")


@register("q_stream_dedup", """
select event_id, user_id, event_type, value from events
""")
def q_stream_dedup(spark, d):
    """stream_dedup: every period file lands twice; keys are remembered until
    the watermark, whose delay covers the whole landing here, so no row is
    late and the second copies go.  scan_parquet_glob reads the result."""
    root = work_dir(spark, "stream-dedup")
    landing, out = f"{root}/landing", f"{root}/events"
    ev = table(spark, d, "events")
    _land(ev, landing)
    _land(ev, landing)
    stream = stream_period_files(spark, landing, EVENTS_LANDING)
    # the time of arrival: one watermark for all rows of a run
    stream = stream.withColumn("arrived", F.current_timestamp())
    once = stream_dedup(stream, ["event_id"], "arrived", "1 day")
    # a replayed batch replaces its own folder
    run_available_now(once, lambda b, i: b.drop("arrived").write.mode("overwrite")
                      .parquet(f"{out}/batch={i}"), f"{root}/checkpoint")
    schema = StructType(EVENTS_LANDING.fields + [StructField("batch", IntegerType())])
    if not path_exists(spark, out):  # no batch came
        return spark.createDataFrame([], schema).select("event_id", "user_id", "event_type", "value")
    return scan_parquet_glob(spark, out, schema).select("event_id", "user_id", "event_type", "value")


@register("q_stream_monthly", """
select cast(ts as date) as dia, event_type, count(*) as n_eventos,
       cast(sum(cast(value as decimal(18,2))) as double) as total
from events group by 1, 2
""")
def q_stream_monthly(spark, d):
    """stream_monthly_agg: partial sums per day and event type of each
    micro-batch, folded into one table at the end and added up on reading.  Every period lands by its calendar date;
    rows of any lateness count, so events in = events counted."""
    root = work_dir(spark, "stream-agg")
    landing, deltas = f"{root}/landing", f"{root}/agg_deltas"
    _land(table(spark, d, "events"), landing)
    stream = stream_period_files(spark, landing, EVENTS_LANDING, max_files_per_trigger=16)
    stream_additive_agg(spark, stream, deltas, [F.col("dia"), F.col("event_type")],
                        {"n_eventos": F.count(F.lit(1)),
                         "total": F.sum(F.col("value").cast("decimal(18,2)"))},
                        f"{root}/checkpoint")
    fold_additive_agg(spark, deltas, ["dia", "event_type"], ["n_eventos", "total"])
    return read_additive_agg(spark, deltas, ["dia", "event_type"], ["n_eventos", "total"]).select(
        "dia", "event_type", "n_eventos", F.col("total").cast("double").alias("total"))


@register("q_upsert_strict", """
with o as (select *, year(o_orderdate) * 100 + month(o_orderdate) as periodo from orders),
wm as (select max(periodo) as p from o where o_orderdate < timestamp '1999-01-01')
select o_orderkey, o_custkey, o_orderstatus,
       case when periodo > (select p from wm)
            then cast(round(cast(o_totalprice as decimal(18,2)) * 1.1, 2) as double)
            else o_totalprice end as o_totalprice,
       o_orderdate,
       case when periodo > (select p from wm) then o_orderpriority end as o_orderpriority,
       periodo, year(o_orderdate) as ano
from o
""")
def q_upsert_strict(spark, d):
    """watermark_filter_gt: the same two deliveries as q_upsert with a strict
    ``>`` watermark — revised rows of the last loaded period are not
    reloaded (the late-row loss the ``>=`` form avoids)."""
    root = work_dir(spark, "upsert-strict")
    target = f"{root}/fct_orders"
    b1, b2 = _orders_batches(spark, d)
    write_keyed_files(spark, b1, target, ["o_orderkey"], ["ano"])
    wm = high_watermark(read_keyed_files(spark, target), "periodo")
    merge_keyed_files(spark, watermark_filter(b2, "periodo", wm, strict=True), target,
                      ["o_orderkey"], ["ano"])
    return read_keyed_files(spark, target).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority", "periodo", "ano")


@register("q_upsert_files", """
select o_orderkey, o_custkey, o_orderstatus,
       case when o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-07-01'
            then cast(round(cast(o_totalprice as decimal(18,2)) * 1.1, 2) as double)
            else o_totalprice end as o_totalprice,
       case when o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-07-01'
            then 1999 else year(o_orderdate) end as ano,
       case when o_orderdate >= timestamp '1999-01-01'
              or (o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-07-01')
            then o_orderpriority end as o_orderpriority
from orders
""")
def q_upsert_files(spark, d):
    """upsert_by_key by files: a table partitioned by year is loaded, then a
    batch brings the orders of the first half of 1998 with a new price and
    another year (their keys leave the partition) and all orders from 1999 on;
    only files that hold a touched key are rewritten.  schema_sync: the batch no
    longer has ``obs``, which leaves the table, and adds ``o_orderpriority``."""
    path = f"{work_dir(spark, 'upsert-files')}/fct_orders"
    o = table(spark, d, "orders").withColumn("ano", F.year("o_orderdate"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    first = o.where(F.col("o_orderdate").isNull() | (F.col("o_orderdate") < day("1999-01-01"))).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit("v1").alias("obs"), "ano")
    moved = (F.col("o_orderdate") >= day("1998-01-01")) & (F.col("o_orderdate") < day("1998-07-01"))
    price = F.round(F.col("o_totalprice").cast("decimal(18,2)") * F.lit(1.1).cast("decimal(2,1)"), 2)
    batch = o.where(moved | (F.col("o_orderdate") >= day("1999-01-01"))).select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(moved, price.cast("double")).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority", F.when(moved, F.lit(1999)).otherwise(F.col("ano")).alias("ano"))
    write_keyed_files(spark, first, path, ["o_orderkey"], ["ano"])
    merge_keyed_files(spark, batch, path, ["o_orderkey"], ["ano"], drop_missing=True)
    return read_keyed_files(spark, path)


@register("q_distinct_rollup", """
with o as (select year(o_orderdate) as ano, month(o_orderdate) as mes, nullif(o_orderstatus, 'P') as situacao,
                  o_custkey, cast(o_orderdate as date) as dia, cast(o_totalprice as decimal(18,2)) as v
           from orders)
select 'mes' as nivel, ano, mes, situacao, cast(sum(v) as double) as total, count(*) as n_pedidos,
       count(distinct o_custkey) as n_clientes, count(distinct dia) as n_dias
from o group by ano, mes, situacao
union all
select 'ano', ano, null, situacao, cast(sum(v) as double), count(*), count(distinct o_custkey), count(distinct dia)
from o group by ano, situacao
union all
select 'situacao', null, null, situacao, cast(sum(v) as double), count(*), count(distinct o_custkey),
       count(distinct dia) from o group by situacao
union all
select 'total', null, null, null, cast(sum(v) as double), count(*), count(distinct o_custkey), count(distinct dia)
from o
""")
def q_distinct_rollup(spark, d):
    """agg_rollup_from_agg with distinct counts: a monthly mart (null status
    included) of two loads with mergeable bitmaps of customers and days, rolled
    up to years, statuses and the total without reading the fact again."""
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes"),
        F.expr("nullif(o_orderstatus, 'P')").alias("situacao"), "o_custkey",
        F.col("o_orderdate").cast("date").alias("dia"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("valor"))
    root, ids = work_dir(spark, "distinct-mart"), {"o_custkey": None, "dia": None}
    old = F.coalesce(F.col("ano") < 1998, F.lit(True))
    for load in (o.where(old), o.where(~old)):
        ids = {c: materialize_table(dense_ids(load, c, known), f"ids-{c}") for c, known in ids.items()}
        distinct_mart(load, ["ano", "mes", "situacao"],
                      {"total": F.sum("valor"), "n_pedidos": F.count(F.lit(1))},
                      {"n_clientes": ("o_custkey", ids["o_custkey"]), "n_dias": ("dia", ids["dia"])}) \
            .write.mode("append").parquet(f"{root}/mart")
    mart = spark.read.parquet(f"{root}/mart")
    out = roll_up_levels(mart, {"mes": ["ano", "mes", "situacao"], "ano": ["ano", "situacao"],
                                "situacao": ["situacao"], "total": []},
                         ["total", "n_pedidos"], ["n_clientes", "n_dias"])
    return out.withColumn("total", F.col("total").cast("double"))


@register("q_stream_outcomes", """
with e as (select *, date_trunc('milliseconds', max(ts) over ()) - interval 30 day as limite from events)
select event_id, 'kept' as outcome, 1 as n from e where ts >= limite or ts is null
union all select event_id, 'duplicate', 1 from e where ts >= limite
union all select event_id, 'late', 1 from e where ts < limite
""")
def q_stream_outcomes(spark, d):
    """stream_dedup without loss: the last 30 days land first, then everything
    again.  The second delivery's rows are duplicates, or late where they are
    older than 30 days before the newest row; each row leaves once, with its
    outcome, also when a micro-batch is replayed."""
    root = work_dir(spark, "stream-outcomes")
    landing, out = f"{root}/landing", f"{root}/events"
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value",
                                          ntz_as_utc_instant("ts").alias("at"))
    newest = ev.agg(F.max(F.unix_millis("at"))).first()[0]
    recent = ev.where(F.col("at").isNull() | (F.unix_millis("at") >= F.lit(newest) - 30 * 86_400_000)) \
        if newest is not None else ev
    for delivery in (recent, ev.where(F.col("at").isNotNull())):
        delivery.write.mode("append").parquet(landing)
        stream = stream_period_files(spark, landing, ev.schema)
        dedup_available_now(spark, stream, ["event_id"], "at", "30 days", out, f"{root}/checkpoint")
    return read_outcomes(spark, out, ev.schema).groupBy("event_id", "outcome").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


@register("q_period_skip", """
select cast(ts as date) as dia, count(*) as n_linhas,
       case when day(cast(ts as date)) <= 10 then count(*) else 0 end as n_puladas
from events group by 1
""")
def q_period_skip(spark, d):
    """period_skip_existing with its report: the first ten days of every month
    are there; a second load brings all days, lands the new ones and says how
    many rows of the others it skipped."""
    landing = f"{work_dir(spark, 'period-skip')}/landing"
    ev = table(spark, d, "events")
    _land(ev, landing, F.dayofmonth("dia") <= 10)
    skipped = materialize_table(skipped_periods(spark, ev.withColumn("dia", F.col("ts").cast("date")), landing,
                                                "dia", EVENTS_LANDING), "skipped")
    _land(ev, landing, skip_existing_of=landing, spark=spark)
    landed = spark.read.schema(EVENTS_LANDING).parquet(landing).groupBy("dia").agg(
        F.count(F.lit(1)).alias("n_linhas"))
    s = skipped.select(F.col("dia").alias("d"), "rows")
    return landed.join(s, F.col("dia").eqNullSafe(F.col("d")), "left").select(
        "dia", "n_linhas", F.coalesce("rows", F.lit(0)).alias("n_puladas"))


@register("q_sorted_zorder", """
select l_suppkey, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantidade,
       min(l_partkey) as menor_peca from lineitem group by 1
""")
def q_sorted_zorder(spark, d):
    """sorted_write on two keys: lineitem is written along a space-filling curve
    over part and supplier, read back and summed by supplier."""
    path = f"{work_dir(spark, 'zorder')}/lineitem"
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    write_zordered(li, path, ["l_partkey", "l_suppkey"], 16)
    return spark.read.parquet(path).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantidade"),
        F.min("l_partkey").alias("menor_peca"))


@register("q_bucketed_join", """
select l.l_orderkey, o.o_custkey, count(*) as n_itens,
       cast(sum(cast(l.l_extendedprice as decimal(18,2))) as double) as total
from lineitem l left join orders o on l.l_orderkey = o.o_orderkey group by 1, 2
""")
def q_bucketed_join(spark, d):
    """join_left_dim of marts that share a key: fact and dimension are saved in
    buckets of the order key once; the join and the aggregate on that key then
    need no exchange."""
    li = save_bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_orderkey"], 8, "b-lines")
    o = save_bucketed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 8, "b-orders")
    left, right = spark.table(li), spark.table(o).hint("merge")
    return left.join(right, left.l_orderkey == right.o_orderkey, "left").groupBy("l_orderkey", "o_custkey").agg(
        F.count(F.lit(1)).alias("n_itens"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
