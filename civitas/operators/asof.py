"""Point-in-time (as-of) join: the attributes of the latest period that
started at or before each event, per key (SCD2 affiliation at event date).

The range-join form ``event_date >= from AND event_date < to`` with an equi
key pairs every event of a key with every period of that key before
filtering: quadratic for a heavy key.  Here it is linear:

1. events and period starts are stacked and bucketed by (key, month);
2. inside a bucket a running ``last(period, ignorenulls)`` gives the period
   active at each event (periods sort before events at the same instant);
3. an event that precedes every start in its month takes the last period of
   an earlier month: one row per (key, month) with a period, carried forward
   by a window over the months of a key (bounded by the number of months).

A key holding a third of the rows is spread over its months, each a task;
``bucket="day"`` bounds a task by one key-day instead, for keys that are hot
even within a month (the carry table then has a row per active key-day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitas.session import materialize_table


def _bucket(t, bucket: str):
    d = t.cast("date")
    return d if bucket == "day" else F.trunc(d, bucket)


def asof_join(events: DataFrame, periods: DataFrame, key: str, event_time: str,
              start_time: str, attrs: Sequence[str], tie_break: Sequence[str] = (),
              end_time: str | None = None, bucket: str = "MM") -> DataFrame:
    """``events`` plus ``attrs`` of the period active at ``event_time``.

    Among periods starting at the same instant the greatest ``tie_break``
    wins.  With ``end_time`` a period stops applying at its end (exclusive):
    events in a gap get nulls."""
    attrs, tie_break = list(attrs), list(tie_break)
    pcols = attrs + [c for c in tie_break if c not in attrs]
    if end_time:
        pcols.append(end_time)
    pstruct = F.struct(*[F.col(c).alias(c) for c in pcols])
    ev_cols = [c for c in events.columns]

    ev = events.select(F.col(key).alias("__k"), F.col(event_time).alias("__t"),
                       F.lit(1).alias("__kind"), F.struct(*[F.col(c) for c in ev_cols]).alias("__ev"),
                       F.lit(None).cast(periods.select(pstruct).schema[0].dataType)
                       .alias("__p"),
                       *[F.lit(None).cast(periods.schema[c].dataType).alias(f"__tb{i}")
                         for i, c in enumerate(tie_break)])
    pr = periods.select(F.col(key).alias("__k"), F.col(start_time).alias("__t"),
                        F.lit(0).alias("__kind"),
                        F.lit(None).cast(events.select(F.struct(*[F.col(c) for c in ev_cols]))
                                         .schema[0].dataType).alias("__ev"),
                        pstruct.alias("__p"),
                        *[F.col(c).alias(f"__tb{i}") for i, c in enumerate(tie_break)])
    u = ev.unionByName(pr).withColumn("__m", _bucket(F.col("__t"), bucket))

    order = [F.col("__t").asc_nulls_first(), F.col("__kind").asc()] + \
            [F.col(f"__tb{i}").asc_nulls_first() for i in range(len(tie_break))]
    w_in = (Window.partitionBy("__k", "__m").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("__in", F.last("__p", ignorenulls=True).over(w_in))

    # last period of each (key, month), then carried into later months
    last_in_month = (pr.withColumn("__m", _bucket(F.col("__t"), bucket))
                       .groupBy("__k", "__m")
                       .agg(F.max_by("__p", F.struct("__t", *[f"__tb{i}" for i in range(len(tie_break))]))
                            .alias("__lp")))
    months = u.select("__k", "__m").distinct().join(last_in_month, ["__k", "__m"], "left")
    w_carry = (Window.partitionBy("__k").orderBy("__m")
               .rowsBetween(Window.unboundedPreceding, -1))
    months = months.withColumn("__carry", F.last("__lp", ignorenulls=True).over(w_carry)) \
                   .select("__k", "__m", "__carry")

    out = (u.where(F.col("__kind") == 1).join(months, ["__k", "__m"], "left")
             .withColumn("__hit", F.coalesce("__in", "__carry")))
    if end_time:
        out = out.withColumn("__hit", F.when(
            F.col(f"__hit.{end_time}").isNull() | (F.col("__t") < F.col(f"__hit.{end_time}")),
            F.col("__hit")))
    return out.select("__ev.*", *[F.col(f"__hit.{c}").alias(c) for c in attrs])


# ---- prefix scan over range partitions --------------------------------------

def asof_scan(events: DataFrame, periods: DataFrame, key: str, event_time: str, start_time: str,
              attrs: Sequence[str], tie_break: Sequence[str] = (), end_time: str | None = None,
              overlapping: bool = False) -> DataFrame:
    """``events`` plus ``attrs`` of the period active at ``event_time``, by a
    distributed prefix scan: nothing is grouped by key, so a key that holds a
    third of all rows lies in as many tasks as its rows need.

    1. events and period starts are dealt into ranges of (key, time), starts
       before events of the same instant, equal events apart by their hash, and
       written once with the number of their range;
    2. a running ``last`` inside each range finds the latest start;
    3. rows before a range's first start take the last start of the ranges
       before it: one row per range, carried over the borders.

    Among periods that start at the same instant the greatest ``tie_break`` wins.
    With ``end_time`` a period stops at its end (exclusive; null: never).  A later
    start replaces the period before it for good, unless ``overlapping``: then
    the latest start among the periods still open counts (``flatten_periods``).
    Null keys match nothing, null times of events have no period, periods without
    a start are left out."""
    attrs, tie_break = list(attrs), list(tie_break)
    if overlapping:
        if end_time is None:
            raise ValueError("overlapping periods need an end_time")
        flat = flatten_periods(periods, key, start_time, end_time, attrs, tie_break)
        return _scan(events, flat, key, event_time, attrs)
    order = [F.col(c) for c in tie_break]
    flat = periods.select(
        F.col(key).alias("__k"), F.col(start_time).alias("__t"),
        F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(attrs)],
                 (F.col(end_time) if end_time else F.lit(None).cast(periods.schema[start_time].dataType))
                 .alias("end")).alias("__p"),
        F.struct(*(order or [F.lit(0)])).alias("__tie"))
    return _scan(events, flat, key, event_time, attrs)


def _scan(events, starts, key, event_time, attrs) -> DataFrame:
    """``starts``: __k, __t, __p (a0.., end; or null: no period), __tie."""
    plain = [c for c, t in events.dtypes if not t.startswith(("map", "variant"))]
    ev = events.select(
        F.col(key).alias("__k"), F.col(event_time).alias("__t"), F.lit(1).alias("__kind"),
        F.lit(None).cast(starts.schema["__tie"].dataType).alias("__tie"),
        F.xxhash64(*plain).alias("__apart"),
        F.lit(None).cast(starts.schema["__p"].dataType).alias("__p"),
        F.struct(*[F.col(c) for c in events.columns]).alias("__ev"))
    st = starts.where(F.col("__k").isNotNull() & F.col("__t").isNotNull()).select(
        "__k", "__t", F.lit(0).alias("__kind"), "__tie", F.lit(0).cast("long").alias("__apart"), "__p",
        F.lit(None).cast(ev.schema["__ev"].dataType).alias("__ev"))
    order = ["__k", "__t", "__kind", "__tie", "__apart"]
    dealt = materialize_table(ev.unionByName(st).repartitionByRange(*order)
                              .withColumn("__range", F.spark_partition_id()), "asof-ranges")

    # the struct is null at events, so the last one that is not is the latest start
    start = F.when(F.col("__kind") == 0, F.struct("__k", "__p"))
    so_far = Window.partitionBy("__range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = dealt.groupBy("__range").agg(
        F.max_by(start, F.when(F.col("__kind") == 0, F.struct("__k", "__t", "__tie"))).alias("__last"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__range", F.last("__last", ignorenulls=True).over(before).alias("__carry"))

    out = dealt.withColumn("__in", F.last(start, ignorenulls=True).over(so_far)) \
        .where(F.col("__kind") == 1).join(ends, "__range")
    hit = F.coalesce("__in", "__carry")
    hit = F.when((hit["__k"] == F.col("__k")) & F.col("__t").isNotNull(), hit["__p"])
    out = out.withColumn("__hit", hit)
    open_ = F.col("__hit.end").isNull() | (F.col("__t") < F.col("__hit.end"))
    return out.select("__ev.*", *[F.when(open_, F.col(f"__hit.a{i}")).alias(c)
                                  for i, c in enumerate(attrs)])


def flatten_periods(periods: DataFrame, key: str, start_time: str, end_time: str,
                    attrs: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Overlapping periods as changes: at every start and every end of a key the
    period active from there on, which is the latest start (then the greatest
    ``tie_break``) among those still open, or null.  Periods that do not end
    after their start hold nowhere.

    Of the periods that never end only the latest start counts, a plain scan.  The
    starts and ends of the others are numbered in order of (key, time), over range
    partitions, and a period is cut into aligned power-of-two pieces of these
    numbers, about two per level and no more levels than its length has.  Only the
    best period of a piece matters, as all of its periods cover it whole; an end
    asks one piece per level.  So there is no window over a key and no pairing of
    periods with each other, however many of a key are open."""
    rows = periods.select(
        F.col(key).alias("__k"), F.col(start_time).alias("__t"), F.col(end_time).alias("__e"),
        F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(attrs)],
                 F.lit(None).cast(periods.schema[start_time].dataType).alias("end")).alias("__p"),
        F.struct(*([F.col(c) for c in tie_break] or [F.lit(0)])).alias("__tie")) \
        .where(F.col("__k").isNotNull() & F.col("__t").isNotNull()
               & (F.col("__e").isNull() | (F.col("__t") < F.col("__e"))))
    first = F.struct(F.col("__t").alias("s"), F.col("__tie").alias("tie"))
    rows = rows.select("__k", "__t", "__e", "__tie",
                       F.struct(first.alias("first"), F.col("__p").alias("p")).alias("__b"))
    ending, lasting = rows.where(F.col("__e").isNotNull()), rows.where(F.col("__e").isNull())
    greatest = F.max_by("__b", "__b.first").alias("__b")
    ending = materialize_table(ending.groupBy("__k", "__t", "__e").agg(greatest), "asof-periods")

    # merged, not broadcast: a few MB of Parquet are hundreds of MB of hashed rows
    points = _numbered(ending.select("__k", "__t").unionByName(
        ending.select("__k", F.col("__e").alias("__t"))).distinct()).hint("merge")
    cut = (ending.join(points.withColumnRenamed("__n", "__lo").hint("merge"), ["__k", "__t"])
           .join(points.select("__k", F.col("__t").alias("__e"), F.col("__n").alias("__hi")).hint("merge"),
                 ["__k", "__e"]))
    # level l holds pieces [i 2**l, (i + 1) 2**l); those of [lo, hi) as in a segment tree
    cut = cut.select("__k", "__b", "__lo", "__hi", F.explode(F.sequence(
        F.lit(0), F.floor(F.log2(F.col("__hi") - F.col("__lo"))).cast("int"))).alias("__l"))
    up = F.expr("shiftright(__lo, __l) + if(shiftleft(shiftright(__lo, __l), __l) < __lo, 1L, 0L)")
    cut = cut.select("__k", "__b", "__l", up.alias("__lo"), F.expr("shiftright(__hi, __l)").alias("__hi")) \
        .where("__lo < __hi").select("__k", "__b", "__l", F.explode(F.array_compact(F.array(
            F.when(F.col("__lo") % 2 == 1, F.col("__lo")),
            F.when(F.col("__hi") % 2 == 1, F.col("__hi") - 1)))).alias("__i"))
    best = materialize_table(cut.groupBy("__k", "__l", "__i").agg(greatest), "asof-pieces")

    ends = ending.select("__k", F.col("__e").alias("__t")).distinct()
    asked = (ends.join(points, ["__k", "__t"])
             .crossJoin(F.broadcast(best.select("__l").distinct()))  # at most 63 levels
             .withColumn("__i", F.expr("shiftright(__n, __l)")))
    after = asked.join(best.hint("merge"), ["__k", "__l", "__i"]).select("__k", "__t", "__b")
    # at an end the latest of the lasting ones, or none
    still = _scan(ends, lasting.select("__k", "__t", F.struct(
        F.col("__b").alias("a0"), F.lit(None).cast(periods.schema[start_time].dataType).alias("end"))
        .alias("__p"), "__tie"), "__k", "__t", ["__b"])
    starts = ending.select("__k", "__t", "__b").unionByName(lasting.select("__k", "__t", "__b"))
    found = after.unionByName(still).unionByName(starts).groupBy("__k", "__t").agg(greatest)
    return found.select("__k", "__t", F.col("__b.p").alias("__p"), F.struct(F.lit(0)).alias("__tie"))


def _numbered(points: DataFrame) -> DataFrame:
    """``points`` (__k, __t, each once) with their number ``__n`` in that order."""
    dealt = materialize_table(points.repartitionByRange("__k", "__t")
                              .withColumn("__range", F.spark_partition_id()), "asof-points")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").count().select(  # a row per range
        "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy("__k", "__t")
    return dealt.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(sizes), "__range") \
        .select("__k", "__t", (F.col("__before") + F.col("__at") - 1).alias("__n"))
