"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_or_empty(col: str) -> Column:
    """Null text counts as the empty text everywhere."""
    return F.coalesce(F.col(col), F.lit(""))


def key128(text: Column) -> list[Column]:
    """128 bits of a text as two longs (``k1``, ``k2``): xxhash64 under two
    seeds, cheaper to move than a hex digest."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed until none clashes with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Arrow batches of fewer rows and of about ``size`` bytes for tables of whole
    texts, unless the session has set a number itself."""
    for name, default, value in (
            ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows),
            ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 ** 31 - 1), size)):
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(value))


def _first(rows: DataFrame, v: Column, lo: int, hi: int, left: int) -> tuple[int, int]:
    """(bound, what is left): rows with ``v`` under the bound are at most ``left``,
    with those equal to it they are more.  Histograms of 256 bins."""
    while lo < hi and left:
        step = (hi - lo) // 256 + 1
        bins = rows.where(v.between(lo, hi)).groupBy(
            ((v - lo) - F.pmod(v - lo, F.lit(step))).alias("b")).count().orderBy("b").collect()
        for r in bins:
            if r["count"] > left:
                lo, hi = lo + r.b, min(hi, lo + r.b + step - 1)
                break
            left -= r["count"]
        else:
            return hi + 1, left
    return lo, left


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of ``counts`` with the largest ``n``, of equals those of
    the smallest hash; all rows if they are fewer.

    A sum over eighths of octaves of ``n`` (a few hundred rows, whatever the
    data) tells from which on they are few enough, so no task or driver sees a
    list of ``size`` rows per task.  The eighth at the border is filled by finer
    histograms, of ``n`` and then of the hash.
    """
    eighth = F.floor(F.log2("n") * 8)
    left, border = size, None
    for r in counts.groupBy(eighth.alias("e")).agg(
            F.count(F.lit(1)).alias("count"), F.min("n").alias("lo"),
            F.max("n").alias("hi")).orderBy(F.desc("e")).collect():
        if r["count"] > left:
            border = r
            break
        left -= r["count"]
    if border is None:
        return counts
    inside = counts.where(eighth == border.e)
    down = F.lit(border.hi) - F.col("n")
    bound, left = _first(inside, down, 0, border.hi - border.lo, left)
    n = border.hi - bound
    rank = F.shiftrightunsigned(F.xxhash64(*[c for c in counts.columns if c != "n"]), 1)
    last, _ = _first(counts.where(F.col("n") == n), rank, 0, 2 ** 63 - 1, left) if left else (0, 0)
    return counts.where((F.col("n") > n) | ((F.col("n") == n) & (rank < last)))
