"""Physical layout of written tables: clustering on two keys, buckets for joins.

* ``write_zordered``  sorted_write on several keys at once: the bits of the scaled
                      keys are interleaved, so each file holds a small box of
                      values and a filter on either key skips most files.
* ``save_bucketed``   a table hashed and sorted by its join key once; every join of
                      two tables bucketed alike, by any later mart, needs no
                      exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.session import work_dir

BITS = 16


def interleave(cols: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of whole numbers under 2**bits, in turn (Morton order)."""
    if len(cols) * bits > 63:
        raise ValueError("too many bits for a long")
    out = F.lit(0).cast("long")
    for i in range(bits):
        for j, c in enumerate(cols):
            bit = F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, i * len(cols) + j))
    return out


def zorder(df: DataFrame, cols: Sequence[str], bits: int = BITS) -> Column:
    """The place of a row on the curve: each key scaled from its smallest to its
    largest value (one aggregate); nulls come first.  For keys of very uneven
    spread pass ranks."""
    lims = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << bits) - 1
    scaled = []
    for i, c in enumerate(cols):
        lo, hi = lims[f"lo{i}"], lims[f"hi{i}"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        scaled.append(F.coalesce(F.floor((F.col(c).cast("double") - F.lit(lo or 0.0)) / F.lit(width) * top),
                                 F.lit(0)).cast("long"))
    return interleave(scaled, bits)


def write_zordered(df: DataFrame, path: str, cols: Sequence[str], files: int, bits: int = BITS) -> None:
    """Writes about ``files`` files along the curve over ``cols``."""
    placed = df.withColumn("__z", zorder(df, cols, bits))
    placed.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z") \
        .write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, key: Sequence[str], buckets: int, purpose: str) -> str:
    """Saves ``df`` in buckets of ``key``, sorted, in the shared folder; returns the
    table's name.  Rows are dealt by the buckets' hash first, so there is one file
    per bucket."""
    name = f"{purpose.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = f"{work_dir(df.sparkSession, purpose)}/{name}"
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key) \
        .option("path", path).saveAsTable(name)
    return name
