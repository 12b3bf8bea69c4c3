"""Exact dedup: group by a 128-bit content hash, compare bytes inside a group,
keep one stable id per distinct text.  DataFrame functions only.

One aggregation on (hash, text) does both: rows meet by hash, and the grouping
key compares the bytes, so a hash collision splits into two classes.  Partial
aggregation sends at most one row per text and map task, however many copies a
text has.  The class table (no texts) is written once; rows find their class by
hash alone.  Hashes shared by different texts, if any exist, are joined on the
text itself.

Defined cases: null text equals the empty text.  Rows of one text with the same
id are one document: all of them carry the id that stays and are marked kept.
A null id stays only where every id of its group is null.  An empty table gives
no rows.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.llm.common import text_or_empty
from civitas.session import materialize_table


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(df: DataFrame, id_col: str, text_col: str, keep: str = "smallest",
                  content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest`` id.  ``content_hash`` is a
    parameter so that tests can force collisions.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("h", content_hash(F.col("text")))
    by_text = docs.groupBy("h", "text").agg(
        pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = materialize_table(
        by_text.select("h", F.sha2(F.col("text"), 256).alias("text_sha256"),
                       "keep_id", "group_size"), "exact-classes")
    per_hash = classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    collided = per_hash.where("texts > 1").select("h")
    if collided.isEmpty():
        out = docs.select("id", "h").join(classes, "h")
    else:
        plain = docs.select("id", "h").join(
            classes.join(collided, "h", "left_anti"), "h")
        mixed = docs.join(collided, "h", "left_semi")
        own = by_text.withColumn("text_sha256", F.sha2(F.col("text"), 256)) \
            .join(collided, "h", "left_semi")
        out = plain.unionByName(mixed.join(own, ["h", "text"]).select(plain.columns))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str, text_col: str,
                      keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with its columns.

    The smallest id per hash and text is found without moving the other
    columns; a row stays when its id and text are those of its class.
    """
    found = exact_classes(df, id_col, text_col, keep)
    stay = found.where("kept").select(F.col(id_col).alias("stay_id"),
                                      F.col("text_sha256").alias("stay_sha")).distinct()
    same = df[id_col].eqNullSafe(stay["stay_id"]) \
        & (F.sha2(F.coalesce(df[text_col], F.lit("")), 256) == stay["stay_sha"])
    return df.join(stay, same, "left_semi")
