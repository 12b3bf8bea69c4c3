"""Search by an inverted index of character trigrams.

``contains`` on a text reads every text for every question.  The index holds, for
each trigram of a lower-cased column, the ids of the rows that contain it:

* ``build_trigram_index``   postings (gram, number of the column, id) in ranges of
                            that order, so a frequent gram spreads over files and a
                            question reads the row groups of its grams only; and
                            how many rows hold each gram.  A gram is a long, made
                            of its three code points.
* ``search_trigrams``       per term the rarest of its grams (``GRAMS``) are
                            looked up and the ids that have all of them kept; these
                            rows are verified against the whole term.  Grams a term
                            leaves out only make more candidates, never fewer.
* terms under three letters in lower case, which have no trigram, are answered by one scan for
  all of them.

The result equals ``scan_terms``: a row is found when any of the columns contains
the term, upper and lower case alike.  Null columns contain nothing; the empty term
is in every column that is not null; null ids and repeated ids are found by each of
their rows that contains the term.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

GRAMS = 8       # looked up per term and column
AT_ONCE = 1 << 18   # postings of an Arrow batch


def trigrams(text: str) -> np.ndarray:
    """The different trigrams of a lower-cased text, sorted; none for shorter texts."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.unique(a[:-2] << 42 | a[1:-1] << 21 | a[2:])


def _any_contains(cols: Sequence[str], term: Column) -> Column:
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce(F.contains(F.lower(c), F.lower(term)), F.lit(False))
    return found


def scan_terms(df: DataFrame, id_col: str, cols: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """term, id by one scan: every term against every row."""
    hits = [F.when(_any_contains(cols, F.lit(t)), F.lit(t)) for t in dict.fromkeys(terms)]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return df.select(F.explode(found).alias("term"), F.col(id_col).alias("id"))


def build_trigram_index(df: DataFrame, id_col: str, cols: Sequence[str], path: str) -> None:
    """Writes ``postings`` and ``grams`` under ``path``."""
    rows = df.select(F.col(id_col).alias("id"), *[F.lower(c).alias(f"t{i}") for i, c in enumerate(cols)])

    def per_task(batches):
        for b in batches:
            for no in range(len(cols)):
                texts = b.column(1 + no)
                grams, size, first = [], 0, 0
                for row in range(b.num_rows):
                    grams.append(trigrams(texts[row].as_py() or ""))
                    size += len(grams[-1])
                    if size >= AT_ONCE or row == b.num_rows - 1:
                        of = np.repeat(np.arange(first, row + 1), [len(g) for g in grams])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(grams)), pa.array(np.full(size, no, np.int32)),
                             b.column(0).take(pa.array(of))], names=["gram", "no", "id"])
                        grams, size, first = [], 0, row + 1

    postings = rows.mapInArrow(per_task, StructType([
        StructField("gram", LongType()), StructField("no", IntegerType()), rows.schema["id"]]))
    postings.repartitionByRange("gram", "no", "id").sortWithinPartitions("gram", "no", "id") \
        .write.mode("overwrite").parquet(f"{path}/postings")
    names = F.array(*[F.lit(c) for c in cols])
    df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram", "no").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("field", F.get(names, F.col("no"))) \
        .repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def _wanted(spark: SparkSession, path: str, cols: Sequence[str], of: dict[str, list[int]]) -> list[tuple]:
    """(term, number of the column, gram, how many) of the grams to look up: at most
    ``GRAMS`` per term and column, so a list bounded by the question."""
    every = sorted({g for grams in of.values() for g in grams})
    n = {(r.gram, r.field): r for r in
         spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(every)).collect()}
    out = []
    for t, grams in of.items():
        for c in cols:
            if all((g, c) in n for g in grams):
                rare = sorted(grams, key=lambda g: (n[g, c].n, g))[:GRAMS]
                out += [(t, n[g, c].no, g, len(rare)) for g in rare]
    return out


def search_trigrams(df: DataFrame, path: str, id_col: str, cols: Sequence[str],
                    terms: Sequence[str]) -> DataFrame:
    """term, id: the rows of ``df`` (indexed under ``path``) that contain a term in
    one of ``cols``."""
    spark = df.sparkSession
    terms = list(dict.fromkeys(terms))
    # the engine's own lower case cuts the terms as it cut the texts
    of = {r.term: trigrams(r.low).tolist() for r in spark.createDataFrame([(t,) for t in terms], "term string")
          .select("term", F.lower("term").alias("low")).collect()}
    of = {t: grams for t, grams in of.items() if grams}
    short = [t for t in terms if t not in of]
    wanted = _wanted(spark, path, cols, of) if of else []
    parts = [scan_terms(df, id_col, cols, short)] if short else []
    if wanted:
        ask = spark.createDataFrame(wanted, "term string, no int, gram long, k int")
        postings = spark.read.parquet(f"{path}/postings").where(
            F.col("gram").isin(sorted({w[2] for w in wanted})))
        # rows that share an id have their postings each
        ids = postings.join(F.broadcast(ask), ["gram", "no"]).distinct() \
            .groupBy("term", "no", "id", "k").agg(F.count(F.lit(1)).alias("n")) \
            .where("n = k").select("term", F.col("id").alias("__found")).distinct()
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(cols)])
        hit = rows.join(ids, F.col("id").eqNullSafe(F.col("__found")))
        parts.append(hit.where(_any_contains([f"__{i}" for i in range(len(cols))], F.col("term")))
                     .select("term", "id"))
    if not parts:
        return spark.createDataFrame([], "term string").withColumn(
            "id", F.lit(None).cast(df.schema[id_col].dataType))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
