"""Explicit schemas for every input table: never rely on inference."""

from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType,
                               LongType, StringType, StructField, StructType,
                               TimestampNTZType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


TABLES = {
    "region": _s(("r_regionkey", IntegerType()), ("r_name", StringType())),
    "nation": _s(("n_nationkey", IntegerType()), ("n_name", StringType()),
                 ("n_regionkey", IntegerType())),
    "customer": _s(("c_custkey", LongType()), ("c_name", StringType()),
                   ("c_nationkey", IntegerType()), ("c_acctbal", DoubleType()),
                   ("c_mktsegment", StringType())),
    "supplier": _s(("s_suppkey", LongType()), ("s_name", StringType()),
                   ("s_nationkey", IntegerType()), ("s_acctbal", DoubleType())),
    "part": _s(("p_partkey", LongType()), ("p_name", StringType()),
               ("p_brand", StringType()), ("p_type", StringType()),
               ("p_size", IntegerType()), ("p_retailprice", DoubleType())),
    "orders": _s(("o_orderkey", LongType()), ("o_custkey", LongType()),
                 ("o_orderstatus", StringType()), ("o_totalprice", DoubleType()),
                 ("o_orderdate", TimestampNTZType()),
                 ("o_orderpriority", StringType())),
    "lineitem": _s(("l_orderkey", LongType()), ("l_partkey", LongType()),
                   ("l_suppkey", LongType()), ("l_linenumber", IntegerType()),
                   ("l_quantity", DoubleType()), ("l_extendedprice", DoubleType()),
                   ("l_discount", DoubleType()), ("l_tax", DoubleType()),
                   ("l_returnflag", StringType()), ("l_linestatus", StringType()),
                   ("l_shipdate", TimestampNTZType())),
    "events": _s(("event_id", LongType()), ("ts", TimestampNTZType()),
                 ("user_id", LongType()), ("event_type", StringType()),
                 ("value", DoubleType()), ("props", StringType())),
    "documents": _s(("doc_id", LongType()), ("text", StringType()),
                    ("lang", StringType()), ("source", StringType()),
                    ("n_chars", LongType())),
    "labels": _s(("doc_id", LongType()), ("quality", IntegerType()),
                 ("toxic", IntegerType())),
    "pages": _s(("page_id", LongType()), ("url", StringType()),
                ("html", StringType())),
    "conversations": _s(("conv_id", LongType()), ("turn", LongType()),
                        ("role", StringType()), ("text", StringType())),
    "benchmark": _s(("item_id", LongType()), ("text", StringType())),
    "embeddings": _s(("vec_id", LongType()),
                     ("embedding", ArrayType(FloatType())), ("label", IntegerType())),
}
