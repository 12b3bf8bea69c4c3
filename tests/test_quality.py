"""SURVEY 5(d): the marts' column assertions applied to our own outputs —
one aggregate per table reporting failures per (column, check)."""

import pytest

import __spark_entry__ as entry
from civitas.operators.quality import dq_report
from conftest import SF_SMALL

Q = entry.queries()

# (query, not-null columns, unique key sets, accepted values)
CHECKS = [
    ("q_latest_per_key", ["o_custkey", "o_orderkey"], [["o_custkey"]], {}),
    ("q_earliest_per_key", ["l_partkey"], [["l_partkey"]], {}),
    ("q_dedup_keys", ["l_orderkey", "l_linenumber"], [["l_orderkey", "l_linenumber"]], {}),
    ("q_priority_link", ["p_partkey", "nome_key"], [["p_partkey"]], {"link_source": ["A", "B"]}),
    ("q_upsert", ["o_orderkey", "periodo", "ano"], [["o_orderkey"]], {}),
    ("q_stream_upsert", ["event_id", "dia"], [["event_id"]], {}),
    ("q_stream_monthly", ["dia", "event_type"], [["dia", "event_type"]], {}),
    ("q_timeline", ["materia_identificacao", "num_sessoes"], [["materia_identificacao"]], {}),
    ("q_presence", ["user_id"], [["user_id"]], {}),
    ("q_top_recent", ["o_custkey", "o_orderkey"], [["o_custkey", "rank_in_group"]], {}),
    ("q_augment_master", ["chave", "fonte"], [["chave"]],
     {"fonte": ["primario", "secundario", "primario+secundario"]}),
    # a line shipped before any order of its customer has no affiliation (null)
    ("q_scd2", ["l_orderkey", "o_custkey"], [], {}),
]


@pytest.mark.parametrize("key,not_null,unique,accepted", CHECKS, ids=[c[0] for c in CHECKS])
def test_marts_pass_their_assertions(spark, key, not_null, unique, accepted):
    df = Q[key](spark, SF_SMALL)
    rep = dq_report(df, key, not_null=not_null, unique=unique, accepted_values=accepted)
    failed = [(r.column_name, r.check_name, r.failures) for r in rep.collect() if r.failures]
    assert failed == []


def test_dq_report_counts_failures(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, s string")
    rep = {(r.column_name, r.check_name): (r.failures, r.severity) for r in
           dq_report(df, "t", not_null=["s"], unique=[["k"]], accepted_values={"s": ["a"]},
                     severity={"accepted_values:s": "warn"}).collect()}
    assert rep == {("s", "not_null"): (1, "error"), ("k", "unique"): (1, "error"),
                   ("s", "accepted_values"): (1, "warn")}
