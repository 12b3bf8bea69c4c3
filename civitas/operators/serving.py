"""Serving functions with the caller's keys and columns as
arguments: profile lists, KPIs over several facts, totals with distinct members,
breakdowns, geographic totals, lookups by id with a fallback by name, donors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions._util import col
from civitas.functions.money import to_money
from civitas.operators.aggregates import count_rows
from civitas.operators.link import semi_latest_period


@dataclass(frozen=True)
class Fact:
    """Where a fact keeps its entity, date and amount."""

    df: DataFrame
    entity: str
    date: str
    amount: str

    def rows(self) -> DataFrame:
        return self.df.select(F.col(self.entity).alias("entidade"), F.col(self.date).alias("data"),
                              to_money(self.amount).alias("valor"))


def payroll_kpis(facts: Mapping[str, Fact]) -> DataFrame:
    """One row per fact: its latest month, rows, distinct entities, total and
    mean of that month.  Each fact has a latest month of its own."""
    out = None
    for name, fact in facts.items():
        rows = fact.rows().where(F.col("data").isNotNull()).select(
            "*", F.year("data").alias("ano"), F.month("data").alias("mes"))
        latest = semi_latest_period(rows, ["ano", "mes"]).groupBy("ano", "mes").agg(
            count_rows().alias("n_registros"),
            F.count_distinct("entidade").cast("bigint").alias("n_entidades"),
            F.sum("valor").cast("double").alias("total"),
            F.round(F.sum("valor") / F.count("valor"), 2).cast("double").alias("media"))
        part = latest.withColumn("fato", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def totals_by_year(fact: Fact) -> DataFrame:
    """Total, rows and distinct members per year, one pass."""
    return fact.rows().groupBy(F.year("data").alias("ano")).agg(
        F.sum("valor").cast("double").alias("total"), count_rows().alias("n_registros"),
        F.count_distinct("entidade").cast("bigint").alias("n_membros"))


def breakdowns(df: DataFrame, dims: Mapping[str, Column | str], amount: str) -> DataFrame:
    """Rows and total by each dimension on its own (unit, bond, month, ...):
    the fact is reduced once to all dimensions together, then per dimension.
    A null value of a dimension is a value."""
    small = df.groupBy(*[col(c).cast("string").alias(n) for n, c in dims.items()]).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(to_money(amount)).alias("__v"))
    each = small.select("__n", "__v", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimensao"), F.col(n).alias("valor_dim")) for n in dims])).alias("x"))
    return each.groupBy("x.dimensao", "x.valor_dim").agg(
        F.sum("__n").alias("n_registros"), F.sum("__v").cast("double").alias("total"))


def profile_lists(facts: Mapping[str, Fact], entity_id=None) -> DataFrame:
    """The lists of a profile, for one entity or (None) for all: per list and
    entity its rows, total and last date.  The filter reaches every scan."""
    out = None
    for name, fact in facts.items():
        rows = fact.rows().where(F.col("entidade").isNotNull())
        if entity_id is not None:
            rows = rows.where(F.col("entidade") == F.lit(entity_id))
        part = rows.groupBy("entidade").agg(
            count_rows().alias("n_registros"), F.sum("valor").cast("double").alias("total"),
            F.max("data").cast("date").alias("ultima_data")).withColumn("lista", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def geo_totals(facts: Fact, places: DataFrame, place_key: str, place: str,
               year_from: int | None = None, year_to: int | None = None,
               exclude: Sequence[str] = ()) -> DataFrame:
    """Totals by the place of a fact's entity: its author's home or the
    destination, as ``places`` (key -> place) says.  The fact is reduced to one
    row per entity before the join; either bound of the years may be None."""
    rows = facts.rows()
    if year_from is not None:
        rows = rows.where(F.col("data") >= F.lit(f"{year_from}-01-01").cast("timestamp_ntz"))
    if year_to is not None:
        rows = rows.where(F.col("data") < F.lit(f"{year_to + 1}-01-01").cast("timestamp_ntz"))
    paid = rows.groupBy("entidade").agg(F.sum("valor").alias("v"), F.count(F.lit(1)).alias("n"))
    where = places.select(F.col(place_key).alias("entidade"), F.col(place).alias("lugar")) \
        .where(F.col("lugar").isNotNull() & ~F.col("lugar").isin(*exclude))
    return paid.join(where, "entidade").groupBy("lugar").agg(
        F.sum("v").cast("double").alias("total"), F.sum("n").alias("n_registros"),
        count_rows().alias("n_autores"))


def name_fallback_lookup(df: DataFrame, id_col: str, name_col: str, wanted_id, wanted_name: str) -> DataFrame:
    """Rows of an id; only where it has none, rows whose name holds the first
    word of the wanted name (upper case, trimmed)."""
    words = wanted_name.upper().split()
    hit = df.where(F.col(id_col) == F.lit(wanted_id)).withColumn("origem", F.lit("id"))
    like = F.upper(F.trim(F.col(name_col))).contains(words[0] if words else "")
    none = hit.agg(F.count(F.lit(1))).scalar() == 0
    return hit.unionByName(df.where(like).where(none).withColumn("origem", F.lit("nome")))


def donors_by_candidate(donations: DataFrame, candidate: str, period: Column, amount: str,
                        members: DataFrame, member_key: str, link: str) -> DataFrame:
    """Donations per candidate and period, joined to the members they became."""
    per = donations.groupBy(F.col(candidate).alias("candidato"), period.alias("ano")).agg(
        F.sum(to_money(amount)).cast("double").alias("total"), count_rows().alias("n_doacoes"))
    m = members.where(F.col(link).isNotNull()).select(F.col(member_key).alias("membro"),
                                                      F.col(link).alias("candidato"))
    return m.join(per, "candidato")


def on_watch_list(fact: Fact, watch: DataFrame, key: str) -> DataFrame:
    """Totals of the entities on a list (repeated entries count once)."""
    listed = watch.select(F.col(key).alias("entidade")).distinct()
    return fact.rows().join(listed, "entidade", "left_semi").groupBy("entidade").agg(
        F.sum("valor").cast("double").alias("total"), count_rows().alias("n_registros"))
