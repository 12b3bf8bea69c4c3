"""Analytical composites: outliers, scorecards, timelines.

Group statistics are computed as aggregates (exact, skew-safe quantiles from
``quantiles``) and joined back to the rows; nothing loops over groups on the
driver (the reference loops in Python over each group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.operators.aggregates import count_if, count_rows, exact_ratio_sql
from civitas.operators.quantiles import exact_quantiles


def join_group_stat_back(df: DataFrame, stats: DataFrame, group: Sequence[str],
                         how: str = "inner") -> DataFrame:
    """Rows with their group's statistics; the null group is a group."""
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    renamed = stats.withColumnsRenamed({g: f"__g_{g}" for g in group})
    return df.join(renamed, same, how).drop(*[f"__g_{g}" for g in group])


def outlier_iqr(df: DataFrame, group: Sequence[str], value: str, min_n: int = 4,
                k: float = 1.5, quantile_method: str = "nearest") -> DataFrame:
    """Rows above Q3 + k*IQR of their group (groups with >= ``min_n`` rows),
    with the group median, the limit and the deviation from the median.
    Q1/Q3 use ``quantile_method`` (the reference's frame library defaults to
    nearest-rank); the median is the interpolated one."""
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75],
                        [quantile_method, "linear", quantile_method],
                        names=["q1", "mediana_grupo", "q3"])
    stats = (q.where(F.col("n") >= min_n)
               .withColumn("limite_iqr", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))))
    return (join_group_stat_back(df, stats, group)
              .where(F.col(value) > F.col("limite_iqr"))
              .withColumn("desvio_mediana", F.col(value) - F.col("mediana_grupo")))


def salary_distribution(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Five-number summary per group instead of shipping every row to a box plot."""
    return exact_quantiles(df, group, value, [0.0, 0.25, 0.5, 0.75, 1.0], "linear",
                           names=["minimo", "q1", "mediana", "q3", "maximo"])


def outlier_median_ratio(df: DataFrame, group: Sequence[str], value: str,
                         ratio: float = 3.0) -> DataFrame:
    """Rows whose value is more than ``ratio`` times their group median.
    Runs on all rows (the reference first caps the input at 5000 rows)."""
    med = exact_quantiles(df, group, value, [0.5], "linear", names=["mediana_cat"],
                          with_count=False)
    return (join_group_stat_back(df, med, group, "left")
              .withColumn("razao_mediana", F.col(value) / F.col("mediana_cat"))
              .where(F.col("razao_mediana") > ratio))


def presence_scorecard(votes: DataFrame, member: Sequence[str]) -> DataFrame:
    """Vote totals per member and both presence rates: the Senate's (not
    absent) and the Chamber's (any of yes / no / present-without-vote)."""
    a, n = F.col("voto_afirmativo"), F.col("voto_negativo")
    p, aus = F.col("presente_sem_voto"), F.col("ausente")
    # round(100 * x / n, 1), computed exactly (integer division, half up)
    present = exact_ratio_sql("sum(case when not ausente then 1 else 0 end) * 100", "count(*)", 1, 0)
    any_flag = exact_ratio_sql(
        "sum(case when voto_afirmativo or voto_negativo or presente_sem_voto then 1 else 0 end)"
        " * 100", "count(*)", 1, 0)
    return votes.groupBy(*member).agg(
        count_rows().alias("total_votacoes"),
        F.sum(F.when(a, 1).otherwise(0)).cast("bigint").alias("total_sim"),
        F.sum(F.when(n, 1).otherwise(0)).cast("bigint").alias("total_nao"),
        F.sum(F.when(p, 1).otherwise(0)).cast("bigint").alias("total_abstencao"),
        F.sum(F.when(aus, 1).otherwise(0)).cast("bigint").alias("total_ausente"),
        F.expr(present).alias("taxa_presenca"),
        F.expr(any_flag).alias("taxa_presenca_qualquer"))


def deliberation_timeline(votes: DataFrame, bill: Sequence[str], session: str,
                          session_date: str, result: str, yes: str, no: str) -> DataFrame:
    """Two-level aggregate: vote rows -> one row per session (repeated session
    attributes collapsed by max) -> one row per bill with first/last session,
    span in days, final result (at the latest session, ties broken by the
    session id), largest yes/no counts and their margin."""
    sessions = votes.groupBy(*bill, session).agg(
        F.max(session_date).alias("data_sessao"),
        F.max(result).alias("resultado"),
        F.max(yes).alias("votos_sim"),
        F.max(no).alias("votos_nao"))
    known = F.lit(True)
    for b in bill:
        known = known & F.col(b).isNotNull()
    return (sessions.where(known)
            .groupBy(*bill).agg(
                # one row per (bill, session) after the first level, so a
                # plain count is the distinct count (no Expand)
                F.count(session).cast("bigint").alias("num_sessoes"),
                F.min("data_sessao").alias("primeira_sessao"),
                F.max("data_sessao").alias("ultima_sessao"),
                F.datediff(F.max("data_sessao"), F.min("data_sessao")).alias("dias_deliberacao"),
                F.max_by("resultado", F.struct("data_sessao", session)).alias("resultado_final"),
                F.max("votos_sim").alias("max_sim"),
                F.max("votos_nao").alias("max_nao"),
                F.abs(F.max("votos_sim") - F.max("votos_nao")).alias("margem")))


def timeline_summary(timeline: DataFrame, kind: str, id_col: str, min_n: int = 5) -> DataFrame:
    """Per kind (with at least ``min_n`` bills): count, mean/median/max days,
    multi-session count, plus the spotlight rows (longest bill; fastest bill
    among multi-session ones) as argmax/argmin in the same pass."""
    days = F.col("dias_deliberacao")
    multi = F.col("num_sessoes") > 1
    base = timeline.groupBy(kind).agg(
        count_rows().alias("num_materias"),
        F.expr(exact_ratio_sql("sum(dias_deliberacao)", "count(dias_deliberacao)", 1, 0))
        .alias("media_dias"),
        F.max(days).alias("max_dias"),
        count_if(multi).alias("multi_sessao"),
        F.max_by(F.col(id_col), F.struct(days, -F.col(id_col))).alias("mais_demorada"),
        F.min_by(F.when(multi, F.col(id_col)),
                 F.struct(~multi, days, F.col(id_col))).alias("mais_rapida_multi"))
    med = exact_quantiles(timeline, [kind], "dias_deliberacao", [0.5], "linear",
                          names=["mediana_dias"], with_count=False)
    return join_group_stat_back(base.where(F.col("num_materias") >= min_n), med, [kind], "left")


def divisive(timeline: DataFrame, id_col: str, max_margin: int = 10, n: int = 30) -> DataFrame:
    """Close votes: margin <= ``max_margin`` with both counts present, the
    ``n`` smallest margins (bill id breaks ties)."""
    close = timeline.where(F.col("margem").isNotNull() & (F.col("margem") <= max_margin)
                           & F.col("max_sim").isNotNull() & F.col("max_nao").isNotNull())
    return close.orderBy(F.col("margem").asc(), F.col(id_col).asc()).limit(n)


def kpis_latest_period(df: DataFrame, period_cols: Sequence[str],
                       aggs: Sequence[Column]) -> DataFrame:
    """payroll_kpis: scalars for the latest (year, month).  The latest pair is
    a global max (one row); the fact is semi-joined to it and aggregated."""
    from civitas.operators.link import semi_latest_period
    latest = semi_latest_period(df, period_cols)
    return latest.groupBy(*period_cols).agg(*aggs)
