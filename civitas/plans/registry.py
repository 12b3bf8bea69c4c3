from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Output column types of the Spark plans where DuckDB's defaults are wider
# (year()/datediff() are BIGINT there, sums of counts HUGEINT): the oracle
# states the same types explicitly so schemas compare equal, values unchanged.
ORACLE_TYPES: dict[str, dict[str, str]] = {
    "q_dates": {"ano": "INTEGER"},
    "q_csv_roundtrip": {"ano": "INTEGER"},
    "q_csv_header_option": {"ano": "INTEGER"},
    "q_semi_latest": {"ano": "INTEGER", "mes": "INTEGER"},
    "q_agg_monthly": {"ano": "INTEGER"},
    "q_agg_phase": {"ano": "INTEGER"},
    "q_agg_contracts": {"ano_min": "INTEGER", "ano_max": "INTEGER"},
    "q_agg_two_level": {"ano": "INTEGER", "primeiro_periodo": "INTEGER",
                        "ultimo_periodo": "INTEGER"},
    "q_top_other": {"ano": "INTEGER"},
    "q_trend_join": {"ano": "INTEGER", "mes": "INTEGER"},
    "q_roster": {"ano_fim": "INTEGER"},
    "q_profile": {"ano": "INTEGER"},
    "q_months": {"dias": "BIGINT"},
    "q_load_stats": {"n_linhas": "BIGINT"},
    "q_top_filter": {"ano": "INTEGER"},
    "q_presence": {"total_sim": "BIGINT", "total_nao": "BIGINT", "total_abstencao": "BIGINT",
                   "total_ausente": "BIGINT"},
    "q_timeline": {"dias_deliberacao": "INTEGER"},
    "q_timeline_summary": {"max_dias": "INTEGER"},
    "q_divisive": {"dias_deliberacao": "INTEGER"},
    "q_upsert": {"periodo": "INTEGER", "ano": "INTEGER"},
    "q_upsert_strict": {"periodo": "INTEGER", "ano": "INTEGER"},
    "q_upsert_lookback": {"periodo": "INTEGER"},
    "q_upsert_files": {"ano": "INTEGER"},
    "q_distinct_rollup": {"ano": "INTEGER", "mes": "INTEGER"},
}


def register(name: str, sql: str | None = None):
    """Bind a query key to its Spark plan and (optionally) its SQL oracle."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            casts = ORACLE_TYPES.get(name)
            if casts:
                rep = ", ".join(f"cast({c} as {t}) as {c}" for c, t in casts.items())
                text = f"select * replace ({rep}) from (\n{text}\n) as q"
            ORACLES[name] = text
        return fn
    return deco
