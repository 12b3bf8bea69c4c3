"""SQL fragments shared by the oracles (the DuckDB spelling of library
expressions)."""

from civitas.functions.text import NAME_ACCENTS_FROM, NAME_ACCENTS_TO


def norm_sql(c: str) -> str:
    """normalize_name_sql in DuckDB SQL."""
    return (f"upper(trim(replace(replace(replace(translate(coalesce({c}, ''), "
            f"'{NAME_ACCENTS_FROM}', '{NAME_ACCENTS_TO}'), '.', ''), '-', ' '), '  ', ' ')))")


def money_sum(c: str) -> str:
    return f"cast(sum(cast({c} as decimal(18,2))) as double)"


def avg4(c: str, digits: int = 4, scale: int = 2, zero_null: bool = False) -> str:
    from civitas.operators.aggregates import avg_exact_sql
    return avg_exact_sql(c, digits, scale, "duckdb", zero_null)
