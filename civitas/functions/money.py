"""Locale money: Brazilian text ``1.234,56`` <-> numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitas.functions._util import col


def to_money(c, precision: int = 18, scale: int = 2) -> Column:
    """double -> exact decimal before any sum, so totals do not depend on the
    order in which partitions are added."""
    return col(c).cast(f"decimal({precision},{scale})")


def brl_to_decimal(c, precision: int = 12, scale: int = 2) -> Column:
    """Strict parse of ``1.234,56``: thousands dots dropped, comma as decimal
    point; anything unparsable is null (``try_cast``)."""
    txt = F.trim(col(c))
    cleaned = F.replace(F.replace(txt, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return cleaned.try_cast(f"decimal({precision},{scale})")


def brl_to_number_lenient(c, precision: int = 18, scale: int = 2) -> Column:
    """Lenient parse: strips every ``R``, ``$`` and space; only text containing a comma is
    read as locale-formatted (so ``5013.5`` stays 5013.5); bad text -> 0."""
    txt = F.regexp_replace(F.trim(col(c)), r"[R$\s]", "")
    locale = F.replace(F.replace(txt, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    parsed = F.when(txt.contains(","), locale).otherwise(txt)
    return F.coalesce(parsed.try_cast(f"decimal({precision},{scale})"),
                      F.lit(0).cast(f"decimal({precision},{scale})"))


def cap_value(c, cap: float = 1e10) -> Column:
    """Implausible amounts (above ``cap``) become null."""
    v = col(c)
    return F.when(v > F.lit(cap), F.lit(None)).otherwise(v)


def money_format(c, symbol: str = "R$ ", scale: str | None = None) -> Column:
    """``1234.5`` -> ``R$ 1.234,50``: format with grouping, then swap the two
    separators in one ``translate`` (both at once, so no placeholder).
    ``scale`` "B" or "M" gives billions with two digits, millions with one."""
    unit, digits, suffix = {None: (1, 2, ""), "B": (10 ** 9, 2, "B"), "M": (10 ** 6, 1, "M")}[scale]
    v = col(c) if scale is None else col(c) / F.lit(float(unit))
    return F.concat(F.lit(symbol), F.translate(F.format_number(v, digits), ",.", ".,"), F.lit(suffix))
