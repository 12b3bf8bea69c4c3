"""Tax ids, sentinels and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitas.functions._util import col


def digits_only(c) -> Column:
    return F.regexp_replace(col(c), r"[^0-9]", "")


def doc_type(c) -> Column:
    """14 digits -> CNPJ, 11 -> CPF, anything else (null included) -> unknown."""
    d = digits_only(c)
    return (F.when(F.length(d) == 14, F.lit("CNPJ"))
             .when(F.length(d) == 11, F.lit("CPF"))
             .otherwise(F.lit("unknown")))


def doc_format(c) -> Column:
    """CPF ``NNN.NNN.NNN-NN``, CNPJ ``NN.NNN.NNN/NNNN-NN``, else the digits."""
    d = digits_only(c)
    return (F.when(F.length(d) == 11,
                   F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4"))
             .when(F.length(d) == 14,
                   F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$",
                                    "$1.$2.$3/$4-$5"))
             .otherwise(d))


def mask_sentinel(c, sentinels=("-4",)) -> Column:
    """Sentinel codes (``-4`` = not informed) -> null."""
    v = col(c)
    return F.when(F.trim(v.cast("string")).isin(*sentinels), F.lit(None)).otherwise(v)


def id_to_text(c) -> Column:
    """Integer id -> text id (ids are text everywhere); null -> ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def safe_int(c) -> Column:
    return col(c).try_cast("int")


def _parts(cols) -> list[Column]:
    # concat_ws skips nulls, which would make ('a', null, 'b') == ('a', 'b', null)
    return [F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]


def stable_id(prefix: str, *cols, sep: str = "|", length: int = 16) -> Column:
    """sha256 of ``prefix_`` + parts joined by ``sep``, first ``length`` hex
    chars: the same id for the same record on every run and partitioning."""
    raw = F.concat_ws(sep, *_parts(cols))
    if prefix:
        raw = F.concat(F.lit(prefix + "_"), raw)
    return F.substring(F.sha2(raw, 256), 1, length)


def surrogate_md5(*cols, sep: str = "|") -> Column:
    return F.md5(F.concat_ws(sep, *_parts(cols)))


def parse_identifier(c) -> tuple[Column, Column, Column]:
    """(type, number as text, year) of ``TYPE NUMBER/YEAR``: split at the first
    space, then at the slash; without a space all is the type; parts that are
    missing, or a year that is no number, are null."""
    text = col(c)
    space = F.instr(text, " ")
    kind = F.when(space > 0, F.substr(text, F.lit(1), space - 1)).otherwise(text)
    rest = F.when(space > 0, F.substr(text, space + 1)).otherwise(F.lit(""))
    part = lambda i: F.nullif(F.split_part(rest, F.lit("/"), F.lit(i)), F.lit(""))
    return F.nullif(kind, F.lit("")), part(1), part(2).try_cast("int")
