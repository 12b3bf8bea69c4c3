"""Boolean parsing and vote-label flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitas.functions._util import col

# Vote labels of the two chambers (as written by the sources).
SENATE_YES, SENATE_NO = "Sim", "Não"
SENATE_ABSENT = ("AP", "LS", "MIS")
SENATE_PRESENT_NO_VOTE = ("P-NRV", "Abstenção")
CHAMBER_PRESENT_NO_VOTE = ("Abstenção", "Obstrução", "Artigo 17")
# Three-valued boolean words.
TRUE_WORDS = ("SIM", "S", "TRUE", "1")
FALSE_WORDS = ("NAO", "NÃO", "N", "FALSE", "0")


def flag_map(c, true_value: str = "S", false_value: str = "N") -> Column:
    """'S' -> true, 'N' -> false, anything else -> null (three-valued)."""
    v = F.trim(col(c))
    return F.when(v == true_value, F.lit(True)).when(v == false_value, F.lit(False))


def bool_parse_3(c) -> Column:
    v = F.upper(F.trim(col(c)))
    return F.when(v.isin(*TRUE_WORDS), F.lit(True)).when(v.isin(*FALSE_WORDS), F.lit(False))


def flag_prefix(c, prefix: str) -> Column:
    """``like 'PREFIX%'`` as a two-valued flag (null text -> false)."""
    return F.coalesce(col(c).startswith(prefix), F.lit(False))


def null_flag(c) -> Column:
    return col(c).isNotNull()


def vote_flags(label, yes=SENATE_YES, no=SENATE_NO, absent=SENATE_ABSENT,
               present_no_vote=SENATE_PRESENT_NO_VOTE) -> dict[str, Column]:
    """Two-valued flags (null label -> all false) named as in the marts."""
    v = F.trim(col(label))
    two = lambda c: F.coalesce(c, F.lit(False))
    return {
        "voto_afirmativo": two(v == yes),
        "voto_negativo": two(v == no),
        "ausente": two(v.isin(*absent)) if absent else F.lit(False),
        "presente_sem_voto": two(v.isin(*present_no_vote)),
    }
