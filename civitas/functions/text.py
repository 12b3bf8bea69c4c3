"""Name folding and blank handling."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitas.functions._util import col

# The accent replacements of the reference's name macro, as
# (accented, plain) pairs in its order.  Each pair is a single-character
# substitution, so one ``translate`` is equivalent to the chained replaces.
NAME_ACCENTS_FROM = "ãÃâÂáÁàÀéÉêÊèÈíÍîÎóÓôÔõÕúÚûÛçÇñÑ"
NAME_ACCENTS_TO = "aAaAaAaAeEeEeEiIiIoOoOoOuUuUcCnN"

# upper() of the German sharp s differs between engines: Java gives "SS", the
# reference's engine the capital sharp s.  Mapping it first keeps both equal.
_SHARP_S = ("ß", "ẞ")


HANGUL = range(0xAC00, 0xD7A4)  # syllables stay whole


def _compatibility_tables() -> tuple[str, str, dict[str, str]]:
    """Built from a rule, not typed in: for every code point what is left of its
    compatibility decomposition without marks; one character to one as a
    ``translate`` pair, the others (ligatures, fractions) as a map."""
    src, dst, longer = [], [], {}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if cp in HANGUL or 0xD800 <= cp < 0xE000 or unicodedata.combining(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch)
                       if not unicodedata.combining(c))
        if base == ch:
            continue
        if len(base) == 1 and cp < 0x10000 and ord(base) < 0x10000:
            src.append(ch)
            dst.append(base)
        else:
            longer[ch] = base
    return "".join(src), "".join(dst), longer


FOLD_FROM, FOLD_TO, FOLD_LONGER = _compatibility_tables()
MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)))


def upper_safe(c) -> Column:
    return F.upper(F.translate(col(c), _SHARP_S[0], _SHARP_S[1]))


def upper_trim(c) -> Column:
    return upper_safe(F.trim(col(c)))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def null_to_blank(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def normalize_name_sql(c) -> Column:
    """The SQL macro: fixed accent list, drop '.', '-' -> ' ', one pass of
    double-space -> single, trim, upper; null -> ''."""
    t = F.translate(F.coalesce(col(c), F.lit("")), NAME_ACCENTS_FROM, NAME_ACCENTS_TO)
    t = F.replace(t, F.lit("."), F.lit(""))
    t = F.replace(t, F.lit("-"), F.lit(" "))
    t = F.replace(t, F.lit("  "), F.lit(" "))
    return upper_safe(F.trim(t))


def normalize_name_nfkd(c) -> Column:
    """Python-side folding: trim, upper, compatibility decomposition, marks
    removed, white space runs to one space; null and blank give ''.
    One ``translate`` does single characters and drops marks.  A second one tells
    texts that hold ligatures and the like; each different one of these is then
    replaced in the whole text.  All steps look characters up by hash: a regex
    class of thousands of characters tries them one by one."""
    t = upper_safe(F.coalesce(col(c), F.lit("")))
    t = F.translate(t, FOLD_FROM + MARKS, FOLD_TO)
    table = F.from_json(F.lit(json.dumps(FOLD_LONGER)), "map<string,string>")

    def spelled(x: Column) -> Column:
        rest = F.translate(x, "".join(FOLD_LONGER), "")
        odd = F.array_except(F.split(x, ""), F.split(rest, ""))
        # what stands for one holds no other one, so the order does not matter
        whole = F.aggregate(odd, x, lambda text, ch: F.replace(text, ch, F.element_at(table, ch)))
        return F.when(F.char_length(rest) < F.char_length(x), whole).otherwise(x)

    # through an array of one, so that ``t`` is computed once
    once = F.element_at(F.transform(F.array(t), spelled), 1)
    return F.trim(F.regexp_replace(once, r"(?U)\s+", " "))
