"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, URL schemes and identifier cues.  A deterministic local parser
for each kind then expands from the anchor to the span's bounds and validates
it; no pattern is searched over the text.

Base kinds (ASCII classes, leftmost, not overlapping within a kind, a match that
fails its check is dropped and not retried):

* email: local part, ``@``, at least two dot-joined labels
* ip: four dot-joined digit runs, each at most 255
* card: digits with at most one space or hyphen between, 13 to 19 of them, Luhn
* phone: ``+``, a digit, a run of spaces, dots, brackets, hyphens and digits up
  to its last digit, 9 to 15 digits

Added kinds: url (scheme anchored), iban (cue or country shape, mod-97 checked),
account (digits after an account cue).  They have their own kinds, so base
spans are never changed by them.

Defined cases: null text is empty and has no spans.  Offsets are code points, the
end is exclusive.  Rows are kept one to one, repeated rows repeat their spans,
other columns are not read, an empty table gives no rows.  Time and memory are
linear in a text's length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

DIGITS = frozenset("0123456789")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | {"-"}
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\r\n<>\"'`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "a/c no", "iban", "konto", "cuenta", "compte")


def anchors():
    """Characters, schemes and cues in one automaton; the value is (parser, length)."""
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    for what, words in (("url", SCHEMES), ("account", CUES)):
        for w in words:
            for form in (w, w.upper(), w.capitalize()):
                a.add_word(form, (what, len(w)))
    a.make_automaton()
    return a


def run_end(t: str, i: int, allowed: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def email_at(t: str, at: int, floor: int):
    """The address around the at-sign; its local part starts at ``floor`` or later."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    end = run_end(t, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(t) and t[end] == "." and (to := run_end(t, end + 1, LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels else None


def ip_at(t: str, i: int):
    """(end of the shape, valid) for four dot-joined digit runs from ``i``;
    without the shape the end is that of the first run, where none can begin."""
    first = end = run_end(t, i, DIGITS)
    parts = [(i, end)]
    while len(parts) < 4:
        if end >= len(t) or t[end] != "." or (to := run_end(t, end + 1, DIGITS)) == end + 1:
            return first, False
        parts.append((end + 1, to))
        end = to
    values = [t[a:b].lstrip("0") for a, b in parts]
    return end, all(len(v) <= 3 and int(v or 0) <= 255 for v in values)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def card_at(t: str, i: int):
    """(end of the digit group, valid)."""
    n, end = len(t), i + 1
    while end < n:
        if t[end] in DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end - i > 37:  # 19 digits and 18 separators at most
        return end, False
    digits = t[i:end].replace(" ", "").replace("-", "")
    return end, 13 <= len(digits) <= 19 and luhn(digits)


def phone_at(t: str, plus: int):
    """(end of the shape or None, valid)."""
    if plus + 1 >= len(t) or t[plus + 1] not in DIGITS:
        return None, False
    end = run_end(t, plus + 2, PHONE)
    while end > plus + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4 or t[end - 1] not in DIGITS:
        return None, False
    return end, 9 <= sum(c in DIGITS for c in t[plus:end]) <= 15


def url_at(t: str, start: int, body: int):
    n, end = len(t), body
    while end < n and t[end] not in URL_END and not t[end].isspace():
        end += 1
    while end > body and t[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > body else None


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_at(t: str, after: int):
    """(kind, start, end) of the identifier behind a cue: joining characters, at
    most one "no" or "nr", then an IBAN or 6 to 20 digits with hyphens."""
    i, most = after, min(len(t), after + 12)
    while i < most and t[i] in " :#.=-":
        i += 1
    if t[i:i + 2].lower() in ("no", "nr"):
        i += 2
        while i < most and t[i] in " :#.=-":
            i += 1
    if t[i:i + 2].isupper():
        end = i
        while end < min(len(t), i + 42) and (t[end] in ALNUM or t[end] == " "):
            end += 1
        for stop in range(end, i + 14, -1):  # the longest valid one
            if t[stop - 1] in ALNUM and iban_ok(t[i:stop].upper()):
                return "iban", i, stop
    stop = i
    while stop < min(len(t), i + 40) and (t[stop] in DIGITS or t[stop] == "-"):
        stop += 1
    while stop > i and t[stop - 1] == "-":
        stop -= 1
    if 6 <= sum(c in DIGITS for c in t[i:stop]) <= 20 and t[stop:stop + 1] not in ALNUM:
        return "account", i, stop
    return None


def find_spans(t: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "digit"), 0)  # where each kind's search goes on
    for last, (what, length) in automaton.iter(t):
        if what == "email":
            if (s := email_at(t, last, done["email"])) is not None:
                out["email"].append(s)
                done["email"] = s[1]
        elif what == "phone":
            end, ok = phone_at(t, last)
            if ok:
                out["phone"].append((last, end))
        elif what == "digit":
            if last >= done["ip"]:
                end, ok = ip_at(t, last)
                if ok:
                    out["ip"].append((last, end))
                done["ip"] = end
            if last >= done["card"]:
                end, ok = card_at(t, last)
                if ok:
                    out["card"].append((last, end))
                done["card"] = end
        elif what == "url":
            start = last + 1 - length
            if start >= done["url"] and (s := url_at(t, start, last + 1)) is not None:
                out["url"].append(s)
                done["url"] = s[1]
        elif last + 1 >= done["account"] and (s := account_at(t, last + 1)) is not None:
            out[s[0]].append(s[1:])
            done["account"] = s[2]
    return out


SPANS = ", ".join(f"{k} array<struct<start:int,end:int>>" for k in KINDS)


def personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and, per kind, its spans in order."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def per_task(batches):
        automaton = anchors()
        for b in batches:
            found = [find_spans(x.as_py(), automaton) for x in b.column(1)]
            cols = [pa.array([[{"start": s, "end": e} for s, e in f[k]] for f in found],
                             pa.list_(span)) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *KINDS])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(per_task, f"`{id_col}` {kind}, {SPANS}")


def joined(kinds=KINDS):
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    def told(kind: str):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[told(k) for k in kinds]), ",")
