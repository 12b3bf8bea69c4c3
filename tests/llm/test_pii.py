"""Base spans against the patterns by brute force; added spans; defined cases."""

import hashlib
import random
import re

from civitas.llm import pii, queries
from conftest import SF_SMALL

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def brute(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
          "card": lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d),
          "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return {k: [m.span() for m in re.finditer(p, t) if ok[k](m.group())]
            for k, p in PATTERNS.items()}


def test_base_spans_equal_the_patterns():
    rng, a = random.Random(3), pii.anchors()
    pieces = ["@", "+", ".", "-", " ", "(", ")", "a", "b_", "%", "1", "25", "256", "0", "é", "\n",
              "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "000", "٣", "@@", ".."]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        got = pii.find_spans(t, a)
        assert {k: got[k] for k in pii.BASE} == brute(t), t


def test_added_spans():
    t = "see HTTPS://a.b/c?d=1, IBAN: DE89 3704 0044 0532 0130 00 and account no 123456-78."
    got = pii.find_spans(t, pii.anchors())
    cut = {k: [t[a:b] for a, b in v] for k, v in got.items() if v}
    assert cut["url"] == ["HTTPS://a.b/c?d=1"]
    assert cut["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert cut["account"] == ["123456-78"]


def test_long_texts_are_linear():
    a = pii.anchors()
    for piece in ("a@", "1.", "1", "+1", "1 ", "account ", "http://"):
        pii.find_spans(piece * 200_000, a)


def test_operator_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "a@b.co", 0), (None, "a@b.co", 0), (2, "", 0)],
                               "doc_id long, text string, email int")
    got = pii.personal_data(df, "doc_id", "text").select("doc_id", pii.joined().alias("s")).collect()
    assert sorted((r.doc_id or 0, r.s) for r in got) == [(0, "email:0:6"), (1, ""), (2, ""),
                                                         (2, "email:0:6")]
    assert pii.personal_data(df.where("false"), "doc_id", "text").count() == 0


def test_query_equals_brute_force(spark):
    want = set()
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        b = brute(r.text or "")
        s = ",".join(f"{k}:{x}:{y}" for k in PATTERNS for x, y in b[k])
        want.add((r.doc_id, *map(len, b.values()), hashlib.sha256(s.encode()).hexdigest()))
    got = {tuple(r)[:6] for r in queries.op6_pii(spark, SF_SMALL).collect()}
    assert got == want
