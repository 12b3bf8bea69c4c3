"""Trigram search against the scan, fuzzy links against all pairs, quantile states
against full runs, statistics of null groups."""

import random

import pytest
from pyspark.sql import functions as F

from civitas.operators import fuzzy_link
from civitas.operators.analytics import outlier_iqr, outlier_median_ratio, timeline_summary
from civitas.operators.fuzzy_link import candidate_pairs, link_names, link_rates
from civitas.operators.quantiles import (exact_quantiles, merge_sketches, quantile_sketch,
                                         quantiles_of_counts, sketch_quantiles, value_counts)
from civitas.operators.trigram import build_trigram_index, scan_terms, search_trigrams
from civitas.session import work_dir


# ---- search -----------------------------------------------------------------

def test_texts_that_grow_in_lower_case_are_in_the_index(spark):
    df = spark.createDataFrame([(1, "\u0130a"), (1, "\u0130A"), (2, "ia")], "i int, a string")
    path = work_dir(spark, "trigram-grow")
    build_trigram_index(df, "i", ["a"], path)
    got = sorted(map(tuple, search_trigrams(df, path, "i", ["a"], ["i\u0307a"]).collect()))
    assert got == sorted(map(tuple, scan_terms(df, "i", ["a"], ["i\u0307a"]).collect()))
    assert [r[1] for r in got] == [1, 1]
    # a gram is a number and each row has its own postings
    assert dict(spark.read.parquet(f"{path}/postings").dtypes)["gram"] == "bigint"


def test_search_equals_the_scan(spark):
    rng = random.Random(5)
    letters = "abAB çÇé'%_\\😀\n"
    rows = [(rng.choice([None, i % 40]), rng.choice([None, "".join(rng.choice(letters) for _ in range(rng.randrange(30)))]),
             rng.choice(["", None, "Alpha beta", "ab"])) for i in range(200)]
    rows += [(900, "x" * 50_000 + "needle", None), (901, "İstanbul ΟΔΟΣ straße", "ﬁn")]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    path = work_dir(spark, "t-trigram")
    build_trigram_index(df, "i", ["a", "b"], path)
    terms = ["abA", "ABAB", "ça", "é", "", "a", "needle", "alpha BETA", "nothing here", "xxxx", "%_\\", "😀\na",
             "İst", "οδος", "STRASSE", "ﬁn", "abA"]
    terms += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    got = sorted(map(tuple, search_trigrams(df, path, "i", ["a", "b"], terms).collect()), key=repr)
    want = sorted(map(tuple, scan_terms(df, "i", ["a", "b"], terms).collect()), key=repr)
    assert got == want and ("needle", 900) in got and ("alpha BETA", None) in got
    one = scan_terms(df, "i", ["a", "b"], ["needle"]).collect()
    assert [tuple(r) for r in search_trigrams(df, path, "i", ["a", "b"], ["needle"]).collect()] == \
        [tuple(r) for r in one]
    assert search_trigrams(df, path, "i", ["a", "b"], []).count() == 0
    assert search_trigrams(df, path, "i", ["a", "b"], ["not in there"]).count() == 0


def test_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], "i long, a string")
    path = work_dir(spark, "t-trigram2")
    build_trigram_index(df, "i", ["a"], path)
    assert search_trigrams(df, path, "i", ["a"], ["abc", "a"]).count() == 0


# ---- fuzzy links ------------------------------------------------------------

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edit(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("ABC") + s[i:], s[:i] + rng.choice("ABC") + s[i + 1:]])


@pytest.mark.parametrize("d", [1, 2])
def test_candidates_are_all_pairs_within_the_distance(spark, d):
    rng = random.Random(d)
    short = 2 * (d + 1)
    right = {"".join(rng.choice("AB") for _ in range(rng.randrange(short, 11))) for _ in range(60)}
    left = {_edit(rng, _edit(rng, r)) for r in list(right) for _ in range(2)} | {"ABABABAB"}
    left = {x for x in left if len(x) >= short}
    got = {tuple(r) for r in candidate_pairs(spark.createDataFrame([(x,) for x in left], "l string"),
                                             spark.createDataFrame([(x,) for x in right], "r string"), d).collect()}
    assert got == {(x, y, _distance(x, y)) for x in left for y in right if _distance(x, y) <= d}


def test_a_name_is_cut_into_no_more_pieces_than_needed(spark):
    name = spark.createDataFrame([("ABCDEFGHIJKLMN",)], "l string")
    assert fuzzy_link.left_pieces(name, 2).count() == 19   # 75 with every piece shifted by up to 2


FIRST = "MARIA JOSE ANTONIO FRANCISCO CARLOS PAULO PEDRO LUCAS LUIZ MARCOS".split()
LAST = "SILVA SANTOS OLIVEIRA SOUZA RODRIGUES FERREIRA ALVES PEREIRA LIMA GOMES COSTA RIBEIRO".split()


def test_planted_misspellings_are_linked(spark):
    rng = random.Random(8)
    names = sorted({f"{'MARIA' if i % 3 == 0 else rng.choice(FIRST)} {rng.choice(FIRST)} {rng.choice(LAST)} "
                    f"{rng.choice(LAST)}" for i in range(400)})
    near = {a for a in names for b in names if a != b and abs(len(a) - len(b)) <= 4 and _distance(a, b) <= 4}
    reg = [(i, n) for i, n in enumerate(names)] + [(10_000, names[0].lower())]
    left, want = [], {}
    for i, n in enumerate(names):
        shape = i % 3
        written = n.title() if shape == 0 else _edit(rng, n) if shape == 1 else _edit(rng, _edit(rng, n))
        left.append((i, written))
        want[i] = (i, "exact" if shape == 0 else None)
    left += [(-1, None), (-2, "  "), (-3, "ANA"), (-4, "SOMEBODY ELSE ENTIRELY"), (0, names[0])]
    df = spark.createDataFrame(left, "k long, nome string")
    out = link_names(df, "nome", spark.createDataFrame(reg, "id long, n string"), "n", "id", hot=20)
    rows = out.collect()
    assert len(rows) == len(left)                                  # no fan-out
    got = {r.k: (r.linked_id, r.link_method, r.link_distance) for r in rows}
    assert all(got[k][1] is None for k in (-1, -2, -3, -4))
    assert all(got[i][:2] == want[i] for i in want if want[i][1] == "exact")
    clear = [i for i in want if want[i][1] is None and names[i] not in near and left[i][1] != names[i]]
    found = [i for i in clear if got[i][:2] == (i, "fuzzy")]
    assert len(clear) > 30 and len(found) >= 0.9 * len(clear)
    wrong = [i for i in clear if got[i][0] not in (None, i)]
    assert not wrong
    rates = link_rates(out.withColumn("g", F.lit("all")), ["g"]).first()
    assert rates.n == len(left)
    assert rates.rate_exact == round(sum(r.link_method == "exact" for r in rows) / len(left), 4)
    linked = [r.linked_id for r in rows if r.link_method == "fuzzy"]
    assert len(linked) == len(set(linked))


def test_ties_are_not_evidence(spark):
    reg = spark.createDataFrame([(1, "ABCDEFGH1"), (2, "ABCDEFGH2"), (3, "QRSTUVWXYZ")], "id long, n string")
    left = spark.createDataFrame([(1, "ABCDEFGH3"), (2, "QRSTUVWXY"), (3, "QRSTUVWXYA")], "k long, n string")
    got = {r.k: r.linked_id for r in link_names(left, "n", reg, "n", "id").collect()}
    assert got == {1: None, 2: None, 3: None}   # two registry names, and two left names, at distance 1
    assert link_names(left.limit(0), "n", reg, "n", "id").count() == 0
    assert {r.linked_id for r in link_names(left, "n", reg.limit(0), "n", "id").collect()} == {None}


def test_hot_pieces_are_dealt_over_salts(spark):
    left = spark.range(300).select(F.concat(F.lit("COMMON"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("l"))
    right = spark.createDataFrame([("COMMON000007",), ("COMMON999999",)], "r string")
    assert fuzzy_link.HOT == 1000
    a = sorted(map(tuple, candidate_pairs(left, right, 1, hot=10).collect()))
    b = sorted(map(tuple, candidate_pairs(left, right, 1, hot=10_000).collect()))
    assert a == b and ("COMMON000007", "COMMON000007", 0) in a


# ---- quantile states, null groups -------------------------------------------

def test_quantiles_after_three_loads_equal_a_full_run(spark):
    rng = random.Random(2)
    loads = [[(rng.choice(["a", "b", None]), rng.choice([None, round(rng.gauss(0, 9), 1)])) for _ in range(400)]
             + [("only null", None)] for _ in range(3)]
    path = work_dir(spark, "t-state")
    for rows in loads:
        value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").write.mode("append").parquet(path)
    probs, how = [0.0, 0.25, 0.5, 0.99], ["linear", "nearest", "linear", "higher"]
    got = quantiles_of_counts(spark.read.parquet(path), ["g"], probs, how).collect()
    every = spark.createDataFrame([r for rows in loads for r in rows], "g string, v double")
    want = exact_quantiles(every, ["g"], "v", probs, how).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 4
    empty = every.limit(0)
    assert quantiles_of_counts(value_counts(empty, ["g"], "v"), ["g"], probs).count() == 0


def test_sketches_of_loads_add_up(spark):
    df = spark.range(30_000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.col("id").alias("v"))
    parts = [quantile_sketch(df.where(F.col("id") % 2 == i), ["g"], "v") for i in (0, 1)]
    nothing = quantile_sketch(df.select(F.lit("none").alias("g"), F.lit(None).cast("long").alias("v")).limit(3), ["g"], "v")
    merged = merge_sketches(parts[0].unionByName(parts[1]).unionByName(nothing), ["g"])
    got = {r.g: (r.n, r.q500) for r in sketch_quantiles(merged, ["g"], [0.5]).collect()}
    assert got["true"][0] == 10_000 and abs(got["true"][1] - 15_000) < 600
    assert got["false"][0] == 20_000 and abs(got["false"][1] - 15_000) < 600
    assert got["none"] == (0, None)


def test_the_null_group_has_statistics(spark):
    rows = [(i, None if i < 20 else "a", 100.0 if i in (3, 30) else 1.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    assert {r.i for r in outlier_iqr(df, ["g"], "v").collect()} == {3, 30}
    assert {r.i for r in outlier_median_ratio(df, ["g"], "v").collect()} == {3, 30}
    bills = spark.createDataFrame([(i, None if i % 2 else "PL", i, 2) for i in range(20)],
                                  "id long, kind string, dias_deliberacao int, num_sessoes int")
    got = {r.kind: (r.num_materias, r.mediana_dias) for r in timeline_summary(bills, "kind", "id").collect()}
    assert got == {None: (10, 10.0), "PL": (10, 9.0)}
