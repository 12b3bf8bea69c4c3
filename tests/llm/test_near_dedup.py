"""Classes against all pairs by brute force, keys, alignment, defined cases."""

import random
import re
from itertools import combinations

import numpy as np

from civitas.llm import near_dedup as nd
from civitas.llm import queries
from civitas.llm.components import components
from civitas.llm.words import occurrences, shingles, word_hashes
from conftest import SF_SMALL


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union_find(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    """class id (smallest id) per row, by all pairs of texts."""
    sets = [shingle_set(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    maybe = {p for v in by.values() for p in combinations(v, 2)}
    links = [(a, b) for a, b in maybe
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12]
    same = {}
    for i, (_, t) in enumerate(rows):
        links.append((same.setdefault(t or "", i), i))
    roots = union_find(links, len(rows))
    least = {}
    for i, (ident, _) in enumerate(rows):
        least[roots[i]] = min(least.get(roots[i], ident), ident)
    return {(ident, least[roots[i]]) for i, (ident, _) in enumerate(rows)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.3:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
        elif kind < 0.5:
            words = passage[:rng.randrange(40, 60)] + [rng.choice(vocab) for _ in range(rng.randrange(80))]
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 9, 12, 25, 30, 200]))]
        rows.append((i, " ".join(words)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus(11, 500) + [(900, ""), (901, ""), (902, None), (903, "..."), (904, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.class_id) for r in nd.near_classes(df, "doc_id", "text").collect()}
    assert got == brute(rows)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {(r.doc_id, r.class_id) for r in queries.op5_near_dedup(spark, SF_SMALL).collect()}
    assert got == brute(rows)


def test_one_large_group_of_near_copies_and_chains(spark):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(300):  # near copies of one text
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    long = [f"c{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(long[i * 6:i * 6 + 150])) for i in range(40)]  # a chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = nd.near_classes(df, "doc_id", "text").collect()
    assert {(r.id, r.class_id) for r in out} == brute(rows)
    assert {r.class_size for r in out} == {300, 40}


def test_keys_recall_grows_with_similarity():
    rng = random.Random(1)
    base = [f"a{i}" for i in range(300)]
    hits = 0
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(300), 6):  # similarity about 0.82
            w[at] = f"n{rng.random()}"
        hits += bool(np.isin(nd.bucket_keys(" ".join(base))[0], nd.bucket_keys(" ".join(w))[0]).any())
    assert hits == 200


def test_order_keys_keep_the_text_order():
    """Keys of a sequence and of its reverse differ, those of the moved route do not;
    both find nearly all texts with small edits, only the second those with
    shuffled paragraphs."""
    rng = random.Random(6)
    x = np.array([rng.getrandbits(63) for _ in range(200)], nd.U)
    assert not set(nd.order_min_hash(x, 5, moved_blocks=False)) & set(nd.order_min_hash(x[::-1], 5, moved_blocks=False))
    both, back = nd.order_min_hash(x, 5), nd.order_min_hash(x[::-1], 5)
    assert set(both) & set(back) == set(both[nd.BANDS:]) == set(back[nd.BANDS:])
    found = {"edit": 0, "move": 0, "move, both": 0}
    meet = lambda a, b, m: bool(np.isin(nd.bucket_keys(" ".join(a), moved_blocks=m)[0],
                                        nd.bucket_keys(" ".join(b), moved_blocks=m)[0]).any())
    for _ in range(100):
        words = [f"q{rng.random()}" for _ in range(400)]
        edited = list(words)
        for at in rng.sample(range(400), 6):
            edited[at] = "zz"
        found["edit"] += meet(words, edited, False)
        turned = [w for i in range(9, -1, -1) for w in words[40 * i:40 * i + 40]]
        found["move"] += meet(words, turned, False)
        found["move, both"] += meet(words, turned, True)
    assert found["edit"] >= 99 and found["move"] < 90 and found["move, both"] == 100


def test_alignment_decides_without_the_moved_route(spark):
    words = [f"r{i}" for i in range(400)]
    turned = [w for i in range(9, -1, -1) for w in words[40 * i:40 * i + 40]]
    edited = [*words[:200], "new", *words[201:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(turned)), (3, " ".join(edited))],
                               "doc_id long, text string")
    classes = lambda **kw: {r.id: r.class_id for r in nd.near_classes(df, "doc_id", "text", **kw).collect()}
    assert classes(moved_blocks=False) == {1: 1, 2: 2, 3: 1}
    assert classes() == {1: 1, 2: 1, 3: 1}
    tested = spark.createDataFrame([(1, 0.9, 0.95), (2, 0.1, 0.95), (3, 0.1, 0.5)], "i int, aligned double, similarity double")
    assert {(r.i, r.route) for r in nd.links_of(tested, 0.8).collect()} == {(1, "order"), (2, "moved")}
    assert {r.i for r in nd.links_of(tested, 0.8, False).collect()} == {1}


def moved(rng, words, parts):
    size = -(-len(words) // parts)
    cut = [words[i:i + size] for i in range(0, len(words), size)]
    rng.shuffle(cut)
    return [w for x in cut for w in x]


def test_moved_paragraphs_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(240):
        words = [f"m{i}_{j}" for j in range((400, 400, 800)[i % 3])]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(moved(rng, words, (2, 10, 10)[i % 3])))]
    want = brute(rows)
    assert len({c for _, c in want}) < 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.class_id) for r in nd.near_classes(df, "doc_id", "text").collect()} == want


def test_words_equal_the_pattern():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("ab_1é .,-\n٣中ß") for _ in range(rng.randrange(40)))
        words = re.findall(r"\w+", t.lower())
        h = word_hashes(t).tolist()
        assert len(h) == len(words) and len(set(h)) == len(set(words))
        assert [h.index(x) for x in h] == [words.index(x) for x in words]
    x = np.array([5, 7, 5, 5, 7], np.uint64)
    assert occurrences(x).tolist() == [0, 0, 1, 2, 1]
    assert len(shingles(word_hashes("a b c"), 5)) == 1


def test_pieces_of_long_texts(monkeypatch):
    from civitas.llm import words
    t = " ".join(f"w{i}" for i in range(500))
    whole = word_hashes(t)
    monkeypatch.setattr(words, "CHUNK", 64)
    assert (word_hashes(t) == whole).all()
    monkeypatch.setattr(nd, "MATRIX", 100)
    assert len(nd.bucket_keys(t)[0]) == 2 * nd.BANDS        # both routes
    assert len(nd.bucket_keys(t, moved_blocks=False)[0]) == nd.BANDS


def test_alignment():
    a = np.arange(10, dtype=np.uint64)
    assert nd.similarity(a, a) == (1.0, 1.0)
    moved = np.concatenate([a[5:], a[:5]])
    got = nd.similarity(a, moved)
    assert got[1] == 1.0 and got[0] < 0.8
    assert nd.aligned(np.array([0, 1, 2, 3]), np.array([3, 0, 1, 2]), 9) == 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {(r.node, r.root) for r in components(df).collect()}
    roots = union_find([e for e in edges if e[0] != e[1]], 400)
    assert got == {(i, r) for i, r in enumerate(roots) if i != r}
    assert components(df.where("false")).count() == 0


def test_operator_cases(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (2, "a b c", 2), (2, "a b c", 3), (None, "z", 4)],
                               "doc_id long, text string, k1 int")
    got = sorted(((r.id or 0, r.class_id or 0, r.class_size)
                  for r in nd.near_classes(df, "doc_id", "text").collect()))
    assert got == [(0, 0, 1), (0, 2, 3), (2, 2, 3), (2, 2, 3)]
    assert nd.near_classes(df.where("false"), "doc_id", "text").count() == 0
