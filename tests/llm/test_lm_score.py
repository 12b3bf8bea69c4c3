"""Scores by brute force, gradients, held-out likelihood, defined cases."""

import math
import random

import numpy as np

from civitas.llm import lm_score as lm
from civitas.llm import queries
from civitas.llm.common import most_frequent
from civitas.llm.words import word_hashes
from conftest import SF_SMALL

NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def brute(net, ids):
    """Sum over all words of log P(word | neighbours), the plain way."""
    total = 0.0
    for t, w in enumerate(ids):
        h = net.bias.astype(float).copy()
        for p, d in enumerate(lm.offsets()):
            near = ids[t + d] if 0 <= t + d < len(ids) else lm.PAD
            h += net.embed[p][near]
        h = np.tanh(h)
        c, k = divmod(int(w), lm.SIDE)
        for x, at in ((h @ net.out_class + net.class_bias, c),
                      (h @ net.out_word[c] + net.word_bias[c], k)):
            total += x[at] - math.log(np.exp(x).sum())
    return total


def test_scores_equal_brute_force(monkeypatch):
    monkeypatch.setattr(lm, "TOKENS", 7)
    net = lm.Net.start()
    texts = ["", "a", "a b", "one two three four five six seven eight nine ten", "..."]
    n, got = lm.score_texts(texts, net, *NONE)
    ids = [lm.word_ids(word_hashes(t), *NONE) for t in texts]
    assert n.tolist() == [len(x) for x in ids]
    assert np.allclose(got, [brute(net, x) for x in ids], atol=1e-3)


def test_probabilities_sum_to_one():
    net, near = lm.Net.start(), np.array([[1, 2, 3, lm.PAD]])
    every = np.arange(lm.SIDE * lm.SIDE)
    p = np.exp(net.log_p(np.repeat(near, len(every), 0), every).astype(float))
    assert abs(p.sum() - 1) < 1e-4


def test_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    net = lm.Net.start()
    near, word = rng.integers(0, 50, (256, 4)), rng.integers(0, 50, 256)
    before = net.log_p(near, word).mean()
    for _ in range(30):
        net.step(near, word)
    assert net.log_p(near, word).mean() > before + 0.5


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[(s + 3 * j) % 60] for j in range(40)))
            for i, s in ((i, rng.randrange(60)) for i in range(n))]


def test_learns_word_order_and_any_partitioning_agrees(spark):
    df = spark.createDataFrame(corpus(900, 1), "doc_id long, text string")
    docs = df.selectExpr("doc_id as id", "text")
    words = lm.vocabulary_of(docs)
    a, b = (lm.train(x, *words) for x in (docs.repartition(7), docs.coalesce(1)))
    assert (a.flat() == b.flat()).all()
    rng = random.Random(2)
    held = [t for _, t in corpus(50, 3)]
    mixed = [" ".join(rng.sample(t.split(), 40)) for t in held]
    good, bad = (lm.score_texts(x, a, *words)[1].mean() / 40 for x in (held, mixed))
    assert good > bad + 0.3 and good > -math.log(lm.SIDE ** 2) + 2


def test_vocabulary_is_full_at_ties_and_counts_every_row(spark):
    df = spark.createDataFrame([(i, " ".join(f"v{i}_{j}" for j in range(100))) for i in range(30)]
                               + [(100 + i, "often") for i in range(2)], "id long, text string")
    words, _ = lm.vocabulary_of(df.repartition(16))
    other, _ = lm.vocabulary_of(df.coalesce(1))
    assert len(words) == lm.VOCABULARY and (words == other).all()
    assert word_hashes("often")[0] in words


def test_most_frequent_takes_the_largest_counts(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 2, 3, 900, 901, 905, 960, 5000])) for i in range(2000)]
    df = spark.createDataFrame(rows, "word long, n long")
    for size in (0, 1, 300, 1999, 2000, 3000):
        got = sorted((r.n for r in most_frequent(df, size).collect()), reverse=True)
        assert got == sorted((n for _, n in rows), reverse=True)[:size]


def test_every_short_text_is_trained_on(spark):
    start = lm.Net.start().flat()
    for i in range(4):
        docs = spark.createDataFrame([(i, f"short{i} text")], "id long, text string")
        assert np.abs(lm.train(docs, *NONE).flat() - start).max() > 1e-5


def test_query_covers_all_rows(spark):
    out = queries.op9_lm_score(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.n_words for r in out} == {
        i: len(word_hashes(t or "")) for i, t in docs.items()}
    assert all(r.score < 0 for r in out if r.n_words)


def test_operator_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "a b", 0), (2, "a b", 0), (None, "a b", 0), (3, "?", 0)],
                               "doc_id long, text string, score int")
    got = lm.pseudo_likelihood(df, "doc_id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.n_words, r.score, r.mean))
    assert by[1] == [(0, 0.0, None)] and by[3] == [(0, 0.0, None)]
    assert by[2][0] == by[2][1] == by[None][0] and by[2][0][1] < 0
    assert lm.pseudo_likelihood(df.where("false"), "doc_id", "text").count() == 0


def test_pieces_of_long_texts_know_their_neighbours():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, lm.PAD, n) for n in (0, 5, 900, 1, 37, 2)]
    near, word = lm.windows(ids)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    for size in (1, 2, 7, 100, 10_000):
        parts = list(lm.window_blocks(ids, size))
        assert max(len(w) for *_, w in parts) <= 2 * size + 40 if size > 30 else True
        got = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(got[0], kind="stable")
        assert (got[0][order] == owner).all() and (got[1][order] == near).all() and (got[2][order] == word).all()


def test_one_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(40)}" for _ in range(200_000))
    net, words, number = lm.Net.start(), np.zeros(0, lm.U), np.zeros(0, np.int64)
    n, total = lm.score_texts([long, "w1 w2", ""], net, words, number)
    near, word = lm.windows([lm.word_ids(lm.word_hashes(long), words, number)])
    assert n.tolist() == [200_000, 2, 0] and abs(total[0] - net.log_p(near, word).sum()) < 1.0 and total[2] == 0
