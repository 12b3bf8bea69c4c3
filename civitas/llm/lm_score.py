"""Masked pseudo-likelihood: a bidirectional window network, in numpy, predicts
every word of a document from its two neighbours on each side; the sum of the
conditional log-probabilities scores the document.

* Vocabulary: words are counted over all documents; the most frequent ``VOCABULARY`` words have
  ids, all others share ``UNKNOWN`` ids by their hash.
* Network: per neighbour position an embedding, summed, tanh; then two softmaxes,
  for the word's class and for the word in its class.
* Training: every word of every document is a target once.  Documents go to
  trainers by a hash as word ids, the number of trainers grows with the documents.
  Each trainer makes the windows, ``TOKENS`` places at a time, and runs SGD over
  them in hash order from common weights; the weights are averaged (sums of whole numbers: any partitioning gives the same).
* Scoring reads every word of every document.

Defined cases: null text is empty; a text without words has score 0 and a null
mean.  Beyond a document's ends neighbours are the padding id.  Rows are kept
one to one, repeated rows get equal scores; only the named columns are read.
With no words at all the model is its start; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.llm.common import most_frequent, text_or_empty
from civitas.llm.words import U, word_hashes
from civitas.session import materialize_table

SIDE = 48                        # classes, and words per class
UNKNOWN = 64
VOCABULARY = SIDE * SIDE - UNKNOWN
PAD = SIDE * SIDE
REACH = 2
HIDDEN = 24
DOCS_PER_TRAINER = 8_000
MAX_TRAINERS = 1_024
BATCH = 8_192
RATE = 0.5                       # of a row per 16 words it meets, of up to SHARE words a batch
SHARE = 64
RATE_CLASS = 1.0                 # of the class layer per batch
SCALE = 1 << 24
BLOCK = 4_096                    # weights per row when trainers are averaged
TOKENS = 1 << 15                 # words scored at once


def offsets() -> list[int]:
    return [d for d in range(-REACH, REACH + 1) if d]


@dataclass
class Net:
    embed: np.ndarray    # positions x (words + padding) x hidden
    bias: np.ndarray
    out_class: np.ndarray  # hidden x classes
    class_bias: np.ndarray
    out_word: np.ndarray   # classes x hidden x words
    word_bias: np.ndarray  # classes x words

    @classmethod
    def start(cls, seed: int = 7) -> "Net":
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return cls(small(2 * REACH, PAD + 1, HIDDEN), np.zeros(HIDDEN, np.float32),
                   small(HIDDEN, SIDE), np.zeros(SIDE, np.float32),
                   small(SIDE, HIDDEN, SIDE), np.zeros((SIDE, SIDE), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.out_class, self.class_bias, self.out_word,
                self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def from_flat(cls, x: np.ndarray) -> "Net":
        shapes = [a.shape for a in cls.start().arrays()]
        parts = np.split(x, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return cls(*[p.astype(np.float32).reshape(s) for p, s in zip(parts, shapes)])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = self.bias + self.embed[0][near[:, 0]]
        for p in range(1, 2 * REACH):
            h += self.embed[p][near[:, p]]
        return np.tanh(h, out=h)

    def log_p(self, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P(word | neighbours) per row."""
        h = self.hidden(near)
        cls, at = word // SIDE, word % SIDE
        out = _log_softmax_at(h @ self.out_class + self.class_bias, cls)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(SIDE + 1))
        for c in range(SIDE):
            rows = order[bounds[c]:bounds[c + 1]]
            if len(rows):
                out[rows] += _log_softmax_at(h[rows] @ self.out_word[c] + self.word_bias[c], at[rows])
        return out

    def step(self, near: np.ndarray, word: np.ndarray, part: float = 1.0) -> None:
        """One step of SGD on the mean loss of a batch (``part`` of a whole one).
        Words are taken class by class, so each class is a product of matrices."""
        h = self.hidden(near)
        n, cls, at = len(word), word // SIDE, word % SIDE
        g_class = _softmax(h @ self.out_class + self.class_bias)
        g_class[np.arange(n), cls] -= 1
        g_h = g_class @ self.out_class.T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(SIDE + 1))
        for c in range(SIDE):
            rows = order[bounds[c]:bounds[c + 1]]
            if not len(rows):
                continue
            g = _softmax(h[rows] @ self.out_word[c] + self.word_bias[c])
            g[np.arange(len(rows)), at[rows]] -= 1
            g_h[rows] += g @ self.out_word[c].T
            # rare rows are stepped by their own sum, not drowned in the batch
            rate = np.float32(part * RATE / 16 / max(1.0, len(rows) / SHARE))
            self.out_word[c] -= rate * (h[rows].T @ g)
            self.word_bias[c] -= rate * g.sum(axis=0)
        g_h *= 1 - h * h
        lr = np.float32(part * RATE_CLASS / n)
        self.out_class -= lr * (h.T @ g_class)
        self.class_bias -= lr * g_class.sum(axis=0)
        for p in range(2 * REACH):
            _add_rows(self.embed[p], near[:, p], g_h, -part * RATE / 16)
        self.bias -= lr * g_h.sum(axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _add_rows(to: np.ndarray, row: np.ndarray, value: np.ndarray, rate: float) -> None:
    """Adds to each row met the sum of its values times ``rate``, of more than
    ``SHARE`` values their mean ``SHARE`` times."""
    order = np.argsort(row.astype(np.int16), kind="stable")  # a radix sort
    r = row[order]
    new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    count = np.diff(np.concatenate([new, [len(r)]]))
    total = np.add.reduceat(value[order], new, axis=0)
    to[r[new]] += total * (rate / np.maximum(1.0, count / SHARE)).astype(np.float32)[:, None]


def word_ids(hashes: np.ndarray, vocabulary: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Ids of words; ``vocabulary`` is sorted, ``number`` has its ids."""
    other = VOCABULARY + (hashes & U(UNKNOWN - 1)).astype(np.int64)
    if not len(vocabulary):
        return other
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, number[at], other)


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours and words of all places of some documents, in order."""
    pad = np.full(REACH, PAD, np.int64)
    line = np.concatenate([x for one in ids for x in (pad, one)] + [pad])
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    place = np.arange(size.sum()) + np.repeat((np.arange(len(ids)) + 1) * REACH, size)
    near = np.stack([line[place + d] for d in offsets()], axis=1)
    return near, line[place]


def window_blocks(texts: Iterable[np.ndarray], size: int = TOKENS):
    """(number of the text of each place, neighbours, words) of texts' ids, about
    ``size`` places at a time; a longer text comes in pieces that know their
    neighbours."""
    block, at, held = [], [], 0
    for i, ids in enumerate(texts):
        if len(ids) > size:
            line = np.concatenate([np.full(REACH, PAD), ids, np.full(REACH, PAD)])
            for lo in range(0, len(ids), size):
                place = np.arange(lo, min(lo + size, len(ids))) + REACH
                yield (np.full(len(place), i), np.stack([line[place + d] for d in offsets()], axis=1),
                       line[place].astype(np.int64))
            continue
        block.append(ids)
        at.append(i)
        held += len(ids)
        if held >= size:
            yield np.repeat(at, [len(x) for x in block]), *windows(block)
            block, at, held = [], [], 0
    if block:
        yield np.repeat(at, [len(x) for x in block]), *windows(block)


def count_hashes(docs: DataFrame) -> DataFrame:
    """word (its hash), n over all texts."""
    def per_task(batches):
        keys, n = np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            new, m = np.unique(np.concatenate(
                [np.zeros(0, U), *(word_hashes(t.as_py()) for t in b.column(0))]), return_counts=True)
            every, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, m]), len(every)).astype(np.int64)
            keys = every
        yield pa.RecordBatch.from_pydict({"word": pa.array(keys.view(np.int64)),
                                          "n": pa.array(n)})

    return docs.select("text").mapInArrow(per_task, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = materialize_table(count_hashes(docs), "word-counts")
    top = sorted(((-r.n, r.word) for r in most_frequent(counts, VOCABULARY).collect()))
    words = np.array([w for _, w in top], np.int64).view(U)
    # neighbours in rank go to different classes, so classes are of like weight
    rank = np.arange(len(words))
    ids = np.sort((np.arange(VOCABULARY) % SIDE) * SIDE + np.arange(VOCABULARY) // SIDE)
    order = np.argsort(words)
    return words[order], ids[rank][order]


def coded(docs: DataFrame, vocabulary: np.ndarray, number: np.ndarray) -> DataFrame:
    """id, h (a hash of id and text), ids: the word ids, two bytes each, of docs
    (id, text)."""
    def per_task(batches):
        for b in batches:
            out = [word_ids(word_hashes(t.as_py()), vocabulary, number).astype("<i2").tobytes()
                   for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=["id", "h", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("id", "text").alias("h"), "text") \
        .mapInArrow(per_task, f"id {kind}, h long, ids binary")


def train(docs: DataFrame, vocabulary: np.ndarray, number: np.ndarray) -> Net:
    """The average of the trainers' networks over docs (id, text)."""
    return train_coded(coded(docs, vocabulary, number), docs.count())


def train_coded(rows: DataFrame, n: int) -> Net:
    """The same over the ``n`` rows of ``coded``."""
    trainers = min(MAX_TRAINERS, max(1, -(-n // DOCS_PER_TRAINER)))

    def fit(batches):
        net, seen = Net.start(), 0
        near, word = np.zeros((0, 2 * REACH), np.int64), np.zeros(0, np.int64)
        texts = (np.frombuffer(x.as_py(), "<i2").astype(np.int64)
                 for b in batches for x in b.column(b.schema.get_field_index("ids")))
        for _, more, words in window_blocks(texts):
            near, word = np.concatenate([near, more]), np.concatenate([word, words])
            at = len(word) // BATCH * BATCH
            for i in range(0, at, BATCH):
                net.step(near[i:i + BATCH], word[i:i + BATCH])
            near, word, seen = near[at:], word[at:], seen + at
        if len(word):
            net.step(near, word, len(word) / BATCH)
            seen += len(word)
        if seen:
            flat = np.rint(net.flat().astype(np.float64) * SCALE).astype("<i8")
            cut = [flat[i:i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(cut)), pa.int32()),
                                              "weights": pa.array(cut, pa.binary())})

    def mean(pdf):
        total = sum(np.frombuffer(x, "<i8") for x in pdf["weights"])
        out = np.rint(total / len(pdf)).astype("<i8").tobytes()
        return pdf.iloc[:1].assign(weights=[out])

    dealt = rows.select("h", "ids").withColumn("trainer", F.pmod(F.col("h"), F.lit(trainers)).cast("int")) \
        .repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "h")
    blocks = dealt.mapInArrow(fit, "block int, weights binary").groupBy("block") \
        .applyInPandas(mean, "block int, weights binary").collect()
    if not blocks:
        return Net.start()
    flat = np.concatenate([np.frombuffer(r.weights, "<i8") for r in sorted(blocks)])
    return Net.from_flat(flat / SCALE)


def score_ids(ids: list[np.ndarray], net: Net) -> np.ndarray:
    """Summed log-probabilities per text of word ids."""
    total = np.zeros(len(ids))
    for owner, near, word in window_blocks(x.astype(np.int64) for x in ids):
        total += np.bincount(owner, net.log_p(near, word).astype(np.float64), len(ids))
    return total


def score_texts(texts: list[str], net: Net, vocabulary: np.ndarray,
                number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probabilities) per text."""
    ids = [word_ids(word_hashes(t), vocabulary, number).astype(np.int16) for t in texts]
    return np.array([len(x) for x in ids], np.int64), score_ids(ids, net)


def pseudo_likelihood(df: DataFrame, id_col: str, text_col: str,
                      model: tuple[Net, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """id, n_words, score (the sum), mean per row."""
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    if model is None:  # the ids are written once, for training and scoring
        rows = materialize_table(coded(docs, *vocabulary_of(docs)), "word-ids")
        net = train_coded(rows, rows.count())
    else:
        net, rows = model[0], coded(docs, *model[1:])

    def per_task(batches):
        for b in batches:
            ids = [np.frombuffer(x.as_py(), "<i2") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(np.round(score_ids(ids, net), 3))], names=["id", "n_words", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.select("id", "ids").mapInArrow(per_task, f"id {kind}, n_words long, score double")
    return out.withColumn("mean", F.round(F.try_divide("score", "n_words"), 4))
