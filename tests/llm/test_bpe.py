"""Ids against the public library, exact round trip, defined cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from civitas.llm import bpe, queries
from conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec(vocab):
    words = "the of and , . it's reading wonderful 1234 naïve".split()
    return bpe.Codec(bpe._pack(vocab, bpe.compile_lexicon(bpe.lexicon_of(vocab, words))))


ODD = ["", " ", "\n\n  x", "a  b", "it's we'll I'd 'S", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|>",
       "<|endoftext", "naïve Straße été", "日本語テスト", "😀😀 a", "x" * 700, "ab" * 400 + " " * 99,
       "\x00\x1c\x1d\x85\u00a0\u2028 z", "½ Ⅷ ² ३", "a\u0301b", "!!!***###", "\t\tif x:\r\n"]


def test_same_ids_as_the_library(codec, library):
    rng = random.Random(5)
    odd = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF),
                                         0x20, 0x0A])) for _ in range(rng.randrange(60)))
                 for _ in range(400)]
    got = codec.encode_block(odd)
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [codec.decode(g) for g in got] == odd


def test_decode_like_the_library(codec, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(
            ids, skip_special_tokens=False)


def test_long_and_short_merges_agree(vocab):
    rng, one = random.Random(7), vocab.byte_ids()
    for n in (1, 2, 17, 48):
        for _ in range(60):
            s = [one[rng.choice(b"theandio ")] for _ in range(n)]
            assert bpe.merge_word(list(s), vocab.merges) == bpe._merge_long(list(s), vocab.merges)


def test_batch_and_single_merges_agree(vocab):
    rng = random.Random(8)
    words = ["".join(rng.choice("theandio é") for _ in range(rng.randrange(1, 24))).encode()
             for _ in range(3000)]
    batch = bpe.BatchMerger(vocab.merges, vocab.byte_ids()).merge(words)
    one = vocab.byte_ids()
    assert [np.frombuffer(b, "<u4").tolist() for b in batch] == [
        bpe.merge_word([one[x] for x in w], vocab.merges) for w in words]


def test_lexicon_is_minimal_and_numbers_words():
    words = {b"tap": [1], b"taps": [2], b"top": [3], b"tops": [4], b"": [5], b"s": [6]}
    lex = bpe.compile_lexicon(words)
    assert len(lex["final"]) == 5  # p-s suffixes and the two vowels are shared
    found = bpe.find_words(lex, [b"top", b"to", b"tapsx", b"", b"taps", b"q"])
    order = sorted(words)
    assert [order[i] if i >= 0 else None for i in found] == [b"top", None, None, b"", b"taps", None]
    assert bpe.find_words(bpe.compile_lexicon({}), [b"a", b""]).tolist() == [-1, -1]


def test_operator_cases(spark, vocab):
    df = spark.createDataFrame([(1, None, "i"), (1, "a b", "i"), (None, "a b", "j"), (3, "", None)],
                               "doc_id long, text string, ids string")
    codec = bpe.publish(spark, vocab, bpe.frequent_words(df, "text"))
    out = bpe.decode(bpe.encode(df, "doc_id", "text", codec), "doc_id", codec).collect()
    assert sorted((r.doc_id or 0, r.text, len(r.ids)) for r in out) == [
        (0, "a b", 8), (1, "", 0), (1, "a b", 8), (3, "", 0)]
    empty = df.where("false")
    codec = bpe.publish(spark, vocab, bpe.frequent_words(empty, "text"))
    assert bpe.encode(empty, "doc_id", "text", codec).count() == 0


def test_query_equals_library(spark, library):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    enc = library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(r.doc_id, len(e.ids), sha(np.array(e.ids, "<u4").tobytes()),
             sha(library.decode(e.ids, skip_special_tokens=False).encode()))
            for r, e in zip(rows, enc)}
    got = {tuple(r) for r in queries.op10_bpe(spark, SF_SMALL).collect()}
    assert got == want


def test_most_frequent_is_bounded_and_takes_the_largest(spark):
    from civitas.llm.common import most_frequent
    df = spark.createDataFrame([(f"w{i}", 2 ** (i % 10)) for i in range(100)], "word string, n long")
    got = sorted(r.n for r in most_frequent(df, 35).collect())
    assert got == [64] * 5 + [128] * 10 + [256] * 10 + [512] * 10
    assert [r.n for r in most_frequent(df, 5).collect()] == [512] * 5
    assert most_frequent(df, 1000).count() == 100
    assert most_frequent(df.where("false"), 5).count() == 0
