"""Ids against the library itself, cuts at safe places, exact round trips, defined cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from civitas.llm import queries, rank_bpe
from conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=rank_bpe.read_ranks(DATA), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return rank_bpe.RankCodec(DATA)


ODD = ["", " ", "\n\n  x", "a  b", "it's we'll I'd 'S", "<|endoftext|>", "naïve Straße été",
       "日本語テスト", "😀😀 a", "x" * 700, "\x00\x1c\x1d\x85\u00a0\u2028 z", "a\u0301b", "!!!***###",
       "\t\tif x:\r\n", " \u3000\u2003x", "\u200b \ufeff"]


def _texts(seed, n, longest):
    rng = random.Random(seed)
    letters = "ab é日'1½! \n\t\u00a0\u2003\x1c😀"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]


def _ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pattern_is_the_vocabularys():
    assert rank_bpe.PATTERN == public_tokenizers.PATTERN


def test_same_ids_as_the_library(codec, library):
    for t in ODD + _texts(1, 300, 80):
        got = codec.encode(t)
        assert _ids(got) == library.encode_ordinary(t)
        assert codec.decode(got) == t.encode()


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_cuts_change_no_id(codec, library, size, monkeypatch):
    monkeypatch.setattr(rank_bpe, "_LONG_RUN", rank_bpe.re.compile(f"[{rank_bpe.SPACE}]{{3,}}"))
    for t in ODD + _texts(size, 200, 120):
        parts = list(rank_bpe.pieces(t, size))
        assert "".join(p for p, _ in parts) == t
        assert [i for p, _ in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(t)


def test_very_long_texts(codec, library):
    word = "the quick brown fox's 42 jumps.\n" * 8_000
    assert len(list(rank_bpe.pieces(word))) > 1
    assert _ids(codec.encode(word)) == library.encode_ordinary(word)
    for t in (" " * 2_000_000, "a" + "\n" * 1_500_000 + " b", "x" * 400_000, "é!" * 100_000):
        got = codec.encode(t)
        assert codec.decode(got) == t.encode()
    run = "a" + " " * 20_000 + "b"
    assert _ids(codec.encode(run)) == library.encode_ordinary(run)


def test_raw_bytes_and_unknown_ids(codec, library):
    whole = library.encode_ordinary("日")
    assert codec.decode(np.array(whole[:1], "<u4").tobytes()) == library.decode_bytes(whole[:1])
    assert codec.decode(np.array([50256, 50257, 2 ** 32 - 1, 64], "<u4").tobytes()) == b"a"


def test_defined_cases(spark):
    ranks = rank_bpe.publish(spark, PATH)
    docs = spark.createDataFrame([(1, None, "x", 1), (1, "a b", "y", 2), (1, "a b", "y", 2),
                                  (None, "", "z", 3)], "doc_id long, text string, ids string, bytes int")
    out = rank_bpe.decode(rank_bpe.encode(docs, "doc_id", "text", ranks), "doc_id", ranks)
    assert out.columns == ["doc_id", "ids", "bytes"]
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in out.collect()), key=repr)
    two = np.array([64, 275], "<u4").tobytes()
    assert got == sorted([(1, b"", b""), (1, two, b"a b"), (1, two, b"a b"), (None, b"", b"")], key=repr)
    assert rank_bpe.encode(docs.limit(0), "doc_id", "text", ranks).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(rank_bpe.decode(none, "doc_id", ranks).first().bytes) == b""


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        text = r.text or ""
        ids = library.encode_ordinary(text)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    got = queries.QUERIES["op11_rank_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == want
