"""Byte-level BPE encoding and decoding by the tiktoken library with a local
rank file.

1. The rank file (base64 token, rank; its path is a parameter) is read on the
   driver and broadcast: its size is that of the vocabulary, whatever the data.
   Each Python worker builds the library's encoder from it once.
2. A task encodes text by text.  A long text is cut where the split pattern ends
   a match whatever stands around: before white space that follows something
   else, and before the last white space of a long run.  The library's matcher
   fails on runs of some hundred thousand white spaces (its stack is bounded), so
   such a run, one match of the pattern, goes to an encoder without a pattern.
3. Decoding is an operator of its own: ids to raw bytes, which need not be valid
   UTF-8 when the ids are not those of a whole text.

Defined cases: null text is empty and has no ids; strings of special tokens are
ordinary text; ids without a rank decode to nothing; null ids decode to no
bytes.  Other columns, whatever their names, are left out; rows are kept one to
one, repeated rows and null ids of rows too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import text_or_empty

# The split pattern that belongs to the rank file.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")

PIECE = 100_000     # longer texts are cut into pieces of about so many characters
RUN = 10_000        # white spaces in a row that go past the pattern

# The characters of the pattern's \s (Unicode White_Space).
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) \
    + f"{chr(0x2000)}-{chr(0x200A)}"
_EDGE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")

_OPEN: dict[str, RankCodec] = {}


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match): encoding the pieces one after another
    gives the ids of the text."""
    if len(text) <= size:
        yield text, False
        return
    at = 0
    for run in _LONG_RUN.finditer(text):
        yield from _cut(text, at, run.start(), size)
        # before a non-space the last white space is matched on its own or with it
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start():at], True
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    while end - at > size:
        edge = _EDGE.search(text, at + size, end)
        to = edge.start() if edge else end
        yield text[at:to], False
        at = to
    if at < end:
        yield text[at:end], False


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class RankCodec:
    """The library's encoder for one rank file, in one Python worker."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        import tiktoken
        ranks = read_ranks(data)
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})
        self._plain = lambda: tiktoken.Encoding("piece", pat_str=r"(?s:.)+",
                                                mergeable_ranks=ranks, special_tokens={})
        self._one: object | None = None
        self._known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self._known[list(ranks.values())] = True

    def _match(self, piece: str) -> list[int]:
        if self._one is None:
            self._one = self._plain()
        return self._one.encode_ordinary(piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(
            np.array(self._match(p) if one else self._library.encode_ordinary(p), "<u4").tobytes()
            for p, one in pieces(text))

    def decode(self, ids: bytes) -> bytes:
        a = np.frombuffer(ids, "<u4")
        known = a < len(self._known)
        known[known] = self._known[a[known]]
        return self._library.decode_bytes(a[known].tolist())


def open_codec(data: bytes) -> RankCodec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _OPEN:
        _OPEN[key] = RankCodec(data)
    return _OPEN[key]


def publish(spark: SparkSession, path: str) -> Broadcast:
    """The rank file at ``path`` (on the driver), for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str, ranks: Broadcast) -> DataFrame:
    """id, ids: the token ids as little-endian unsigned 32-bit integers."""
    def per_task(batches):
        codec = open_codec(ranks.value)
        for b in batches:
            ids = [codec.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())],
                                             names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col).alias("text")) \
        .mapInArrow(per_task, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, id_col: str, ranks: Broadcast, ids_col: str = "ids") -> DataFrame:
    """id, ids, bytes: the bytes the ids stand for."""
    def per_task(batches):
        codec = open_codec(ranks.value)
        for b in batches:
            out = [codec.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=[id_col, "ids", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids")) \
        .mapInArrow(per_task, f"`{id_col}` {kind}, ids binary, bytes binary")
