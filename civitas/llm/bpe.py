"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. The words of all documents are counted (one Spark aggregation); the
   ``lexicon_size`` most frequent ones go to the driver, a fixed bound.
2. They are compiled, with their ids as outputs, into a minimal acyclic
   automaton whose states share suffixes.  Every arc carries the number of
   words that sort before its continuations, so the sum along a path is the
   word's number, and its ids are a slice of one output table.
3. The automaton, the merge table and the token bytes are one flat file, which
   Spark copies to each executor once and tasks memory-map.
4. Each task splits its texts into words, looks new ones up in the automaton
   (all words of a block step together), merges the rest exactly, and keeps a
   bounded table of words seen.

The lexicon only saves merges: ids never depend on it.  Decoding maps ids to
bytes and is an operator of its own.

Defined cases: null text is empty and has no ids; a string of an added token in
a text is that token's id, as in the vocabulary file's own library; ids outside
the vocabulary decode to nothing; invalid UTF-8 decodes to U+FFFD.  Null ids
decode to the empty text.  All other columns are left out, rows are kept one to
one, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import most_frequent
from civitas.session import materialize_table

# The byte-level split pattern of the public vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")

LEXICON_SIZE = 65_536       # words compiled on the driver
MIN_TASK_COUNT = 4          # rarer words of a task are not proposed for the lexicon
WORDS_KEPT = 300_000        # entries of a task's word table before it starts anew
LONGEST_KEPT = 64           # longer words are merged each time
SHORT = 48                  # bytes up to which words are merged in batches
BLOCK_CHARS = 2_000_000     # texts are worked on in blocks of about this size


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[bytes]                          # by id
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, id)
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        ids, byte_of = j["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        added = {a["content"]: a["id"] for a in j["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        for text, i in added.items():
            tokens[i] = text.encode()
        merges = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[ids[a], ids[b]] = (rank, ids[a + b])
        return cls(tokens, merges, added)

    def byte_ids(self) -> list[int]:
        single = {t: i for i, t in reversed(list(enumerate(self.tokens))) if len(t) == 1}
        return [single[bytes([b])] for b in range(256)]


def merge_word(symbols: list[int], merges: dict) -> list[int]:
    """Repeatedly joins the pair of lowest rank, leftmost first."""
    if len(symbols) > SHORT:
        return _merge_long(symbols, merges)
    get = merges.get
    while len(symbols) > 1:
        best, at = None, -1
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            m = get(pair)
            if m is not None and (best is None or m < best):
                best, at = m, i
        if best is None:
            break
        symbols[at:at + 2] = [best[1]]
    return symbols


def _merge_long(symbols: list[int], merges: dict) -> list[int]:
    """The same with a heap and linked neighbours, n log n for long words."""
    n = len(symbols)
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    alive, heap = [True] * n, []

    def push(i: int) -> None:
        j = right[i]
        if j >= 0 and (m := merges.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(heap, (m[0], i, symbols[i], symbols[j], m[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], right[i] = new, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            push(left[i])
        push(i)
    return [s for s, ok in zip(symbols, alive) if ok]


NO_RANK = 1 << 30


class BatchMerger:
    """``merge_word`` for many words at once: one row per word, the ranks of its
    neighbouring pairs beside it; every round joins the best pair of each row."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int]):
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in merges.items())
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.keys, self.rank = table[:, 0].copy(), table[:, 1].copy()
        self.new = np.zeros(len(pairs), np.int64)
        self.new[table[:, 1]] = table[:, 2]
        self.byte_ids = np.array(byte_ids, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(a.shape, NO_RANK, np.int64)
        want = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (at least one byte) as little-endian 32 bits."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.searchsorted(length[order], [9, 13, 21, 49])):
            if len(group):
                self._merge_group([words[i] for i in group], length[group], group, out)
        return out

    def _merge_group(self, words, length, at, out) -> None:
        wide = int(length.max())
        symbols = np.full((len(words), wide + 1), -1, np.int32)
        inside = np.arange(wide + 1) < length[:, None]
        symbols[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), wide + 1), NO_RANK, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.ranks(symbols[:, :-1][pair], symbols[:, 1:][pair])
        column = np.arange(wide + 1)
        while len(at):
            best = ranks.argmin(axis=1)
            row = np.arange(len(at))
            rank = ranks[row, best]
            go = rank < NO_RANK
            if not go.all():
                self._emit(symbols[~go], length[~go], at[~go], out)
                symbols, ranks, length, at = symbols[go], ranks[go], length[go], at[go]
                best, rank, row = best[go], rank[go], np.arange(int(go.sum()))
            if not len(at):
                break
            take = np.minimum(column + (column > best[:, None]), wide)
            symbols = np.take_along_axis(symbols, take, 1)
            ranks = np.take_along_axis(ranks, take, 1)
            symbols[row, best] = self.new[rank]
            length = length - 1
            for left in (best, best - 1):
                ok = (left >= 0) & (left + 1 < length)
                r, c = row[ok], left[ok]
                ranks[r, c] = self.ranks(symbols[r, c], symbols[r, c + 1])
                ranks[row[~ok & (left >= 0)], left[~ok & (left >= 0)]] = NO_RANK

    @staticmethod
    def _emit(symbols, length, at, out) -> None:
        flat = symbols[np.arange(symbols.shape[1]) < length[:, None]].astype("<u4").tobytes()
        end = np.cumsum(length) * 4
        for i, a, b in zip(at.tolist(), (end - length * 4).tolist(), end.tolist()):
            out[i] = flat[a:b]


# ---- the lexicon ------------------------------------------------------------

class _Builder:
    """Incremental construction from sorted words: the states of the last word
    stay open, finished ones are replaced by an equal registered state."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[int, int], ...]] = []
        self.open: list[list] = [[False, []]]  # per depth: final, [(label, state)]
        self.word = b""

    def _state(self, node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in self.known:
            self.known[key] = len(self.final)
            self.final.append(node[0])
            self.arcs.append(key[1])
        return self.known[key]

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            node = self.open.pop()
            self.open[-1][1].append((self.word[len(self.open) - 1], self._state(node)))

    def add(self, word: bytes) -> None:
        same = len(os.path.commonprefix([self.word, word]))
        self._close(same)
        self.word = word
        self.open += [[False, []] for _ in range(len(word) - same)]
        self.open[-1][0] = True

    def finish(self) -> int:
        self._close(0)
        return self._state(self.open[0])


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arcs sorted by state and byte; ``skip`` adds up to the word's number."""
    b, order = _Builder(), sorted(words)
    for w in order:
        b.add(w)
    root = b.finish()
    n_words = [0] * len(b.final)  # a state's arcs lead to states made before it
    keys, target, skip = [], [], []
    for s, arcs in enumerate(b.arcs):
        n = int(b.final[s])
        for label, to in arcs:
            keys.append(s * 256 + label)
            target.append(to)
            skip.append(n)
            n += n_words[to]
        n_words[s] = n
    at = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [words[w] for w in order]
    return {"root": np.array([root], np.int64),
            "keys": np.array(keys, np.int64)[at], "target": np.array(target, np.int64)[at],
            "skip": np.array(skip, np.int64)[at],
            "final": np.array(b.final, np.int64),
            "out_at": np.cumsum([0, *map(len, ids)]).astype(np.int64),
            "out": np.array([i for x in ids for i in x], np.int64)}


def find_words(lex: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in the lexicon, -1 where it is not there."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    start = np.cumsum(length) - length
    state = np.full(n, lex["root"][0], np.int64)
    number, live = np.zeros(n, np.int64), np.arange(n)
    keys, last = lex["keys"], len(lex["keys"]) - 1
    if last < 0:
        live = live[:0]
        state[:] = -1
    for depth in range(int(length.max(initial=0))):
        live = live[length[live] > depth]
        if not len(live):
            break
        want = state[live] * 256 + flat[start[live] + depth]
        arc = np.minimum(np.searchsorted(keys, want), last)
        hit = keys[arc] == want
        state[live[~hit]] = -1
        live, arc = live[hit], arc[hit]
        state[live] = lex["target"][arc]
        number[live] += lex["skip"][arc]
    ok = state >= 0
    ok[ok] = lex["final"][state[ok]] == 1
    return np.where(ok, number, -1)


def _pack(vocab: Vocabulary, lex: dict[str, np.ndarray]) -> np.ndarray:
    """One int64 vector: the number of sections, their lengths, the sections."""
    pairs = sorted(vocab.merges.items(), key=lambda x: x[1])
    added = json.dumps(vocab.added).encode()
    parts = {**lex,
             "merge_a": np.array([a for (a, _), _ in pairs], np.int64),
             "merge_b": np.array([b for (_, b), _ in pairs], np.int64),
             "merge_id": np.array([m[1] for _, m in pairs], np.int64),
             "token_at": np.cumsum([0, *map(len, vocab.tokens)]).astype(np.int64),
             "token_bytes": np.frombuffer(b"".join(vocab.tokens), np.uint8).astype(np.int64),
             "byte_ids": np.array(vocab.byte_ids(), np.int64),
             "added": np.frombuffer(added, np.uint8).astype(np.int64)}
    assert list(parts) == SECTIONS
    return np.concatenate([[len(parts)], [len(p) for p in parts.values()], *parts.values()])


SECTIONS = ["root", "keys", "target", "skip", "final", "out_at", "out", "merge_a", "merge_b",
            "merge_id", "token_at", "token_bytes", "byte_ids", "added"]


class Codec:
    """What a task needs, over the memory-mapped file."""

    def __init__(self, flat: np.ndarray):
        import regex
        n = int(flat[0])
        ends = np.cumsum(flat[1:n + 1]) + n + 1
        part = {k: flat[e - size:e] for k, e, size in zip(SECTIONS, ends, flat[1:n + 1])}
        self.lex = {k: part[k] for k in SECTIONS[:7]}
        self.out = part["out"].astype("<u4").tobytes()
        self.out_at = (part["out_at"] * 4).tolist()
        merged = zip(part["merge_a"].tolist(), part["merge_b"].tolist(),
                     part["merge_id"].tolist())
        self.merges = {(a, b): (r, i) for r, (a, b, i) in enumerate(merged)}
        raw, at = part["token_bytes"].astype(np.uint8).tobytes(), part["token_at"].tolist()
        self.tokens = [raw[a:b] for a, b in zip(at, at[1:])]
        self.byte_ids = part["byte_ids"].tolist()
        self.batch = BatchMerger(self.merges, self.byte_ids)
        self.added = json.loads(part["added"].astype(np.uint8).tobytes())
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(
            self.added, key=lambda a: (-len(a), a))) + ")") if self.added else None
        self.words: dict[str, bytes] = {}

    def merged(self, word: bytes) -> bytes:
        ids = merge_word([self.byte_ids[b] for b in word], self.merges)
        return np.array(ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in new]
        found = find_words(self.lex, raw).tolist()
        out = {w: self.out[self.out_at[k]:self.out_at[k + 1]]
               for w, k in zip(new, found) if k >= 0}
        short = [(w, r) for w, r, k in zip(new, raw, found) if k < 0 and len(r) <= SHORT]
        out.update(zip([w for w, _ in short], self.batch.merge([r for _, r in short])))
        out.update((w, self.merged(r)) for w, r, k in zip(new, raw, found)
                   if k < 0 and len(r) > SHORT)
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            if self.cut is not None and self.cut.search(text):
                words = []
                for i, piece in enumerate(self.cut.split(text)):
                    words += [("", piece)] if i % 2 else self.split(piece)
            else:
                words = self.split(text)
            split.append(words)
        seen = set().union(*split)
        table = self.words
        added = [w for w in seen if type(w) is tuple]
        new = sorted(seen.difference(table, added))
        if len(table) + len(new) > WORDS_KEPT:
            table.clear()
            new = sorted(seen.difference(added))
        table.update(self.learn(new))
        for w in added:
            table[w] = np.array([self.added[w[1]]], "<u4").tobytes()
        get = table.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del table[w]
        return out

    def decode(self, ids: bytes) -> str:
        tokens, n = self.tokens, len(self.tokens)
        found = np.frombuffer(ids, "<u4")
        if len(found) and int(found.max()) >= n:
            found = found[found < n]
        return b"".join(map(tokens.__getitem__, found.tolist())).decode("utf-8", "replace")


_OPEN: dict[str, Codec] = {}


def open_codec(name: str) -> Codec:
    """The codec of a file that Spark has copied to this executor, once a process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Codec(np.load(SparkFiles.get(name), mmap_mode="r"))
    return _OPEN[name]


# ---- Spark ------------------------------------------------------------------

def count_words(df: DataFrame, text_col: str, min_task_count: int = MIN_TASK_COUNT) -> DataFrame:
    """word, n over all texts.  Words are runs between white space; a task
    proposes those it has met ``min_task_count`` times, so what is shuffled is
    the frequent part."""
    def per_task(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(t.as_py().split())
            if len(n) > 2_000_000:
                n = Counter({w: c for w, c in n.items() if c > 1})
        rows = [(w, c) for w, c in n.items() if c >= min_task_count and len(w) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.string()),
                                          "n": pa.array([c for _, c in rows], pa.int64())})

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(per_task, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text_col: str, size: int = LEXICON_SIZE) -> list[str]:
    counts = materialize_table(count_words(df, text_col), "word-counts")
    return sorted(r.word for r in most_frequent(counts, size).collect())


def lexicon_of(vocab: Vocabulary, words: list[str]) -> dict[bytes, list[int]]:
    """Ids of each frequent word as it stands in a text: pieces of the split
    pattern, the first also after a space."""
    import regex
    split = regex.compile(PATTERN).findall
    pieces = sorted({p.encode() for w in words for p in split(" " + w) + split(w)
                     if len(p) <= LONGEST_KEPT})
    ids = BatchMerger(vocab.merges, vocab.byte_ids()).merge(pieces)
    return {p: np.frombuffer(x, "<u4").tolist() for p, x in zip(pieces, ids)}


_SENT: dict[tuple[str, str], str] = {}


def publish(spark: SparkSession, vocab: Vocabulary, words: list[str]) -> str:
    """Compiles the lexicon and has Spark copy its file to every executor,
    also to those that start later; returns the file's name."""
    flat = _pack(vocab, compile_lexicon(lexicon_of(vocab, words)))
    name = f"bpe-{hashlib.sha256(flat.tobytes()).hexdigest()[:24]}.npy"
    sc = spark.sparkContext
    if (sc.applicationId, name) not in _SENT:
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="bpe-")), name)
        np.save(path, flat)
        sc.addFile(path)
        _SENT[sc.applicationId, name] = path
    return name


def _blocks(texts: list[str]):
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, id_col: str, text_col: str, codec: str) -> DataFrame:
    """id, ids: the token ids as little-endian unsigned 32-bit integers."""
    def per_task(batches):
        c = open_codec(codec)
        for b in batches:
            ids = [x for block in _blocks(b.column(1).to_pylist()) for x in c.encode_block(block)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(per_task, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, id_col: str, codec: str, ids_col: str = "ids") -> DataFrame:
    """id, ids, text."""
    def per_task(batches):
        c = open_codec(codec)
        for b in batches:
            text = [c.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string())],
                names=[id_col, "ids", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(per_task, f"`{id_col}` {kind}, ids binary, text string")


def n_tokens(ids_col: str = "ids"):
    return (F.octet_length(F.col(ids_col)) / 4).cast("long")
