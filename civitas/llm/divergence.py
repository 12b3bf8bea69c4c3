"""Source divergence audit by in-mapper stripes.

Terms are runs of ASCII letters (in lower case) and non-ASCII characters.

1. Each task folds whole documents into stripes, one per language and term: in
   how many documents the term stands (document frequency) and how often in each
   source.  When a task holds ``SPILL`` entries it sends its stripes on and starts
   anew, so its memory does not grow with its input.
2. The stripes are dealt out and sorted by (language, term); partial stripes of a
   term are added up one after another, so a term that every task has seen needs
   the memory of one stripe.  Terms in fewer than ``min_docs`` documents go.
3. Group totals (N per source, V per language) follow from the kept stripes.
   These are dealt out by (language, block of sources, share of the terms), the
   language's totals first; every task turns its stripes straight into partial
   divergences: one sum per pair of sources, and the ``top`` terms per source.
4. Spark adds the sums up and ranks.

All arithmetic is in whole numbers: ``1 + floor(10**9 (count + 2) / (N + 2 V))``
by long division in steps of 1,000, so counts up to 9 * 10**15 are exact.

Defined cases: null text, language and source are ''; a source without terms has
probabilities from V alone; a language without kept terms has pairs of value 0
and no terms; a language with one source has no pairs; ties are ranked by the
item in byte order; repeated rows count as often as they stand; other columns,
whatever their names, are left out; an empty table gives no rows.

The sources of one language are held in one task and one row (their pairs are all
returned, so the result has the square of their number); a block holds at most
``CELLS`` pairs or one source's.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitas.llm.common import text_or_empty
from civitas.session import materialize_table

MIN_DOCS = 10
TOP = 10
ONE = 1_000_000_000
SPILL = 500_000             # entries of a task's stripes before they are sent on
CHUNK = 1 << 20             # bytes of a text folded at a time
CELLS = 1 << 20             # numbers of a dense block
SHARE = 4_096               # terms of a language that one share holds at least
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                   ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
DOCUMENTS = ""              # this term's stripe counts documents; no term is empty

# Bytes of terms in lower case; all others are spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


# ---- stripes ----------------------------------------------------------------

def terms_of(text: bytes):
    """Lists of the terms of a text in UTF-8, about ``CHUNK`` bytes at a time."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        to = folded.find(b" ", at + CHUNK)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


class Stripes:
    """The stripes of one task, as counters: how often each term stands in a
    (language, source), and in how many documents of a language."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.df: dict[str, Counter] = defaultdict(Counter)
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.entries = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        counts, df = self.counts[lang][source], self.df[lang]
        before = len(counts) + len(df)
        seen: set[bytes] = set()
        for terms in terms_of(text):
            counts.update(terms)
            seen.update(terms)
        df.update(seen)
        self.docs[lang][source] += 1
        self.entries += len(counts) + len(df) - before

    def batches(self, rows: int = 10_000):
        for lang, df in self.df.items():
            yield _stripe_batch([lang], [DOCUMENTS.encode()], [sum(self.docs[lang].values())],
                                [0, len(self.docs[lang])], pa.array(list(self.docs[lang]), pa.string()),
                                list(self.docs[lang].values()))
            place = {t: i for i, t in enumerate(df)}
            sources = list(self.counts[lang])
            at, of, n = [], [], []
            for i, c in enumerate(self.counts[lang].values()):
                at.append(np.fromiter(map(place.__getitem__, c), np.int64, len(c)))
                n.append(np.fromiter(c.values(), np.int64, len(c)))
                of.append(np.full(len(c), i))
            at, of, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, of, n))
            order = np.argsort(at, kind="stable")
            edge = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(df)))])
            of, n, terms, freq = of[order], n[order], list(df), list(df.values())
            names = pa.array(sources, pa.string())
            for i in range(0, len(terms), rows):
                j = min(i + rows, len(terms))
                lo, hi = edge[i], edge[j]
                yield _stripe_batch([lang] * (j - i), terms[i:j], freq[i:j], edge[i:j + 1] - lo,
                                    names.take(pa.array(of[lo:hi])), n[lo:hi])


def _stripe_batch(lang, terms, df, edge, sources: pa.Array, counts) -> pa.RecordBatch:
    edge = pa.array(edge, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
         pa.array(df, pa.int64()), pa.ListArray.from_arrays(edge, sources),
         pa.ListArray.from_arrays(edge, pa.array(counts, pa.int64()))],
        names=["lang", "term", "df", "sources", "counts"])


def partial_stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """The tasks' stripes of docs (lang, source, text), none of them null."""
    def per_task(batches):
        held = Stripes()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                          b.column(2).cast(pa.binary())):
                held.fold(lang, source, text.as_py())
                if held.entries >= spill:
                    yield from held.batches()
                    held = Stripes()
        yield from held.batches()

    return docs.select("lang", "source", "text").mapInArrow(per_task, STRIPE)


def _entries(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of all entries of the stripes: row, code of the source, its names, count."""
    row = np.repeat(np.arange(rows.num_rows),
                    pc.list_value_length(rows.column(3)).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(rows.column(3).flatten())
    return (row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.to_pylist(), rows.column(4).flatten().to_numpy(zero_copy_only=False))


def add_up(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes sorted by (language, term), those of one term added up."""
    n = rows.num_rows
    new = np.ones(n, bool)
    if n > 1:
        same = [pc.equal(rows.column(i).slice(1), rows.column(i).slice(0, n - 1)) for i in (0, 1)]
        new[1:] = ~pc.and_(*same).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    row, code, names, count = _entries(rows)
    key = (np.cumsum(new) - 1)[row] * max(len(names), 1) + code
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    count = np.add.reduceat(count, starts) if len(key) else count
    key = key[starts]
    edge = np.concatenate([[0], np.cumsum(np.bincount(key // max(len(names), 1), minlength=len(first)))])
    edge = pa.array(edge, pa.int32())
    df = rows.column(2).to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(pa.array(first)), rows.column(1).take(pa.array(first)),
         pa.array(np.add.reduceat(df, first) if n else df, pa.int64()),
         pa.ListArray.from_arrays(edge, pa.array(names, pa.string()).take(pa.array(key % max(len(names), 1)))),
         pa.ListArray.from_arrays(edge, pa.array(count, pa.int64()))],
        names=["lang", "term", "df", "sources", "counts"])


def merged_stripes(partial: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One stripe per language and kept term, and per language that of its
    documents."""
    def per_task(batches):
        def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
            return rows.filter(pc.or_(pc.greater_equal(rows.column(2), min_docs),
                                      pc.equal(rows.column(1), DOCUMENTS)))
        held: pa.RecordBatch | None = None  # the last term may go on
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]).cast(ARROW)
            if held is not None:
                table = pa.concat_tables([pa.Table.from_batches([held]), table])
            rows = add_up(table.combine_chunks().to_batches()[0])
            held = rows.slice(rows.num_rows - 1)
            yield kept(rows.slice(0, rows.num_rows - 1))
        if held is not None:
            yield kept(held)

    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term") \
        .mapInArrow(per_task, STRIPE)


# ---- divergences ------------------------------------------------------------

def probability(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / total), exact for totals up to 9 * 10**15."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Totals:
    """What a task has gathered for one (language, block of sources)."""

    def __init__(self, head: pa.RecordBatch, blocks: int, block: int, top: int):
        self.lang = head.column(0)[0].as_py()
        self.v = head.column(2)[0].as_py()
        self.sources = head.column(3)[0].as_py()
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.total = np.array(head.column(4)[0].as_py(), np.int64) + 2 * self.v
        self.all = int(self.total.sum()) - 2 * self.v * len(self.sources) + 2 * self.v
        size = -(-len(self.sources) // blocks)
        self.mine = range(size * block, min(size * (block + 1), len(self.sources)))
        self.sums = np.zeros((len(self.mine), len(self.sources)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in self.mine]
        self.top = top

    def add(self, rows: pa.RecordBatch) -> None:
        step = max(1, CELLS // len(self.sources))
        for at in range(0, rows.num_rows, step):
            self._add(rows.slice(at, step))

    def _add(self, rows: pa.RecordBatch) -> None:
        row, code, names, n = _entries(rows)
        m = np.zeros((rows.num_rows, len(self.sources)), np.int64)
        m[row, np.array([self.place[s] for s in names], np.int64)[code]] = n
        p = probability(m, self.total)
        q = probability(m.sum(1), self.all)
        for k, s in enumerate(self.mine):
            mine = p[:, s]
            self.sums[k] += spread(mine[:, None], p).sum(0)
            more = np.flatnonzero((m[:, s] > 0) & (mine > q))
            value = spread(mine[more], q[more])
            order = np.argsort(-value, kind="stable")[:self.top]  # rows are sorted by term
            found = list(zip(value[order].tolist(), rows.column(1).take(pa.array(more[order])).to_pylist()))
            # terms of one block come in order, and older ones sort before newer
            self.best[k] = sorted(self.best[k] + found, key=lambda x: -x[0])[:self.top]

    def rows(self) -> pa.RecordBatch:
        out = [(self.sources[s], "pair", t, v) for k, s in enumerate(self.mine)
               for t, v in zip(self.sources, self.sums[k].tolist()) if t != self.sources[s]]
        out += [(self.sources[s], "term", t, v) for k, s in enumerate(self.mine) for v, t in self.best[k]]
        cols = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(out), pa.string()), *[pa.array(c, pa.string()) for c in cols[:3]],
             pa.array(cols[3], pa.int64())], names=["lang", "source", "part", "item", "value"])


def language_totals(stripes: DataFrame) -> DataFrame:
    """One row per language: V as df, its sources in order with their N, the
    number of blocks of sources and of shares of the terms.  A share returns a sum
    per pair of sources, so it holds several terms per source."""
    terms = stripes.where(F.col("term") != DOCUMENTS)
    n = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")) \
        .groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    v = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("df"))
    groups = stripes.where(F.col("term") == DOCUMENTS).select("lang", F.explode("sources").alias("source"))
    each = groups.join(n, ["lang", "source"], "left") \
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(
            "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("each"))
    size = F.size("each").cast("long")
    blocks = F.ceil(size / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / size)))
    v_or_0 = F.coalesce("df", F.lit(0))
    return each.join(v, "lang", "left").select(
        "lang", v_or_0.alias("df"), F.col("each.source").alias("sources"),
        F.col("each.n").alias("counts"), blocks.alias("blocks"),
        F.greatest(F.lit(1), F.ceil(v_or_0 / F.greatest(F.lit(SHARE), 16 * size))).alias("shares"))


def source_divergence(df: DataFrame, lang_col: str, source_col: str, text_col: str,
                      min_docs: int = MIN_DOCS, top: int = TOP, spill: int = SPILL) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value, rank."""
    docs = df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"),
                     text_or_empty(text_col).alias("text"))
    stripes = materialize_table(merged_stripes(partial_stripes(docs, spill), min_docs), "stripes")
    totals = materialize_table(language_totals(stripes), "language-totals")

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    heads = totals.select("*", block).select(
        "*", F.lit(DOCUMENTS).alias("term"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    parts = stripes.where(F.col("term") != DOCUMENTS) \
        .join(totals.select("lang", "blocks", "shares"), "lang").select(
            "*", F.pmod(F.xxhash64("term"), F.col("shares")).alias("share"), block)
    cols = ["lang", "term", "df", "sources", "counts", "blocks", "block", "share"]
    dealt = heads.select(cols).unionByName(parts.select(cols)) \
        .repartition("lang", "block", "share").sortWithinPartitions("lang", "block", "share", "term")

    def per_task(batches):
        held: Totals | None = None
        for b in batches:
            heads = np.flatnonzero(pc.equal(b.column(1), DOCUMENTS).to_numpy(zero_copy_only=False))
            edges = [0, *heads.tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                run = b.slice(lo, hi - lo)
                if hi > lo and run.column(1)[0].as_py() == DOCUMENTS:
                    if held is not None:
                        yield held.rows()
                    held = Totals(run, run.column(5)[0].as_py(), run.column(6)[0].as_py(), top)
                    run = run.slice(1)
                if run.num_rows:
                    held.add(run)
        if held is not None:
            yield held.rows()

    found = dealt.mapInArrow(per_task, "lang string, source string, part string, item string, value long")
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")) \
        .withColumn("rank", F.row_number().over(w)) \
        .where((F.col("part") == "pair") | (F.col("rank") <= top))
