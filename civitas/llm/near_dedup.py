"""Near dedup by Order MinHash, with a second route for moved blocks.

1. A text's 5-word shingles are labelled with their occurrence number.  For each
   of ``BANDS`` hash functions the smallest few labelled shingles are taken.
   *Order route* (Order MinHash): they are hashed in the order in which they stand
   in the text, so texts share a key with a probability that follows the
   similarity of their sequences.  *Moved route*: the same shingles are hashed
   as a set, so texts whose blocks changed places meet too.  At the threshold
   0.8 a pair has no common set key with probability 1.5e-5 (five shingles a key,
   0.8 ** 5 a band); order keys alone would miss many pairs with moved blocks.
   A text with repeated shingles has keys over first occurrences too.  Short texts
   take fewer shingles per key; near a change of that number both keys are made.
2. In each bucket every text is paired with one text only, that which shares the
   most keys with others (aggregations and joins, so a hot bucket is split).  Pairs
   are linked by a banded alignment of their shingle sequences; those it does not
   link are, for moved blocks, told by the exact similarity of the shingle sets
   (``moved_blocks=False`` leaves that out: then the alignment alone decides).
3. Buckets whose texts are not all in one component go on: their texts are
   joined exactly by the prefix filter.  With the shingles in one order, rare
   ones first, two similar texts share one of the first fifth of each; pairs of
   different components that do, and where enough is left behind the first
   common one (the positional filter), are verified.
   Texts that share only what many share are not paired, and no pair is dropped
   for the size of its bucket.
4. Components of the links are the classes; exact copies share a text key and
   take part once.

Two texts are linked when 0.8 or more of the union of their shingles is common,
in order or in moved blocks.

Defined cases: null text is empty; texts without words are in a class only with
their exact copies; a text under 5 words is one shingle.  A class is named by
the smallest id of its rows, null if all are null.  Rows are kept one to one
(repeated rows are copies).  Other columns are not read.  An empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.llm.common import key128, text_or_empty
from civitas.llm.components import components
from civitas.llm.words import U, mix, occurrences, shingles, word_hashes
from civitas.session import materialize_table

WORDS = 5
THRESHOLD = 0.8
BANDS = 28
# (shingles a text must have, shingles per key); a text whose similar partners
# may have fewer than a bound has the keys below it too
SIZES = ((1, 1), (8, 3), (24, 5))
MATRIX = 1 << 20            # hash values held at once
FREQUENCY_BITS = 18
FREQUENCY_BUCKETS = 1 << FREQUENCY_BITS


def _sizes(n: int, threshold: float) -> list[int]:
    per_key = [ell for least, ell in SIZES if n >= least]
    if not per_key:
        return []
    least = SIZES[len(per_key) - 1][0]
    # a partner of n * threshold shingles or more may be under the bound
    return per_key[-2:] if len(per_key) > 1 and n * threshold < least else per_key[-1:]


def order_min_hash(x: np.ndarray, ell: int, bands: int = BANDS,
                   moved_blocks: bool = True) -> np.ndarray:
    """Keys over the labelled shingles ``x`` of a text, given in text order: per
    band the smallest ``ell`` by the band's hash, in the order in which they stand;
    with ``moved_blocks`` a second key of the same shingles in the order of their
    values, which is the same wherever they stand."""
    seeds = mix(np.arange(1, bands + 1, dtype=U) * U(0x632BE59BD9B4E019))
    step = max(1, MATRIX // len(x))
    out = []
    for i in range(0, bands, step):
        s = seeds[i:i + step, None]
        v = (x[None, :] ^ s) * U(0x9E3779B97F4A7C15)
        v ^= v >> U(32)
        v *= U(0xD6E8FEB86659FD93)
        if ell < len(x):
            at = np.argpartition(v, ell - 1, axis=1)[:, :ell]
        else:
            at = np.broadcast_to(np.arange(len(x)), (len(s), len(x)))
        routes = [x[np.sort(at, axis=1)]]
        if moved_blocks:
            routes.append(np.sort(routes[0], axis=1))
        for route, least in enumerate(routes):
            key = s[:, 0] + U(ell + 1_000 * route)
            for j in range(at.shape[1]):
                key = mix(key * U(0x100000001B3) + least[:, j])
            out.append(key)
    return np.concatenate(out)


def bucket_keys(text: str, k: int = WORDS, threshold: float = THRESHOLD,
                bands: int = BANDS, moved_blocks: bool = True) -> tuple[np.ndarray, int]:
    """(bucket keys, number of different shingles).  Occurrences are labelled by
    the power of two they reach, so a line repeated a hundred times has seven
    labels and does not outweigh the rest of its text."""
    x = shingles(word_hashes(text), k)
    if not len(x):
        return x, 0
    n = occurrences(x)
    label = np.floor(np.log2(n + 1)).astype(U)
    labelled = mix(x + label * U(0xA0761D6478BD642F))
    new = (n & (n + 1)) == 0  # the first occurrence with each label
    once = labelled[n == 0]
    keys = [order_min_hash(once, ell, bands, moved_blocks) for ell in _sizes(len(once), threshold)]
    if len(once) < new.sum():
        keys += [order_min_hash(labelled[new], ell, bands, moved_blocks)
                 for ell in _sizes(int(new.sum()), threshold)]
    return np.unique(np.concatenate(keys)), len(once)


def first_shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Different shingles in the order of their first occurrence."""
    x = shingles(word_hashes(text), k)
    return x[occurrences(x) == 0] if len(x) else x


def aligned(ia: np.ndarray, ib: np.ndarray, band: int) -> int:
    """The longest common subsequence of two sequences whose common elements are
    at ``ia`` and ``ib``, over matches at most ``band`` off the diagonal."""
    near = np.abs(ia - ib) <= band
    ib = ib[near][np.argsort(ia[near], kind="stable")]
    if len(ib) < 2 or (ib[1:] > ib[:-1]).all():
        return len(ib)
    tails: list[int] = []
    for p in ib.tolist():
        at = bisect_left(tails, p)
        tails[at:at + 1] = [p]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, float]:
    """(aligned similarity, set similarity) of two sequences of different shingles."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    if not total:
        return 0.0, 0.0
    whole = len(common) / (total - len(common))
    if whole < threshold:  # an alignment has no more matches than the sets
        return 0.0, whole
    s = aligned(ia, ib, int((1 - threshold) * total) + 1)
    return s / (total - s), whole


def sketches(df: DataFrame, k: int, threshold: float, bands: int,
             moved_blocks: bool = True) -> DataFrame:
    """k1, k2, n, keys per row of ``df`` (k1, k2, text)."""
    def per_task(batches):
        for b in batches:
            found = [bucket_keys(t.as_py(), k, threshold, bands, moved_blocks) for t in b.column(2)]
            at = np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, U), *(x for x, _ in found)]).astype(np.int64, copy=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n for _, n in found], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                names=["k1", "k2", "n", "keys"])

    return df.mapInArrow(per_task, "k1 long, k2 long, n int, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """a1, a2, b1, b2, aligned, similarity of each pair (a1, a2, b1, b2)."""
    a = texts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("text").alias("ta"))
    b = texts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("text").alias("tb"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]) \
        .select("a1", "a2", "b1", "b2", "ta", "tb")

    def per_task(batches):
        kept: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            found = []
            for (a1, a2, b1, b2), ta, tb in zip(keys, batch.column(4), batch.column(5)):
                one = []
                for key, t in (((a1, a2), ta), ((b1, b2), tb)):
                    if key not in kept:
                        if len(kept) >= 64:
                            kept.pop(next(iter(kept)))
                        kept[key] = first_shingles(t.as_py(), k)
                    one.append(kept[key])
                found.append(similarity(*one, threshold))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([x for x, _ in found], pa.float64()),
                 pa.array([y for _, y in found], pa.float64())],
                names=["a1", "a2", "b1", "b2", "aligned", "similarity"])

    return both.mapInArrow(
        per_task, "a1 long, a2 long, b1 long, b2 long, aligned double, similarity double")


def _with_leader(members: DataFrame) -> DataFrame:
    """Adds a1, a2: the text of the bucket that shares the most keys with others.
    The origin of a group of copies shares more with each copy than two copies
    with each other, so the group is linked through it."""
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    degree = members.join(size, "key").groupBy("k1", "k2").agg(F.sum("size").alias("degree"))
    lead = members.join(degree, ["k1", "k2"]).groupBy("key").agg(
        F.max(F.struct("degree", "k1", "k2")).alias("x"))
    return members.join(lead, "key").select("key", "k1", "k2", "n", F.col("x.k1").alias("a1"),
                                            F.col("x.k2").alias("a2"))


def links_of(tested: DataFrame, threshold: float, moved_blocks: bool = True) -> DataFrame:
    """The linked pairs with their ``route``: 'order' by the alignment, else
    'moved' by the sets."""
    order = F.col("aligned") >= threshold
    linked = order | (F.lit(moved_blocks) & (F.col("similarity") >= threshold))
    return tested.where(linked).withColumn("route", F.when(order, "order").otherwise("moved"))


def _roots(tested: DataFrame, threshold: float, moved_blocks: bool) -> DataFrame:
    """k1, k2, r1, r2: the component's root of each text that has a link."""
    links = links_of(tested, threshold, moved_blocks)
    nodes = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")) \
        .unionByName(links.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))).distinct()
    nodes = materialize_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    side = lambda p: nodes.select(F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"),
                                  F.col("node").alias(p))
    edges = links.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).select("a", "b")
    found = components(edges)
    root = nodes.select(F.col("node").alias("root"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    return nodes.join(found, "node").join(root, "root").select("k1", "k2", "r1", "r2")


def near_classes(df: DataFrame, id_col: str, text_col: str, k: int = WORDS,
                 threshold: float = THRESHOLD, bands: int = BANDS,
                 moved_blocks: bool = True) -> DataFrame:
    """One row per row: id, k1, k2 (the text's key), class_id, class_size."""
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .select("id", "text", *key128(F.col("text")))
    sk = materialize_table(sketches(docs.select("k1", "k2", "text"), k, threshold, bands, moved_blocks), "omh")
    rows = sk.select("k1", "k2", "n", F.explode("keys").alias("key"))
    # copies fall together in the partial step
    shared = rows.groupBy("key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"),
                                     F.min("k2").alias("lo2"), F.max("k2").alias("hi2")) \
        .where("lo <> hi or lo2 <> hi2").select("key")
    members = materialize_table(rows.distinct().join(shared, "key"), "omh-members")
    members = materialize_table(_with_leader(members), "omh-led")
    pairs = members.where("k1 <> a1 or k2 <> a2").select(
        "a1", "a2", F.col("k1").alias("b1"), F.col("k2").alias("b2")).distinct()
    taking_part = members.select("k1", "k2").distinct()
    texts = materialize_table(
        docs.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(taking_part, ["k1", "k2"]),
        "omh-texts")
    tested = materialize_table(verify(pairs, texts, k, threshold), "omh-tested")
    roots = materialize_table(_roots(tested, threshold, moved_blocks), "omh-roots")

    mixed = materialize_table(_mixed_texts(members, roots, texts), "omh-mixed")
    more = materialize_table(_open_pairs(mixed, tested, k, threshold), "omh-open")
    if not more.isEmpty():
        tested = tested.unionByName(verify(more, texts, k, threshold))
        roots = materialize_table(_roots(materialize_table(tested, "omh-tested"), threshold,
                                         moved_blocks), "omh-roots")

    found = docs.select("id", "k1", "k2").join(roots, ["k1", "k2"], "left").select(
        "id", "k1", "k2", F.coalesce("r1", "k1").alias("c1"), F.coalesce("r2", "k2").alias("c2"))
    sizes = materialize_table(found.groupBy("c1", "c2").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "omh-classes")
    return found.join(sizes, ["c1", "c2"]).select("id", "k1", "k2", "class_id", "class_size")


def _mixed_texts(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """k1, k2, c (a component's number), text of buckets with several components."""
    m = members.join(roots, ["k1", "k2"], "left").select(
        "key", "k1", "k2", F.xxhash64(F.coalesce("r1", "k1"), F.coalesce("r2", "k2")).alias("c"))
    mixed = m.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")) \
        .where("lo <> hi").select("key")
    return m.join(mixed, "key").select("k1", "k2", "c").distinct().join(texts, ["k1", "k2"])


def _frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """How many texts have a shingle of each of FREQUENCY_BUCKETS hash buckets."""
    def per_task(batches):
        n = np.zeros(FREQUENCY_BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                n += np.bincount(_bucket(first_shingles(t.as_py(), k)), minlength=FREQUENCY_BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()),
                                          "n": pa.array(n[some], pa.int64())})

    got = texts.select("text").mapInArrow(per_task, "bucket int, n long").groupBy("bucket") \
        .agg(F.sum("n").alias("n")).toPandas()  # at most FREQUENCY_BUCKETS rows
    out = np.zeros(FREQUENCY_BUCKETS, np.int64)
    out[got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    return out


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> U(64 - FREQUENCY_BITS)).astype(np.int64)


def prefix_of(x: np.ndarray, frequency: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of ``x``, rare ones first, of which two texts with the
    threshold's similarity share at least one."""
    order = np.lexsort((x, frequency[_bucket(x)]))
    return x[order][:len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1]


def _open_pairs(texts: DataFrame, tested: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of different components of ``texts`` (k1, k2, c, text) that the
    prefix and positional filters allow to be linked, without those tested."""
    frequency = _frequencies(texts, k)

    def per_task(batches):
        for b in batches:
            row, n, place, out = [], [], [], [np.zeros(0, U)]
            for i, t in enumerate(b.column(3)):
                x = first_shingles(t.as_py(), k)
                if len(x):
                    out.append(prefix_of(x, frequency, threshold))
                    row += [i] * len(out[-1])
                    n += [len(x)] * len(out[-1])
                    place += range(len(out[-1]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), *(b.column(i).take(at) for i in range(3)),
                 pa.array(n, pa.int32()), pa.array(place, pa.int32())],
                names=["key", "k1", "k2", "c", "n", "place"])

    rows = materialize_table(
        texts.select("k1", "k2", "c", "text").mapInArrow(
            per_task, "key long, k1 long, k2 long, c long, n int, place int"), "omh-prefixes")
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")) \
        .where("lo <> hi").select("key")
    rows = materialize_table(rows.join(mixed, "key"), "omh-shared")
    x, y = (rows.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("k1", "k2", "n", "c", "place")])
            for p in "xy")
    before = (F.col("x_k1") < F.col("y_k1")) | ((F.col("x_k1") == F.col("y_k1"))
                                                & (F.col("x_k2") < F.col("y_k2")))
    # what is common from the first common shingle on must be enough for a link
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    need = (F.col("x_n") + F.col("y_n")) * (threshold / (1 + threshold))
    may = before & (F.col("x_c") != F.col("y_c")) & (rest >= need - 1e-9)
    got = x.join(y, "key").where(may).select(
        F.col("x_k1").alias("a1"), F.col("x_k2").alias("a2"),
        F.col("y_k1").alias("b1"), F.col("y_k2").alias("b2")).distinct()
    both = tested.select("a1", "a2", "b1", "b2").unionByName(tested.select(
        F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"),
        F.col("a2").alias("b2")))
    return got.join(both, ["a1", "a2", "b1", "b2"], "left_anti")
