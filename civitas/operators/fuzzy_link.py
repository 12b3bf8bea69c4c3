"""Linking misspelt names: bounded edit distance, mutual best match, no fan-out.

1. **Exact**: folded names that are equal link at once.
2. **Candidates** for the rest, without comparing all pairs: a registry name is cut
   into ``max_distance + 1`` pieces; two names within that distance share a piece,
   at nearly the same place.  Names join on (length, piece number, piece), which
   loses no pair within the distance.
3. A piece that very many names hold (a common first name) is dealt over salts, so
   its pairs are spread over tasks; the pairs are verified by ``levenshtein`` with
   the bound where they are made.
4. **Mutual best**: a pair stays when each is the other's only nearest name.  Two
   equally near names are no evidence, so such a name stays unlinked.

One row per left row always.  Blank names link to nothing; names under
``2 * (max_distance + 1)`` letters link exactly only (they are near to too much).
Registry ids that share a folded name count as one entry, the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitas.functions.text import normalize_name_nfkd
from civitas.operators.aggregates import exact_ratio_sql
from civitas.session import materialize_table

HOT = 1_000     # names of one piece that stay in one block


def _pieces(name: str, d: int) -> Column:
    """(no, start, piece) of the pieces of a name: even lengths, longer ones last."""
    n = F.char_length(name)
    k = d + 1
    small = F.floor(n / k).cast("int")
    longer = n - small * k                       # so many pieces have one more letter
    no = F.sequence(F.lit(0), F.lit(d))

    def piece(i):
        start = i * small + F.greatest(F.lit(0), i - (F.lit(k) - longer))
        size = small + F.when(i >= F.lit(k) - longer, 1).otherwise(0)
        return F.struct(i.alias("no"), (start + 1).cast("int").alias("start"),
                        F.substr(F.col(name), (start + 1).cast("int"), size.cast("int")).alias("piece"))
    return F.transform(no, piece)


def left_pieces(left: DataFrame, d: int) -> DataFrame:
    """l, len, no, piece: for every possible length of the partner of a name its
    pieces are cut out of the name, shifted as far as needed.  Of two names within
    ``d`` some piece ``no`` is whole with just ``no`` errors before it (the first
    with no more errors up to its end than its number), so at most ``d - no`` after
    it: shifts over ``no``, or further than that from the difference of the
    lengths, are not needed."""
    lens = left.select("l", F.explode(F.sequence(F.char_length("l") - d, F.char_length("l") + d)).alias("len")) \
        .where(F.col("len") >= 2 * (d + 1))
    stand_in = lens.withColumn("__x", F.repeat(F.lit("x"), F.col("len")))
    cut = stand_in.select("l", "len", F.explode(_pieces("__x", d)).alias("p")).select(
        "l", "len", "p.no", F.col("p.start").alias("start"), F.char_length("p.piece").alias("size"),
        F.explode(F.sequence(-F.col("p.no"), F.col("p.no"))).alias("shift"))
    cut = cut.where(F.abs(F.col("shift") - F.char_length("l") + F.col("len")) <= d - F.col("no"))
    cut = cut.withColumn("from", F.col("start") + F.col("shift")).where(
        (F.col("from") >= 1) & (F.col("from") + F.col("size") - 1 <= F.char_length("l")))
    return cut.select("l", "len", "no", F.substr("l", F.col("from"), F.col("size")).alias("piece")).distinct()


def candidate_pairs(left: DataFrame, right: DataFrame, max_distance: int, hot: int = HOT) -> DataFrame:
    """l, r, distance: all pairs of names within ``max_distance`` (columns ``l`` and
    ``r``, each distinct)."""
    d = max_distance
    r = right.select("r", F.char_length("r").alias("len"), F.explode(_pieces("r", d)).alias("p")) \
        .select("r", "len", "p.no", "p.piece", F.col("p.start").alias("at"))
    lp = left_pieces(left, d)

    on = ["len", "no", "piece"]
    lp, r = materialize_table(lp, "left-pieces"), materialize_table(r.drop("at"), "right-pieces")
    salts = lp.groupBy(*on).count().where(F.col("count") > hot).select(
        *on, F.ceil(F.col("count") / hot).cast("int").alias("salts"))
    one = F.coalesce("salts", F.lit(1))
    lp = lp.join(salts, on, "left").withColumn("salt", F.pmod(F.xxhash64("l"), one).cast("int")).drop("salts")
    r = r.join(salts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    pairs = lp.join(r, [*on, "salt"]).select("l", "r", F.levenshtein("l", "r", d).alias("distance"))
    return pairs.where(F.col("distance") >= 0).distinct()


def mutual_best(pairs: DataFrame) -> DataFrame:
    """The pairs of which each name is the other's only nearest one."""
    def nearest(side: str, other: str) -> DataFrame:
        best = pairs.groupBy(side, "distance").agg(
            F.count(F.lit(1)).alias("n"), F.min(other).alias(other))
        return best.groupBy(side).agg(F.min_by(F.struct("n", other, "distance"), "distance").alias("b")) \
            .where("b.n = 1").select(side, f"b.{other}", "b.distance")
    return nearest("l", "r").join(nearest("r", "l"), ["l", "r", "distance"])


def link_names(left: DataFrame, name: str, registry: DataFrame, registry_name: str, registry_id: str,
               max_distance: int = 2, fold=normalize_name_nfkd, hot: int = HOT) -> DataFrame:
    """``left`` plus ``linked_id``, ``link_method`` ('exact', 'fuzzy' or null) and
    ``link_distance``."""
    shortest = 2 * (max_distance + 1)
    reg = registry.select(fold(registry_name).alias("r"), F.col(registry_id).alias("linked_id")) \
        .where("r <> ''").groupBy("r").agg(F.min("linked_id").alias("linked_id"))
    reg = materialize_table(reg, "registry-names")
    names = materialize_table(left.select(fold(name).alias("l")).where("l <> ''").distinct(), "left-names")
    exact = names.join(reg, names.l == reg.r).select("l", "linked_id", F.lit("exact").alias("link_method"),
                                                    F.lit(0).alias("link_distance"))
    open_l = names.join(reg, names.l == reg.r, "left_anti").where(F.char_length("l") >= shortest)
    open_r = reg.join(names, names.l == reg.r, "left_anti").where(F.char_length("r") >= shortest).select("r")
    near = materialize_table(candidate_pairs(open_l, open_r, max_distance, hot), "name-pairs")
    fuzzy = mutual_best(near).join(reg, "r").select(
        "l", "linked_id", F.lit("fuzzy").alias("link_method"), F.col("distance").alias("link_distance"))
    links = exact.unionByName(fuzzy).withColumnRenamed("l", "__l")
    return left.withColumn("__n", fold(name)).join(links, F.col("__n") == F.col("__l"), "left") \
        .drop("__n", "__l")


def link_rates(linked: DataFrame, by: list[str]) -> DataFrame:
    """dq_key_links by method: rows and the share linked exactly and fuzzily."""
    share = lambda m: F.expr(exact_ratio_sql(
        f"count(case when link_method = '{m}' then 1 end)", "count(*)", 4, 0)).alias(f"rate_{m}")
    return linked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share("exact"), share("fuzzy"))
