"""All similar pairs between set-valued records by recursive chosen-path splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelink.session import materialize

#: Trees, branches of a node that is split again, rows of a node that are compared with each other, and levels.
TREES, BRANCHES, NODE, DEPTH = 9, 2, 256, 8
#: Sets of more values than this aren't held in one row.
LARGE_SET = 20_000
#: Share of the sets by which the size of a node is estimated before it is split or compared; both lose nothing.
EVERY = 8
#: Bits of the bitmap of a set.
BITMAP = 48


def value_sets(df: DataFrame, record: str, value: str, least: int, part: str, large: int = LARGE_SET) -> tuple[DataFrame, DataFrame]:
    """The value sets of the records with at least ``least`` distinct values, and the values of the large ones.

    First table: (part, rid, h, h2, first, n, tokens), tokens being the sorted 64-bit hashes of the distinct values; h
    and h2 hash them, so that equal sets agree in both, and first marks one record of each set. Second: (part, rid, n, v), one row for each value of a set of more
    than ``large`` values, for which tokens is null in the first. Null records and values are left out, repeated rows
    don't count, blank texts are values.
    """
    rows = df.filter(F.col(record).isNotNull() & F.col(value).isNotNull()).select(F.col(record).cast("string").alias("rid"), F.xxhash64(F.col(value).cast("string")).alias("v"))
    # rows are at least as many as distinct values
    many = materialize(df.groupBy(F.xxhash64(F.col(record).cast("string")).alias("k")).count().filter(F.col("count") > large).select("k"))
    keyed = rows.withColumn("k", F.xxhash64("rid"))
    ours = rows if many.isEmpty() else keyed.join(many, "k", "left_anti")
    held = ours.groupBy("rid").agg(F.sort_array(F.collect_set("v")).alias("tokens")).withColumn("n", F.size("tokens").cast("bigint"))
    wide = keyed.join(many, "k", "left_semi").select("rid", "v").distinct()
    if not many.isEmpty():
        sizes = wide.groupBy("rid").agg(F.count("*").alias("n"))
        back = wide.join(sizes.filter(F.col("n") <= large), "rid", "left_semi").groupBy("rid").agg(F.sort_array(F.collect_set("v")).alias("tokens")).withColumn("n", F.size("tokens").cast("bigint"))
        held = held.unionByName(back).unionByName(sizes.filter(F.col("n") > large).select("rid", F.lit(None).cast("array<bigint>").alias("tokens"), "n"))
        wide = wide.join(sizes.filter(F.col("n") > large), "rid")
    else:
        wide = wide.withColumn("n", F.lit(0).cast("bigint")).filter("false")
    key = lambda seed: F.when(F.col("tokens").isNotNull(), F.xxhash64("tokens", F.lit(part), F.lit(seed))).otherwise(F.xxhash64("rid", F.lit(part), F.lit(seed)))
    held = held.filter(F.col("n") >= least).select(F.lit(part).alias("part"), "rid", key(1).alias("h"), key(2).alias("h2"), F.col("n").cast("int").alias("n"), "tokens")
    # the exchange below both sides of this join is one and the same, so the values are shuffled once
    firsts = held.groupBy("h", "h2").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    held = held.join(firsts, "rid", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return held, wide.select(F.lit(part).alias("part"), "rid", "n", "v")


def _first(tokens: Column, node: Column) -> Column:
    """The smallest hash of a set's tokens in a node's random order; it stands for the token that has it."""
    return F.array_min(F.transform(tokens, lambda x: F.xxhash64(x, node)))


def _left(tokens: Column, path: Column) -> Column:
    """The tokens that no step of a path, array<struct<node, first>>, has taken."""
    return F.filter(tokens, lambda x: ~F.exists(path, lambda p: F.xxhash64(x, p["node"]) == p["first"]))


def _node(*path: str) -> Column:
    """The number of a node; 40 bits, and where two nodes share one, their sets are compared in vain but none is lost."""
    return F.xxhash64(*path).bitwiseAND(F.lit(2**40 - 1)).alias("node")


def _tiled(rows: DataFrame, most: int) -> DataFrame:
    """The rows of nodes with more than ``most`` sets dealt to tiles of about that many, once for each pair (p, q) of tiles
    that their own is part of; other nodes are one tile."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("node", F.ceil(F.col("n") / most).cast("int").alias("tiles"))
    dealt = rows.join(sizes, "node", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("k", F.lit(11)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("node", "k", "s", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))


def similar_sets(sets: DataFrame, threshold: float, trees: int = TREES, node_rows: int = NODE) -> DataFrame:
    """Pairs of different sets with a Jaccard similarity of at least ``threshold``, each pair of sets once.

    sets: the first table of ``value_sets()``, or several of them united; pairs are found within a part. Columns out:
    ha, ha2, hb, hb2, the hashes of the two sets. Copies of a set count once; empty tables give no rows.

    Every tree sends a set to the node of the token that comes first in a random order, the same for all sets; a pair
    of similarity j meets with probability j. Nodes of more than ``node_rows`` sets are split again, along BRANCHES
    tokens of new random orders beside those on the path, until they are small; the limit doubles with every level, as
    sets that share a path are alike. Nodes still larger than that after DEPTH levels are compared in tiles, so no task
    holds more than two tiles. How large a node is, is estimated by one set in EVERY. ``trees`` independent trees lose a pair at the threshold 0.7 with probability 0.3 ** trees
    (2e-5 for 9 trees, if no node is split), more similar pairs more rarely.

    Sets that meet are told apart by size and by a bitmap of their tokens: a bit in which two bitmaps differ is a token
    that one set lacks, and a pair has at most (1 - t) / (1 + t) of its sizes' sum of those. This loses nothing. What
    is left is verified on the sets themselves.
    """
    # size and bitmap in one number: 15 and BITMAP bits
    bitmap = F.expr(f"aggregate(tokens, 0L, (a, x) -> a | shiftleft(1L, cast(pmod(x, {BITMAP}) as int)))")
    sets = sets.filter(F.col("tokens").isNotNull() & F.col("first")).select("part", "h2", "tokens", F.col("h").bitwiseAND(F.lit(2**48 - 1)).alias("k"), "h")
    level = sets.select("k", "part", "tokens", (F.shiftleft(F.size("tokens").cast("bigint"), BITMAP).bitwiseOR(bitmap)).alias("s"), F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(trees)])).alias("node"))
    level = level.withColumn("first", _first(F.col("tokens"), F.col("node")))
    level = level.select(_node("part", "node", "first"), "k", "s", "tokens", F.array(F.struct("node", "first")).alias("path"))
    n = lambda side: F.shiftright(f"{side}.s", BITMAP)
    lacking = F.bit_count(F.col("x.s").bitwiseAND(F.lit(2**BITMAP - 1)).bitwiseXOR(F.col("y.s").bitwiseAND(F.lit(2**BITMAP - 1))))
    fits = (n("x") >= F.lit(threshold) * n("y") - 1e-9) & (n("y") >= F.lit(threshold) * n("x") - 1e-9) & (lacking <= F.lit((1 - threshold) / (1 + threshold) + 1e-9) * (n("x") + n("y")))
    pairs = []
    for depth in range(DEPTH + 1):
        rows, last = level.select("node", "k", "s"), depth == DEPTH
        if not last:
            some = level.filter(F.pmod(F.xxhash64("k"), F.lit(EVERY)) == 0)
            big = materialize(some.groupBy("node").count().filter(F.col("count") > node_rows * 2**depth / EVERY).select("node"))
            last = big.isEmpty()
            rows = rows if last else rows.join(big, "node", "left_anti")
        if depth == DEPTH:
            rows = _tiled(rows, node_rows * 2**depth)
            apart = (F.col("x.tile") != F.col("y.tile")) | (F.col("p") == F.col("q"))
            met = rows.alias("x").join(rows.alias("y"), ["node", "p", "q"]).filter(apart & (F.col("x.k") < F.col("y.k")) & fits)
        else:
            met = rows.alias("x").join(rows.alias("y"), "node").filter((F.col("x.k") < F.col("y.k")) & fits)
        pairs.append(met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")))
        if last:
            break
        deeper = level.join(big, "node", "left_semi")
        deeper = deeper if depth == 0 else deeper.join(sets.select("k", "tokens"), "k")
        deeper = deeper.select("k", "s", "path", _left(F.col("tokens"), F.col("path")).alias("rest"), "node", F.explode(F.array(*[F.lit(t) for t in range(BRANCHES)])).alias("branch"))
        deeper = deeper.withColumn("node", F.xxhash64("node", "branch")).withColumn("first", _first(F.col("rest"), F.col("node")))
        step = F.when(F.col("first").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.struct("node", "first"))))
        level = materialize(deeper.select(_node("node", "first"), "k", "s", step.alias("path")))
    cand = reduce(DataFrame.unionByName, pairs).distinct()
    left = sets.select(F.col("k").alias("a"), F.col("h").alias("ha"), F.col("h2").alias("ha2"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("k").alias("b"), F.col("h").alias("hb"), F.col("h2").alias("hb2"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    alike = both >= F.lit(threshold) * (F.size("ta") + F.size("tb") - both) - 1e-9
    return cand.join(left, "a").join(right, "b").filter(alike).select("ha", "ha2", "hb", "hb2")


def similar_large(sets: DataFrame, wide: DataFrame, threshold: float, large: int = LARGE_SET) -> DataFrame:
    """``large_pairs()`` without the column equal."""
    return large_pairs(sets, wide, threshold, large).drop("equal")


def large_pairs(sets: DataFrame, wide: DataFrame, threshold: float, large: int = LARGE_SET) -> DataFrame:
    """Pairs of records of which at least one has a large set, exactly: shared values are counted, not held in a row.

    Only sets of at least ``threshold * large`` values can be partners, and of those a table has at most its rows
    divided by that. Columns out: part, lo, hi (records, lo < hi), equal (whether the sets are).
    """
    near = sets.filter(F.col("tokens").isNotNull() & (F.col("n") >= threshold * large)).select("part", "rid", F.col("n").cast("bigint").alias("n"), F.explode("tokens").alias("v"))
    rest = near.unionByName(wide).select("part", F.col("rid").alias("rid2"), F.col("n").alias("n2"), "v")
    shared = wide.join(rest, ["part", "v"]).filter("rid <> rid2").groupBy("part", "rid", "n", "rid2", "n2").agg(F.count("*").alias("k"))
    alike = shared.filter(F.col("k") >= F.lit(threshold) * (F.col("n") + F.col("n2") - F.col("k")) - 1e-9)
    return alike.select("part", F.least("rid", "rid2").alias("lo"), F.greatest("rid", "rid2").alias("hi"), ((F.col("k") == F.col("n")) & (F.col("k") == F.col("n2"))).alias("equal")).distinct()


def expand_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records whose sets are equal or form one of the pairs. Columns out: part, lo, hi."""
    m = sets.select("part", "rid", "h", "h2")
    # both sides have the same columns, so that one exchange of the records serves all joins
    x, y = m.alias("x"), m.alias("y")
    pick = [F.greatest("x.part", "y.part").alias("part"), F.least("x.rid", "y.rid").alias("lo"), F.greatest("x.rid", "y.rid").alias("hi")]
    other = pairs.join(x, (F.col("ha") == F.col("x.h")) & (F.col("ha2") == F.col("x.h2"))).join(y, (F.col("hb") == F.col("y.h")) & (F.col("hb2") == F.col("y.h2"))).select(*pick)
    same = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.h2") == F.col("y.h2"))).filter("x.rid < y.rid").select(*pick)
    return other.unionByName(same)


def set_classes(sets: DataFrame, pairs: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """One row for each record: its class of equal sets, the class's size, and how many other classes it is similar to.

    large: ``large_pairs()``, for the records whose sets aren't held in a row; equal large sets
    are one class. Columns out: part, rid, class_id (smallest record of the class), class_size, similar_classes.
    """
    m = sets.select("part", "rid", "h", "h2")
    if large is None:
        named = m.withColumns({"c": F.col("h"), "c2": F.col("h2")})
    else:
        # equality is transitive, so the smallest record equal to one, or itself, names the class
        same = large.filter("equal").groupBy("part", F.col("hi").alias("rid")).agg(F.min("lo").alias("least"))
        head = m.join(same, ["part", "rid"], "left").withColumn("least", F.coalesce("least", "rid"))
        named = head.join(m.select("part", F.col("rid").alias("least"), F.col("h").alias("c"), F.col("h2").alias("c2")), ["part", "least"])
    cls = named.groupBy("c", "c2").agg(F.min("rid").alias("class_id"), F.count("*").alias("class_size"))
    ends = pairs.select(F.col("ha").alias("c"), F.col("ha2").alias("c2")).unionByName(pairs.select(F.col("hb").alias("c"), F.col("hb2").alias("c2")))
    if large is not None:
        side = lambda r, s: named.select("part", F.col("rid").alias(r), F.col("c").alias(f"{s}1"), F.col("c2").alias(f"{s}2"))
        far = large.filter("not equal").join(side("lo", "a"), ["part", "lo"]).join(side("hi", "b"), ["part", "hi"])
        both = far.select("a1", "a2", "b1", "b2").unionByName(far.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))).distinct()
        ends = ends.unionByName(both.select(F.col("a1").alias("c"), F.col("a2").alias("c2")))
    cls = cls.join(ends.groupBy("c", "c2").agg(F.count("*").alias("k")), ["c", "c2"], "left")
    return named.select("part", "rid", "c", "c2").join(cls, ["c", "c2"]).select("part", "rid", "class_id", "class_size", F.coalesce("k", F.lit(0)).alias("similar_classes"))
