"""The N best items of every group by simultaneous bisection of all groups' cutoffs."""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from passagelink.operators.spread import hot_keys, spread_join
from passagelink.session import materialize

#: Bits by which a round narrows the bracket of every group: so many halvings, counted at once.
HALVINGS = 8
PARTS = 1 << HALVINGS
#: Bytes of the identifier in one step of its code.
STEP = 6
ID_BITS = 8 * STEP + 3
_TOP_BIT, _REST = -(2**63), 2**63 - 1


def score_code(s: Column) -> Column:
    """A 64-bit integer that rises with the double, infinities included; 0.0 and -0.0 are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), s + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_REST))).otherwise(bits)


def ident_code(ident: Column, skip: Column) -> Column:
    """STEP bytes of the identifier after its first ``skip`` bytes, as an integer that falls as the identifier rises.

    How many bytes there were counts after the bytes themselves, so an end comes before the byte 0.
    """
    raw = ident.cast("binary")
    part = F.rpad(F.hex(F.substring(raw, skip + 1, F.lit(STEP))), 2 * STEP, "0")
    return F.lit(2**ID_BITS - 1) - (F.conv(part, 16, 10).cast("bigint") * 8 + F.greatest(F.lit(0), F.least(F.lit(STEP), F.octet_length(raw) - skip)))


def _shared(a: Column, b: Column) -> Column:
    """Bytes that two identifiers have in common at the beginning."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(x), F.octet_length(y))
    unlike = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda k: (k < n) & (F.substring(x, k + 1, F.lit(1)) == F.substring(y, k + 1, F.lit(1)))), False)
    return (unlike - 1).cast("int")


def _shift(lo: Column, hi: Column) -> Column:
    """How far to shift codes so that the HALVINGS bits from the highest one in which they differ remain."""
    return F.greatest(F.lit(0), F.length(F.bin(lo.bitwiseXOR(hi))) - HALVINGS)


def top_n(df: DataFrame, group: str, ident: str, score: str, n: int, rank: str = "top_rank") -> DataFrame:
    """The ``n`` rows of each group with the highest score, equal scores by smaller identifier (code points), ranked from 1.

    Columns out: group, ident, score, rank. Rows with a null group, identifier or score and NaN scores don't count;
    infinite scores do. Of several rows for one group and identifier the highest score counts. Extra columns are
    dropped, whatever their names. An empty table gives an empty result, n below 1 too; a group of fewer than n items
    gives all of them.

    The code of a row is its score as 64 order-preserving bits, followed by the bytes of its identifier. Each round
    narrows the brackets of all groups at once by HALVINGS bits, from the highest bit in which the bracket's codes
    differ: it counts the rows of the PARTS parts, those above the cutoff are in, those below are out, and the bracket
    becomes the part that holds the cutoff, until it holds exactly as many rows as are wanted. A bracket of one code
    goes on with the next bytes in which its identifiers differ. So the number of rounds is bounded by the length of
    the code, whatever the scores. Counting combines on the map side: a group of any size costs PARTS rows a task; no
    group is sorted and none is gathered. Cutoffs are joined back to the rows, those of hot groups salted.
    """
    g, i, s = (F.col(f"`{c}`") for c in (group, ident, score))
    rows = (
        df.select(g.alias("g"), i.cast("string").alias("i"), s.cast("double").alias("s"))
        .filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
        .groupBy("g", "i").agg(F.max("s").alias("s"))
    )
    active = materialize(rows.withColumn("c", score_code(F.col("s"))))
    span = active.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).collect()[0]  # three numbers
    # bracket of the first round: the same for all groups, so that no join is needed before the first count; its parts
    # are equally wide where the scores allow that, which any rising function does
    lo, hi = span.lo or 0.0, span.hi or 0.0
    wide = hi - lo if 0 < hi - lo < math.inf else math.inf
    even = F.least(F.lit(PARTS - 1), F.floor((F.col("s") - F.lit(max(lo, -sys.float_info.max))) / F.lit(wide) * PARTS)) if wide < math.inf else F.when(F.col("s") > 0, 1).otherwise(0)
    active = active.withColumns({"need": F.lit(n).cast("bigint"), "skip": F.lit(-1)})
    done, first = [], True
    while True:
        bits = F.expr(f"shiftrightunsigned(c ^ {_TOP_BIT + 1}L ^ 1L, shift) & {PARTS - 1}") if not first else even
        active = active.withColumn("part", bits.cast("int"))
        ids = [] if first else [F.min("i").alias("first_id"), F.max("i").alias("last_id")]
        counts = active.groupBy("g", "part").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("need").alias("need"), F.max("skip").alias("skip"), *ids)
        down = Window.partitionBy("g").orderBy(F.desc("part"))  # at most PARTS rows of a group
        cut = (
            counts.withColumns({"upto": F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, 0)), "size": F.sum("k").over(Window.partitionBy("g"))})
            .filter(F.col("upto") - F.col("k") < F.col("need"))
            .withColumn("last", F.row_number().over(Window.partitionBy("g").orderBy("part"))).filter("last = 1")
        )
        alike = F.col("lo") == F.col("hi")
        cut = cut.select(
            "g", "size", F.col("part").alias("cut_part"), (F.col("upto") <= F.col("need")).alias("settled"), (F.col("need") - F.col("upto") + F.col("k")).alias("need2"),
            F.when(alike, F.lit(ID_BITS - HALVINGS)).otherwise(_shift(F.col("lo"), F.col("hi"))).cast("int").alias("shift2"),
            F.when(~alike, F.col("skip")).otherwise(F.lit(0) if first else _shared(F.col("first_id"), F.col("last_id"))).alias("skip2"),
        )
        if first:
            cut = materialize(cut)
            hot = materialize(hot_keys(cut, "g", "size", span.n))  # a group is never larger than now
        kept = spread_join(active.select("g", "i", "s", "c", "part"), cut.drop("size"), "g", hot, F.xxhash64("i")).filter(F.col("part") >= F.col("cut_part"))
        open_row = (F.col("part") == F.col("cut_part")) & ~F.col("settled")
        kept = kept.select("g", "i", "s", "c", F.col("shift2").alias("shift"), F.col("need2").alias("need"), F.col("skip2").alias("skip"), open_row.alias("open"))
        seen = Observation()
        kept = materialize(kept.observe(seen, F.count_if("open").alias("open")))
        done.append(kept.filter("not open").select("g", "i", "s"))
        active = kept.filter("open").drop("open")
        first = False
        if not seen.get["open"]:
            break
        active = active.withColumn("c", F.when(F.col("skip") < 0, F.col("c")).otherwise(ident_code(F.col("i"), F.greatest("skip", F.lit(0)))))
    best = reduce(DataFrame.unionByName, done)
    order = Window.partitionBy("g").orderBy(F.desc("s"), "i")  # at most n rows of a group
    return best.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), F.row_number().over(order).alias(rank))
