"""Segmentation: units, windows of verses, continuity, neighbours, membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_passages(tokens: DataFrame, keys: list[str], unit: str, position: str) -> DataFrame:
    """One passage per source unit (clause, sentence, verse): extent, counts, and tokens of no unit inside its extent.

    Rows without a unit make no passage. Within keys (a book's stream) positions number the tokens; the tokens without
    a unit before a position are counted by one running sum, whose difference over the extent is the count.
    """
    run = F.sum(F.when(F.col(unit).isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    t = tokens.withColumn("loose", run).filter(F.col(unit).isNotNull())
    return t.groupBy(*keys, unit).agg(
        F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n_tokens"), (F.max("loose") - F.min("loose")).alias("n_unattached"),
    )


def verse_edges(verses: DataFrame, keys: list[str], ordinal: str, chapter: Column, verse: Column, boundaries: DataFrame | None = None, cross_chapter: bool = True) -> DataFrame:
    """Edges between consecutive verses of a stream: relation and whether a window may run across it.

    Relations by precedence: the declared one of ``boundaries(reference_from, reference_to, relation)``,
    profile_exclusion (ordinals apart), chapter_transition, reference_gap (a verse number left out), source_order.
    verses has passage_id, reference and the keys; boundaries is a configured table of a few rows.
    """
    w = Window.partitionBy(*keys).orderBy(ordinal)
    v = verses.withColumn("chapter", chapter).withColumn("verse", verse)
    nxt = lambda c, n: F.lead(c).over(w).alias(n)
    e = v.select(*keys, F.col("passage_id").alias("from_id"), F.col("reference").alias("reference_from"), F.col(ordinal).alias("o1"), "chapter", "verse", nxt("passage_id", "to_id"), nxt("reference", "reference_to"), nxt(ordinal, "o2"), nxt("chapter", "c2"), nxt("verse", "v2")).filter(F.col("to_id").isNotNull())
    if boundaries is not None:
        e = e.join(F.broadcast(boundaries.select("reference_from", "reference_to", F.col("relation").alias("declared"))), ["reference_from", "reference_to"], "left")
    else:
        e = e.withColumn("declared", F.lit(None).cast("string"))
    gap, crossing = F.col("o2") > F.col("o1") + 1, F.col("chapter") != F.col("c2")
    omitted = (F.col("o2") == F.col("o1") + 1) & ~crossing & (F.col("v2") > F.col("verse") + 1)
    relation = F.when(F.col("declared").isNotNull(), F.col("declared")).when(gap, "profile_exclusion").when(crossing, "chapter_transition").when(omitted, "reference_gap").otherwise("source_order")
    continuous = F.col("declared").isNull() & ~gap & (F.lit(cross_chapter) | ~crossing)
    return e.select(*keys, "from_id", "to_id", "o1", relation.alias("relation"), continuous.alias("continuous"), omitted.alias("reference_gap"))


def windows(verses: DataFrame, edges: DataFrame, keys: list[str], ordinal: str, size: int) -> DataFrame:
    """Complete sliding windows of ``size`` consecutive verses all of whose inner edges are continuous.

    Columns out: keys, first_id, start (ordinal), constituents (ordered passage ids).
    """
    w = Window.partitionBy(*keys).orderBy(ordinal)
    frame = w.rowsBetween(0, size - 1)
    j = verses.join(edges.select(F.col("from_id").alias("passage_id"), "continuous"), "passage_id", "left")
    inner = F.sum(F.when(F.coalesce("continuous", F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(0, size - 2))
    ids = F.collect_list("passage_id").over(frame)
    out = j.select(*keys, F.col("passage_id").alias("first_id"), F.col(ordinal).alias("start"), ids.alias("constituents"), inner.alias("inner"))
    return out.filter((F.size("constituents") == size) & (F.col("inner") == size - 1)).drop("inner")


def window_edges(wins: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between windows that differ by one verse at each end."""
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.lag("constituents").over(w)
    n = F.size("constituents")
    shifted = F.slice(before, F.lit(2), n - 1) == F.slice("constituents", F.lit(1), n - 1)
    return wins.withColumn("shifted", shifted).withColumn("from_id", F.lag("first_id").over(w)).filter("shifted").select(*keys, "from_id", F.col("first_id").alias("to_id"))


def neighbours(passages: DataFrame, members: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Previous and next passage of each and how many tokens it shares with the next.

    passages: one row for each passage with keys and order; members(passage_id, token_id).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    p = passages.withColumn("previous_id", F.lag("passage_id").over(w)).withColumn("next_id", F.lead("passage_id").over(w)).select("passage_id", "previous_id", "next_id")
    m = members.select("passage_id", "token_id").distinct()
    both = p.filter(F.col("next_id").isNotNull()).join(m, "passage_id").join(m.select(F.col("passage_id").alias("next_id"), "token_id"), ["next_id", "token_id"]).groupBy("passage_id").agg(F.count("*").alias("shared_tokens"))
    return p.join(both, "passage_id", "left").na.fill(0, ["shared_tokens"])


def membership(drafts: DataFrame, tokens: str) -> DataFrame:
    """Passage by token with 1-based positions, from an ordered array of token ids."""
    return drafts.select("passage_id", F.posexplode(tokens).alias("p", "token_id")).select("passage_id", (F.col("p") + 1).alias("position"), "token_id")


def token_sequences(members: DataFrame, position: str = "position_in_passage") -> DataFrame:
    """Ordered token ids of each passage, nulls kept in place."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("token_id").alias("t"))))
    return members.groupBy("passage_id").agg(F.transform(ordered, lambda x: x["t"]).alias("tokens"))


def membership_basis(corpus: Column, reading: Column, granularity: Column, supplementary: Column) -> Column:
    """How a token came into a passage: windows by composition, Greek and qere natively, ketiv by alignment."""
    aligned = F.when(granularity == "clause", "ketiv_clause_alignment").when(granularity == "sentence", "ketiv_sentence_alignment").otherwise("ketiv_verse_stream")
    return (
        F.when(granularity.isin("two_verse", "five_verse"), "window_composition").when(corpus == "greek", "source_native")
        .when((reading == "ketiv") & supplementary, aligned).otherwise("qere_primary")
    )


def enclosing_units(tokens: DataFrame, units: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Units whose extent holds a token that belongs to none: range join within the stream. units(keys, unit, start, end)."""
    u = units.select(*[F.col(k).alias(f"u_{k}") for k in keys], "unit", "start", "end")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"u_{k}") for k in keys])
    return tokens.join(u, same & F.col(position).between(F.col("start"), F.col("end"))).groupBy(*keys, position).agg(F.sort_array(F.collect_set("unit")).alias("inside"))


def sentences(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Running text cut into lines and sentences: ident, ordinal (from 1), sentence. Blank pieces are dropped."""
    pieces = F.filter(F.transform(F.split(text, r"[\n.!?]"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select(ident, F.posexplode(pieces).alias("p", "sentence")).select(ident, (F.col("p") + 1).alias("ordinal"), "sentence")


def passage_payload(members: DataFrame) -> DataFrame:
    """Ordered tokens and distinct references of each passage, the payload of its identity.

    members(passage_id, position, token_id, reference)."""
    s = F.array_sort(F.collect_list(F.struct("position", "token_id", "reference")))
    out = members.groupBy("passage_id").agg(s.alias("s"))
    return out.select("passage_id", F.transform("s", lambda x: x["token_id"]).alias("token_ids"), F.array_distinct(F.filter(F.transform("s", lambda x: x["reference"]), lambda r: r.isNotNull())).alias("references"))


def passage_summary(passages: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and exact quartiles of token counts for a report."""
    q = lambda p: F.percentile("token_count", F.lit(p)).alias(f"q{int(p * 100)}")
    return passages.groupBy(*keys).agg(F.count("*").alias("n_passages"), F.count_distinct("passage_id").alias("n_distinct"), F.sum("token_count").alias("n_tokens"), q(0.25), q(0.5), q(0.75), q(0.95))
