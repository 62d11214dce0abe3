"""Reading and profile selection, structural alignment, and joins with a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.operators.spread import running


def select_reading(tokens: DataFrame, reading: str, group: str = "variant_group_id", kind: str = "variant_type", order: str = "position", verse: str = "verse", clause: str = "clause_id") -> DataFrame:
    """Tokens of one reading: of a complete pair (both qere and ketiv) only the chosen reading, all else as it is.

    Adds verse_position, clause_position (null without a clause) and stream_position, recounted from 1. Positions in
    the stream are counted per book-sized ``verse`` groups first and offset by sums, so no task holds the whole stream.
    """
    pairs = tokens.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(kind).alias("n"), F.bool_or(F.col(kind) == "qere").alias("q"), F.bool_or(F.col(kind) == "ketiv").alias("k"))
    paired = pairs.filter("n = 2 and q and k").select(group, F.lit(True).alias("paired"))
    kept = tokens.join(paired, group, "left").filter(F.col("paired").isNull() | (F.col(kind) == reading)).drop("paired")
    in_verse = F.row_number().over(Window.partitionBy(verse).orderBy(order))
    in_clause = F.when(F.col(clause).isNotNull(), F.row_number().over(Window.partitionBy(clause).orderBy(order)))
    return with_stream_position(kept.withColumn("verse_position", in_verse).withColumn("clause_position", in_clause), verse, order)


def with_stream_position(df: DataFrame, unit: str, order: str, name: str = "stream_position") -> DataFrame:
    """A running number over the whole table in the order of ``order``, where each unit is a contiguous stretch of it.

    Rows are numbered within their unit; the units' sizes are summed in slices that carry over.
    """
    sizes = running(df.groupBy(unit).agg(F.min(order).alias("first"), F.count("*").alias("n")), [], ["first"], "n", "upto")
    before = F.col("upto") - F.col("n")
    own = F.row_number().over(Window.partitionBy(unit).orderBy(order))
    return df.withColumn("own", own).join(sizes.select(unit, before.alias("before")), unit).withColumn(name, F.col("own") + F.col("before")).drop("own", "before")


def supplement_reading(primary: DataFrame, replaced: DataFrame, supplement: DataFrame, key: str, unit: str, slot: str) -> DataFrame:
    """The primary stream without the replaced tokens, with the supplement's, renumbered by word slot within the unit."""
    stream = primary.join(replaced.select(key).distinct(), key, "left_anti").unionByName(supplement, allowMissingColumns=True)
    return stream.withColumn("unit_position", F.row_number().over(Window.partitionBy(unit).orderBy(slot, key)))


def word_slot(word: Column) -> Column:
    """The slot number after the last exclamation mark of a word id."""
    return F.try_to_number(F.regexp_extract(word, "!([0-9]+)$", 1), F.lit("999999999")).cast("int")


def agreed(loci: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """A value for each locus and field where all its anchors have one and the same, else null."""
    one = [F.when((F.count_distinct(f) == 1) & (F.count(f) == F.count("*")), F.min(f)).alias(f) for f in fields]
    return loci.groupBy(group).agg(*one)


def nearest_both_sides(events: DataFrame, unit: str, order: str, value: str) -> DataFrame:
    """For every row without a value, those of the nearest rows before and after in its unit that have one: an as-of join in
    both directions. Adds before, after and agreed (their value where they are equal)."""
    w = Window.partitionBy(unit).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the other way round, as a frame that runs to the end is computed anew for every row
    after = F.last(value, ignorenulls=True).over(Window.partitionBy(unit).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("before", before).withColumn("after", after).withColumn("agreed", F.when(F.col("before") == F.col("after"), F.col("before")))


def unique_or_fail(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The table unchanged, failing while it is read if keys repeat: the one-side of a join with a contract."""
    n = F.count("*").over(Window.partitionBy(*keys))
    bad = F.raise_error(F.concat(F.lit(f"{name}: repeated key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))
    return df.withColumn("one", F.when(n > 1, bad.cast("boolean")).otherwise(True)).filter("one").drop("one")


def outside_ranges(stream: DataFrame, ranges: DataFrame, key: str, ordinal: Column) -> DataFrame:
    """Rows whose ordinal lies in none of the ranges (key, lo, hi); ranges are a configured table of a few rows."""
    r = F.broadcast(ranges.select(F.col(key).alias("range_key"), "lo", "hi"))
    return stream.join(r, (F.col(key) == F.col("range_key")) & ordinal.between(F.col("lo"), F.col("hi")), "left_anti")


def straddling_units(stream: DataFrame, excluded: Column, unit: str) -> DataFrame:
    """Units that an exclusion would cut through: some of their rows in, some out."""
    return stream.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count_distinct(excluded).alias("n")).filter("n > 1").select(unit)


def verse_ordinals(stream: DataFrame, book: list[str], verse: str, position: str) -> DataFrame:
    """A dense number of each verse in its book by first position."""
    first = stream.groupBy(*book, verse).agg(F.min(position).alias("first"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(*book).orderBy("first", verse))).drop("first")


def known_pairs(links: DataFrame) -> DataFrame:
    """Unordered pairs of passages linked by relationships: rows (relationship, side a or b, passage, vote, quality).

    Columns out: a, b, relationships (sorted list), highest_vote, worst_quality (alphabetically last).
    """
    x, y = (links.filter(F.col("side") == s).select("relationship", F.col("passage").alias(n), "vote", "quality") for s, n in (("a", "x"), ("b", "y")))
    both = x.join(y.select("relationship", "y"), "relationship").filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sort_array(F.collect_set("relationship")).alias("relationships"), F.max("vote").alias("highest_vote"), F.max("quality").alias("worst_quality"))


def knownness(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Status of ordered pairs (a, b) against directed known links (src, dst): both, forward, reverse or unknown."""
    k = known.select("src", "dst").distinct()
    fwd = k.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("f"))
    rev = k.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("r"))
    j = pairs.join(fwd, ["a", "b"], "left").join(rev, ["a", "b"], "left")
    status = F.when(F.col("f") & F.col("r"), "both").when(F.col("f"), "forward").when(F.col("r"), "reverse").otherwise("unknown")
    return j.withColumn("status", status).drop("f", "r")


def map_endpoints(endpoints: DataFrame, verses: DataFrame) -> DataFrame:
    """Targets of parsed endpoints in both profiles, by a range join on (chapter, verse) within the book.

    endpoints(endpoint_id, book, lo, hi, is_range), lo and hi being chapter * 1000 + verse; null book: not parsed.
    verses(profile, book, at, passage_id, reference_gap, disputed). Columns out: endpoint_id, profile, status, n_targets,
    targets (ordered list), reference_gap, disputed. Statuses: mapped_provisional, mapped_partial (gaps, or ends not
    met), excluded_by_profile, unresolved_missing_target, unresolved_reference.
    """
    profiles = endpoints.sparkSession.createDataFrame([("edition_complete",), ("critical_core",)], "profile string")
    asked = endpoints.crossJoin(F.broadcast(profiles))
    v = verses.select(F.col("profile").alias("p"), F.col("book").alias("vb"), "at", "passage_id", "reference_gap", "disputed")
    hit = asked.join(v, (F.col("profile") == F.col("p")) & (F.col("book") == F.col("vb")) & F.col("at").between(F.col("lo"), F.col("hi")), "left")
    per = hit.groupBy("endpoint_id", "profile", "book", "lo", "hi", "is_range").agg(
        F.count("passage_id").alias("n_targets"), F.transform(F.array_sort(F.collect_list(F.when(F.col("passage_id").isNotNull(), F.struct("at", "passage_id")))), lambda x: x["passage_id"]).alias("targets"),
        F.min("at").alias("first"), F.max("at").alias("last"), F.coalesce(F.bool_or("reference_gap"), F.lit(False)).alias("gap"), F.coalesce(F.bool_or("disputed"), F.lit(False)).alias("dis"),
        F.sort_array(F.collect_set("at")).alias("ats"),
    )
    ed = per.filter("profile = 'edition_complete'").select("endpoint_id", F.col("n_targets").alias("n_ed"), F.col("gap").alias("gap_ed"), F.col("dis").alias("dis_ed"), F.col("ats").alias("ats_ed"))
    j = per.join(ed, "endpoint_id")
    # a verse number that is missing between two of one chapter
    holes = F.exists(F.sequence(F.lit(1), F.greatest(F.size("ats_ed") - 1, F.lit(1))), lambda i: F.coalesce((F.floor(F.get("ats_ed", i) / 1000) == F.floor(F.get("ats_ed", i - 1) / 1000)) & (F.get("ats_ed", i) - F.get("ats_ed", i - 1) > 1), F.lit(False)))
    gap = F.col("gap_ed") | holes
    whole = F.when(~F.col("is_range"), F.size("ats") == 1).otherwise((F.col("ats") == F.col("ats_ed")) & (F.col("first") == F.col("lo")) & (F.col("last") == F.col("hi")))
    status = (
        F.when(F.col("book").isNull(), "unresolved_reference").when((F.col("n_targets") == 0) & (F.col("profile") == "critical_core") & (F.col("n_ed") > 0), "excluded_by_profile")
        .when(F.col("n_targets") == 0, "unresolved_missing_target").when(~whole | gap, "mapped_partial").otherwise("mapped_provisional")
    )
    return j.select("endpoint_id", "profile", status.alias("status"), "n_targets", "targets", gap.alias("reference_gap"), F.col("dis_ed").alias("disputed"))


def pair_stratum(corpus_a: Column, corpus_b: Column, book_a: Column, book_b: Column, genre_a: Column, genre_b: Column, ratio_bucket: Column) -> Column:
    """Stratum key of a pair: unordered corpora, books and genres, and the bucket of its length ratio."""
    two = lambda x, y: F.concat_ws("_", F.least(x, y), F.greatest(x, y))
    return F.concat_ws("|", two(corpus_a, corpus_b), two(book_a, book_b), two(genre_a, genre_b), ratio_bucket)


def sensitivity(baseline: DataFrame, comparison: DataFrame, k: int) -> DataFrame:
    """Two rankings (q, t, score, rank) side by side, also where only one has a target: deltas, and per query the overlap of
    the first k."""
    b = baseline.select("q", "t", F.col("score").alias("score_b"), F.col("rank").alias("rank_b"))
    c = comparison.select("q", "t", F.col("score").alias("score_c"), F.col("rank").alias("rank_c"))
    j = b.join(c, ["q", "t"], "full_outer")
    w = Window.partitionBy("q")
    return j.select(
        "q", "t", (F.col("score_c") - F.col("score_b")).alias("score_delta"), (F.col("rank_c") - F.col("rank_b")).alias("rank_delta"),
        F.count(F.when((F.col("rank_b") <= k) & (F.col("rank_c") <= k), 1)).over(w).alias("overlap_at_k"),
        F.when(F.col("rank_b").isNull(), "only_comparison").when(F.col("rank_c").isNull(), "only_baseline").alias("exclusion"),
    )
