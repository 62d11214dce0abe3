"""Feature extraction: vocabularies, postings, n-grams, association measures, formulaic control.

Sequences come as rows (pid, pos, feature), one row for each token occurrence in a passage; null and empty features are
no features. Postings are rows (pid, feature, tf).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "␟"


def occurrences(df: DataFrame, pid: str, pos: str, feature: str) -> DataFrame:
    return df.select(F.col(pid).alias("pid"), F.col(pos).alias("pos"), F.col(feature).alias("feature")).filter(F.coalesce(F.col("feature"), F.lit("")) != "")


def postings(occ: DataFrame) -> DataFrame:
    return occ.groupBy("pid", "feature").agg(F.count("*").alias("tf"))


def one_row(df: DataFrame) -> DataFrame:
    """A table of one row as a broadcast side; its size doesn't depend on the data."""
    return F.broadcast(df)


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0))) + 1.0


def plain_idf(df: Column, n: Column) -> Column:
    return F.log(n / df.cast("double"))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_weight(tf: Column) -> Column:
    return F.log(tf.cast("double")) + 1.0


def vocabulary(occ: DataFrame, passages: DataFrame, token: str | None = None, rare: int = 3, high_ratio: float = 0.1, formulaic_ratio: float = 0.05, formulaic_count: int = 20) -> DataFrame:
    """Frequencies and flags of every feature.

    occ may carry ``token``, the identity of the underlying token: then the corpus frequency counts a token once, also
    when it occurs in several passages. passages(pid, book, genre). Columns out: feature, corpus_frequency,
    document_frequency, book_frequency, genre_frequency, idf, is_rare, is_high_frequency, is_formulaic.
    """
    agg = family_vocabulary(occ.select("pid", "feature", F.lit("").alias("family")), passages).drop("family")
    if token is not None:
        agg = agg.drop("corpus_frequency").join(occ.select("feature", token).distinct().groupBy("feature").agg(F.count(token).alias("corpus_frequency")), "feature")
    total = passages.agg(F.count_distinct("pid").alias("n_passages"))
    df, n = F.col("document_frequency"), F.col("n_passages")
    return agg.crossJoin(one_row(total)).select(
        "feature", "corpus_frequency", "document_frequency", "book_frequency", "genre_frequency", smooth_idf(df, n).alias("idf"),
        (F.col("corpus_frequency") <= rare).alias("is_rare"), (df / n >= high_ratio).alias("is_high_frequency"),
        ((df / n >= formulaic_ratio) & (F.col("corpus_frequency") >= formulaic_count)).alias("is_formulaic"),
    )


def family_vocabulary(occ: DataFrame, passages: DataFrame) -> DataFrame:
    """Frequencies of the features of several families: occ(pid, family, feature), one row an occurrence; passages(pid, book,
    genre). Columns out: family, feature, corpus_frequency, document_frequency, book_frequency, genre_frequency.

    Occurrences combine by passage first, then by (book, genre), so the distinct counts run over few rows.
    """
    per = occ.groupBy("family", "feature", "pid").agg(F.count("*").alias("tf")).join(passages.select("pid", "book", "genre"), "pid")
    place = per.groupBy("family", "feature", "book", "genre").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return place.groupBy("family", "feature").agg(F.sum("tf").alias("corpus_frequency"), F.sum("df").alias("document_frequency"), F.count_distinct("book").alias("book_frequency"), F.count_distinct("genre").alias("genre_frequency"))


def combine_vocabularies(*frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each (family, feature) of several vocabularies, and those that were given inconsistently."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    values = F.struct(*[c for c in every.columns if c not in ("family", "feature")])
    one = every.groupBy("family", "feature").agg(F.min(values).alias("v"), (F.min(values) != F.max(values)).alias("clash"))
    return one.filter("not clash").select("family", "feature", "v.*"), one.filter("clash").select("family", "feature")


def feature_statistics(occ: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per passage: lengths, counts of rare and formulaic features, and a digest of the sequence.

    The vocabulary is joined on its feature; Spark broadcasts it only below its size limit.
    """
    own = occ.join(vocab.select("feature", "is_rare", "is_formulaic"), "feature")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda x: x["feature"]), SEP)
    return own.groupBy("pid").agg(
        F.count_distinct("feature").alias("distinct_features"), F.count("*").alias("sequence_length"),
        F.count_distinct(F.when(F.col("is_rare"), F.col("feature"))).alias("rare_features"), F.count_distinct(F.when(F.col("is_formulaic"), F.col("feature"))).alias("formulaic_features"),
        F.sha2(seq, 256).alias("sequence_digest"),
    )


def tfidf(post: DataFrame, n_docs: DataFrame, max_df: int | None = None, max_ratio: float | None = None) -> DataFrame:
    """Sublinear tf times smooth idf, L2-normalized per passage over all its features; the df limits come after the norm.

    n_docs: one row with the column n. Columns out: pid, feature, tf, df, w.
    """
    df = post.groupBy("feature").agg(F.count("*").alias("df"))
    w = post.join(df, "feature").crossJoin(one_row(n_docs)).withColumn("raw", tf_weight(F.col("tf")) * smooth_idf(F.col("df"), F.col("n")))
    norm = Window.partitionBy("pid")
    w = w.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(norm)))
    if max_df is not None:
        w = w.filter(F.col("df") <= max_df)
    if max_ratio is not None:
        w = w.filter(F.col("df") <= F.col("n") * max_ratio)
    return w.select("pid", "feature", "tf", "df", "w")


def sequences(occ: DataFrame) -> DataFrame:
    """Ordered features of each passage as an array: pid, seq."""
    return occ.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda x: x["feature"]).alias("seq"))


def ngrams(seq: Column, n: int) -> Column:
    """All windows of n features of an array, joined; empty for shorter arrays."""
    grams = F.transform(F.sequence(F.lit(1), F.size(seq) - n + 1), lambda i: F.array_join(F.slice(seq, i, n), SEP))
    return F.when(F.size(seq) >= n, grams).otherwise(F.array().cast("array<string>"))


def skipgrams(seq: Column, max_gap: int, contiguous: bool = False) -> Column:
    """Ordered pairs with 1 to max_gap features between them; with none between too if ``contiguous``."""


    def apart(d: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(seq) - d), lambda i: F.concat_ws(SEP, F.element_at(seq, i), F.element_at(seq, i + d)))
        return F.when(F.size(seq) > d, pairs).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[apart(d) for d in range(1 if contiguous else 2, max_gap + 2)]))


def pmi(joint: Column, marginals: list[Column], total: Column, least: int = 1, cap: float | None = None) -> Column:
    """log2(joint * total^(m-1) / product of marginals); 0 below ``least`` joint occurrences; at most ``cap``."""
    value = F.log2(joint.cast("double")) + (len(marginals) - 1) * F.log2(total.cast("double"))
    for m in marginals:
        value = value - F.log2(m.cast("double"))
    if cap is not None:
        value = F.least(value, F.lit(float(cap)))
    return F.when(joint < least, F.lit(0.0)).otherwise(value)


def log_likelihood(o11: Column, o12: Column, o21: Column, o22: Column) -> Column:
    """Signed G2 of a 2x2 table: positive where the first cell is at least as expected."""
    cells = [x.cast("double") for x in (o11, o12, o21, o22)]
    n = cells[0] + cells[1] + cells[2] + cells[3]
    rows, cols = (cells[0] + cells[1], cells[2] + cells[3]), (cells[0] + cells[2], cells[1] + cells[3])
    g = F.lit(0.0)
    for k, o in enumerate(cells):
        e = rows[k // 2] * cols[k % 2] / n
        g = g + F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return F.when(cells[0] >= rows[0] * cols[0] / n, 2 * g).otherwise(-2 * g)


def bigram_g2(joint: Column, first: Column, second: Column, total: Column) -> Column:
    return log_likelihood(joint, first - joint, second - joint, total - first - second + joint)


def phrase_counts(seqs: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Corpus and document frequency of every n-gram: size, phrase, count, df."""
    rows = seqs.select("pid", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), ngrams(F.col("seq"), n).alias("p")) for n in sizes])).alias("x")).select("pid", "x.size", F.explode("x.p").alias("phrase"))
    return rows.groupBy("size", "phrase", "pid").agg(F.count("*").alias("c")).groupBy("size", "phrase").agg(F.sum("c").alias("count"), F.count("*").alias("df"))


def phrase_weights(seqs: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 2, cap: float = 16.0) -> DataFrame:
    """Association weight of every n-gram of at least ``least`` occurrences:
    (max(0, PMI) + ln(1 + max(0, G2))) / (1 + ln count), G2 for bigrams only. Columns out: size, phrase, count, df, pmi, g2, weight."""
    one = seqs.select(F.explode("seq").alias("f")).groupBy("f").agg(F.count("*").alias("c"))
    grams = phrase_counts(seqs, sizes).filter(F.col("count") >= least)
    p = F.split("phrase", SEP)
    for i in range(max(sizes)):
        grams = grams.withColumn(f"f{i}", F.get(p, F.lit(i))).join(one.select(F.col("f").alias(f"f{i}"), F.col("c").alias(f"c{i}")), f"f{i}", "left")
    firsts = seqs.filter(F.size("seq") > 1).select(F.explode(F.slice("seq", F.lit(1), F.size("seq") - 1)).alias("f0")).groupBy("f0").agg(F.count("*").alias("n_first"))
    seconds = seqs.filter(F.size("seq") > 1).select(F.explode(F.slice("seq", F.lit(2), F.size("seq"))).alias("f1")).groupBy("f1").agg(F.count("*").alias("n_second"))
    total = seqs.agg(F.sum(F.size("seq")).alias("total"), F.sum(F.greatest(F.size("seq") - 1, F.lit(0))).alias("slots"))
    grams = grams.join(firsts, "f0", "left").join(seconds, "f1", "left").crossJoin(one_row(total))
    value = F.coalesce(*[F.when(F.col("size") == n, pmi(F.col("count"), [F.col(f"c{i}") for i in range(n)], F.col("total"), least, cap)) for n in sizes])
    g2 = F.when(F.col("size") == 2, F.greatest(F.lit(0.0), bigram_g2(F.col("count"), F.col("n_first"), F.col("n_second"), F.col("slots")))).otherwise(0.0)
    weight = (F.greatest(F.lit(0.0), F.col("pmi")) + F.log1p("g2")) / (1 + F.log(F.col("count").cast("double")))
    return grams.withColumn("pmi", value).withColumn("g2", g2).select("size", "phrase", "count", "df", "pmi", "g2", weight.alias("weight"))


def skipgram_weights(seqs: DataFrame, max_gap: int, least: int = 2) -> DataFrame:
    """Weight 1 / count of every skip-gram of at least ``least`` occurrences: phrase, count, df, weight."""
    rows = seqs.select("pid", F.explode(skipgrams(F.col("seq"), max_gap)).alias("phrase"))
    n = rows.groupBy("phrase", "pid").agg(F.count("*").alias("c")).groupBy("phrase").agg(F.sum("c").alias("count"), F.count("*").alias("df"))
    return n.filter(F.col("count") >= least).select("phrase", "count", "df", (1.0 / F.col("count")).alias("weight"))


def formulaic_passages(seqs: DataFrame, sizes: tuple[int, ...] = (2, 3), min_fraction: float = 0.01, min_count: int = 25, min_features: int = 1, min_share: float = 0.2) -> DataFrame:
    """Flag of passages of which many distinct n-grams occur in many passages.

    An n-gram is common at document frequency max(min_count, ceil(min_fraction * passages)). Columns out: pid,
    n_features, n_common, is_formulaic; passages without n-grams are no formulas.
    """
    grams = seqs.select("pid", F.explode(F.array_distinct(F.flatten(F.array(*[ngrams(F.col("seq"), n) for n in sizes])))).alias("g"))
    total = seqs.agg(F.count("*").alias("n"))
    common = grams.groupBy("g").agg(F.count("*").alias("df")).crossJoin(one_row(total)).filter(F.col("df") >= F.greatest(F.lit(min_count), F.ceil(F.col("n") * min_fraction))).select("g", F.lit(1).alias("hit"))
    per = grams.join(common, "g", "left").groupBy("pid").agg(F.count("*").alias("n_features"), F.count("hit").alias("n_common"))
    out = seqs.select("pid").join(per, "pid", "left").na.fill(0, ["n_features", "n_common"])
    flag = (F.col("n_common") >= min_features) & (F.col("n_common") >= F.lit(min_share) * F.col("n_features")) & (F.col("n_features") > 0)
    return out.select("pid", "n_features", "n_common", flag.alias("is_formulaic"))


#: Grammar markers and the annotation words that show them (fixed values).
MARKERS = {
    "negation": ("neg", "negative", "לא", "οὐ", "μη"),
    "imperative": ("imperative", "impv", "imp"),
    "conditional": ("conditional", "cond", "if", "כי", "ἐάν", "εἰ"),
    "perfective": ("perfect", "aorist", "qatal"),
    "imperfective": ("imperfect", "present", "yiqtol"),
    "speech_frame": ("speech", "say", "אמר", "λέγω"),
    "passive": ("passive", "pass"),
}


def let(value: Column, f) -> Column:
    """f(value) with the value computed once per row, also where f uses it inside a lambda for every element."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def _clean(a: Column) -> Column:
    return F.filter(a, lambda x: F.coalesce(x, F.lit("")) != "")


def grammar_features(pos: Column, morph: Column) -> Column:
    """Grammar fingerprint of a passage from its ordered annotations: POS 1- to 3-grams, morphology 1- and 2-grams and markers."""
    label = lambda name, arr: F.transform(arr, lambda x: F.concat(F.lit(f"{name}:"), x))

    def marks(p: Column, m: Column) -> Column:
        # only distinct annotations are searched
        words = F.array_distinct(F.transform(F.concat(p, m), lambda x: F.lower(x)))
        shows = lambda w, needles: F.when(F.exists(w, lambda x: _any_in(x, needles)), F.lit(1))
        return let(words, lambda w: F.filter(F.array(*[F.when(shows(w, n) == 1, F.lit(f"marker:{k}")) for k, n in MARKERS.items()]), lambda x: x.isNotNull()))

    def every(p: Column, m: Column) -> Column:
        return F.flatten(F.array(*[label("pos" if n == 1 else f"pos{n}", ngrams(p, n)) for n in (1, 2, 3)], *[label("morph" if n == 1 else f"morph{n}", ngrams(m, n)) for n in (1, 2)], marks(p, m)))

    return let(_clean(pos), lambda p: let(_clean(morph), lambda m: every(p, m)))


def _any_in(x: Column, needles: tuple[str, ...]) -> Column:
    out = x.contains(needles[0])
    for w in needles[1:]:
        out = out | x.contains(w)
    return out


def structural_signature(frames: Column, participants: Column, entities: Column) -> Column:
    """struct of frames, participants, entities and actions of a passage and of what follows what among them."""
    acts = lambda f: F.filter(f, lambda x: _any_in(F.lower(x), ("verb", "event", "action", "predicate")))

    def every(f: Column, p: Column, a: Column) -> Column:
        return F.struct(
            f.alias("frames"), ngrams(f, 2).alias("frame_transitions"), p.alias("participants"), ngrams(p, 2).alias("participant_transitions"),
            _clean(entities).alias("entities"), a.alias("actions"), ngrams(a, 2).alias("action_progression"),
        )

    return let(_clean(frames), lambda f: let(_clean(participants), lambda p: let(acts(f), lambda a: every(f, p, a))))


def frequency_change(before: DataFrame, after: DataFrame, k: int = 25, same: bool = True) -> DataFrame:
    """Features whose counts differ most between two readings of the passages that both have (all, if not ``same``): the
    first k by (absolute change downward, feature). before, after: occurrences. Columns out: feature, n_before, n_after, change."""
    if not same:
        before, after = before.withColumn("pid", F.lit(0)), after.withColumn("pid", F.lit(0))
    both = before.select("pid").distinct().join(after.select("pid").distinct(), "pid", "left_semi")
    count = lambda o, n: o.join(both, "pid", "left_semi").groupBy("feature").agg(F.count("*").alias(n))
    out = count(before, "n_before").join(count(after, "n_after"), "feature", "full_outer").na.fill(0, ["n_before", "n_after"])
    out = out.withColumn("change", F.col("n_after") - F.col("n_before")).filter("change <> 0")
    return out.orderBy(F.desc(F.abs("change")), "feature").limit(k)


def rounded_share(count: Column, total: Column) -> Column:
    return F.round(count / total.cast("double"), 9)


def ceil_ratio(n: int, ratio: float) -> int:
    return math.ceil(n * ratio)
