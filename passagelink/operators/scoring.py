"""Scores of queries against all passages by every set, vector and rarity detector, from one join of postings.

A query set meets all passages; no feature is left out of a score. Proposals may leave out common features, and then the
proposed pairs are scored over all features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelink.operators import detectors as D
from passagelink.operators import features as X
from passagelink.operators import retrieval as R
from passagelink.session import materialize, shuffle_width

#: Which detectors restate each other: of a family only the best rank counts in a fusion.
FAMILIES = {
    "jaccard": "set", "weighted_jaccard": "set", "overlap": "set", "tfidf": "vector", "bm25": "vector", "count_cosine": "vector", "rare": "rare", "phrase": "phrase",
    "lcs": "order", "alignment": "order", "support": "grammar",
}
#: The four detectors that propose, and the nine that score a proposed pair.
PROPOSERS = ("tfidf", "overlap", "bm25", "rare")
NINE = ("jaccard", "weighted_jaccard", "tfidf", "bm25", "rare", "phrase", "lcs", "alignment", "support")

#: Features of most passages, whose numbers and frequencies every task of a search gets; all others are joined.
HEAD = 32_768
#: Features of at least this part of the passages, so many at most, are multiplied as matrices.
DENSE, DENSE_WORDS = 0.06, 512
#: Passages of a block, as long as there are no more than BLOCKS of them; beyond, blocks grow to MOST_PASSAGES.
PASSAGE_BLOCK, BLOCKS, MOST_PASSAGES = 8_192, 24, 65_536
#: Queries of a cell, and best partners a task holds at most.
QUERY_BLOCK, HELD = 32_768, 1 << 22
#: Passages that stream past the queries at once, queries whose scores are computed at once, and a score that no rounding makes count.
STREAM, CHUNK, LEAST = 4_096, 64, 1e-12
#: Pairs of a cell that are scored at once.
CELL_PAIRS = 131_072


def profiles(post: DataFrame, n_docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Postings with every weight a detector sums: pid, feature, tf, df, cf, idf, w (unit tf-idf), c (unit counts), bm (BM25).

    Lengths, norms and frequencies are over all features. n_docs: one row with the column n.
    """
    per = post.groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    mean = post.groupBy("pid").agg(F.sum("tf").alias("len")).agg(F.avg("len").alias("mean_len"))
    own = Window.partitionBy("pid")  # one passage
    p = post.join(per, "feature").crossJoin(X.one_row(n_docs)).crossJoin(X.one_row(mean))
    tf = F.col("tf").cast("double")
    p = p.withColumns({"idf": X.smooth_idf(F.col("df"), F.col("n")), "len": F.sum("tf").over(own)}).withColumn("raw", X.tf_weight(F.col("tf")) * F.col("idf"))
    return p.select(
        "pid", "feature", "tf", "df", "cf", "idf", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(own))).alias("w"), (tf / F.sqrt(F.sum(tf * tf).over(own))).alias("c"),
        (X.bm25_idf(F.col("df"), F.col("n")) * tf * (k1 + 1) / (tf + F.lit(k1) * (1 - b + F.lit(b) * F.col("len") / F.col("mean_len")))).alias("bm"),
    )


def scores(prof: DataFrame, queries: DataFrame, keep: Column | None = None, pairs: DataFrame | None = None, rare: int = 3) -> DataFrame:
    """Every query of ``queries(pid)`` against all other passages that share a feature with it: q, t, overlap, tfidf,
    count_cosine, bm25, rare, jaccard, weighted_jaccard (by idf).

    ``keep``, a condition on a profile's row, restricts the shared features, for proposals; ``pairs(q, t)`` restricts the
    pairs instead, and scores them over all features. Sums combine before the shuffle by pair; columns not asked for
    aren't computed.
    """
    shared = prof if keep is None else prof.filter(keep)
    x = shared.join(queries.select("pid").distinct(), "pid", "left_semi").select("feature", F.col("pid").alias("q"), *[F.col(c).alias(f"{c}_q") for c in ("tf", "cf", "idf", "w", "c")])
    if pairs is not None:
        x = x.join(pairs.select("q", "t"), "q")
    y = shared.select("feature", F.col("pid").alias("t"), *[F.col(c).alias(f"{c}_t") for c in ("tf", "w", "c", "bm")])
    met = x.join(y, ["feature"] if pairs is None else ["feature", "t"]).filter("q <> t")
    sums = met.groupBy("q", "t").agg(
        F.count("*").alias("k"), F.sum(F.col("w_q") * F.col("w_t")).alias("tfidf"), F.sum(F.col("c_q") * F.col("c_t")).alias("count_cosine"), F.sum("bm_t").alias("bm25"),
        F.sum(F.when(F.col("cf_q") <= rare, 1.0 / F.col("cf_q")).otherwise(0.0)).alias("rare"), F.sum(F.col("idf_q") * F.least("tf_q", "tf_t")).alias("low"),
    )
    size = prof.groupBy("pid").agg(F.count("*").alias("n"), F.sum(F.col("idf") * F.col("tf")).alias("s"))
    side = lambda c: size.select(F.col("pid").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"s_{c}"))
    both = sums.join(side("q"), "q").join(side("t"), "t")
    return both.select(
        "q", "t", F.col("k").cast("double").alias("overlap"), "tfidf", "count_cosine", "bm25", "rare", (F.col("k") / (F.col("n_q") + F.col("n_t") - F.col("k"))).alias("jaccard"),
        (F.col("low") / (F.col("s_q") + F.col("s_t") - F.col("low"))).alias("weighted_jaccard"),
    )


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, one range after another."""
    return np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)


def _weights(of: np.ndarray, size: int, col: dict[str, np.ndarray], n_docs: int, mean: float, k1: float, b: float) -> dict[str, np.ndarray]:
    """What a detector sums, as in ``profiles()``, of the rows of ``size`` passages: ``of`` is a row's passage."""
    tf, df = col["tf"].astype(float), col["df"].astype(float)
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    raw = (np.log(tf) + 1.0) * idf
    return {
        "tf": tf, "df": df, "cf": col["cf"].astype(float), "idf": idf, "n": np.bincount(of, minlength=size).astype(float), "s": np.bincount(of, idf * tf, size),
        "w": raw / np.sqrt(np.bincount(of, raw * raw, size))[of], "c": tf / np.sqrt(np.bincount(of, tf * tf, size))[of],
        "bm": np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.bincount(of, tf, size)[of] / mean)),
    }


def bags_of(sequences: DataFrame) -> DataFrame:
    """The words of every passage with their counts, a row a passage: pid, words, tfs. sequences(pid, seq), a pid once; a
    passage without words has no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column("seq")
            enc = seq.flatten().dictionary_encode()
            n = max(len(enc.dictionary), 1)
            of = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(seq), 0).to_numpy())
            key, tf = np.unique(of * n + enc.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(key // n, np.arange(len(b) + 1)).astype(np.int32))
            words, tfs = pa.ListArray.from_arrays(ends, enc.dictionary.take(pa.array(key % n))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))
            out = pa.RecordBatch.from_arrays([b.column("pid"), words, tfs], ["pid", "words", "tfs"])
            yield out.filter(pc.greater(pc.list_value_length(words), 0))

    return sequences.select("pid", "seq").mapInArrow(count, f"pid {sequences.schema['pid'].dataType.simpleString()}, words array<string>, tfs array<bigint>")


def unpacked(bags: DataFrame) -> DataFrame:
    """Postings (pid, feature, tf) of rows (pid, words, tfs)."""
    return bags.select("pid", F.explode(F.arrays_zip("words", "tfs")).alias("e")).select("pid", F.col("e.words").alias("feature"), F.col("e.tfs").alias("tf"))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after another, and where each begins and the last ends."""
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    data = blobs.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)), ends - ends[0]


def _kept(q: np.ndarray, t: np.ndarray, v: np.ndarray, n: int, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the scores ``v`` of each of ``n`` queries the k highest, of equal ones the first, and all that rounding by ``slack`` may
    lift to them; and each query's k-th, -1 if it has fewer."""
    order = np.lexsort((t, -v, q))
    q, t, v = q[order], t[order], v[order]
    at = np.arange(len(q))
    first = np.searchsorted(q, np.arange(n + 1))
    kth = np.where(np.diff(first) >= k, v[np.minimum(first[:-1] + k - 1, len(v) - 1)], -1.0) if len(v) else np.full(n, -1.0)
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])[: len(q)]
    keep = (at - first[q] < k) | ((v >= kth[q] - slack) & (at - np.maximum.accumulate(np.where(new, at, 0)) < k))
    return q[keep], t[keep], v[keep], kth


class _Side:
    """Passages as rows (passage, word) with their weights, the words as numbers."""

    def __init__(self, t: pa.Table, tail_words: pa.Array | None, freq: np.ndarray, weigh: tuple, ratio: float | None):
        self.ids = t.column("pid").combine_chunks()
        codes, ends = _bytes(t.column("codes").combine_chunks())
        tfs, tf_ends = _bytes(t.column("tfs").combine_chunks())
        many = np.diff(ends) // 2
        of, code = np.repeat(np.arange(len(many)), many), codes.copy().view(np.uint16).astype(np.int64)
        wide = np.diff(tf_ends) > many  # eight bytes a count, else one
        tf = np.empty(len(code), np.int64)
        place = np.arange(len(code)) - np.repeat(np.cumsum(many) - many, many)
        one = ~wide[of]
        tf[one] = tfs[tf_ends[of[one]] + place[one]]
        if not one.all():
            tf[~one] = tfs[(tf_ends[of[~one]] + 8 * place[~one])[:, None] + np.arange(8)].view(np.int64)[:, 0]
        col = {"tf": tf, "df": freq[0][code], "cf": freq[1][code]}
        if "tail" in t.column_names:
            rest = t.column("tail").combine_chunks()
            n = pc.fill_null(pc.list_value_length(rest), 0).to_numpy()
            e = rest.flatten()
            word = e.field("feature")
            if tail_words is None:
                tail_words = word.unique()
            own = pc.fill_null(pc.index_in(word, value_set=tail_words), -1 - len(freq[0])).to_numpy().astype(np.int64) + len(freq[0])  # -1 meets nothing
            of = np.concatenate([of, np.repeat(np.arange(len(n)), n)])
            order = np.argsort(of, kind="stable")
            of, code = of[order], np.concatenate([code, own])[order]
            col = {c: np.concatenate([x, e.field(c).to_numpy(zero_copy_only=False)])[order] for c, x in col.items()}
        self.tail_words, self.of, self.code, self.size = tail_words, of, code, len(self.ids)
        self.w = _weights(of, self.size, col, *weigh)
        self.use = code >= 0 if ratio is None else (code >= 0) & (self.w["df"] <= weigh[0] * ratio)


def _by_word(side: _Side, rows: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given rows in order of their words, where each word's begin, and how many they are."""
    rows = rows[np.argsort(side.code[rows], kind="stable")]
    many = np.bincount(side.code[rows], minlength=codes)
    return rows, np.cumsum(many) - many, many


class _Cell:
    """Queries that meet passages, block after block in the order of their identifiers; the best of each query so far.

    Words of many passages, the first ``dense`` numbers, are multiplied as matrices, the others by their postings."""

    def __init__(self, x: _Side, names: tuple[str, ...], k: int, slack: list[float], rare: int, dense: int, head: int):
        self.x, self.names, self.k, self.slack, self.rare, self.dense = x, names, k, slack, rare, dense
        self.bounds = np.searchsorted(x.of, np.arange(x.size + 1))
        self.codes = head + (len(x.tail_words) if x.tail_words is not None else 0)
        none = np.empty(0, np.int64)
        self.best = [(none, none, np.empty(0)) for _ in names]
        self.new: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in names]
        self.kth = [np.full(x.size, -1.0) for _ in names]
        self.ids: list[pa.Array] = []
        self.seen = 0

    def settle(self) -> None:
        for j in range(len(self.names)):
            if self.new[j]:
                q, t, v = (np.concatenate(c) for c in zip(self.best[j], *self.new[j]))
                *best, self.kth[j] = _kept(q, t, v, self.x.size, self.k, self.slack[j])
                self.best[j], self.new[j] = tuple(best), []

    def _matrix(self, side: _Side, rows: np.ndarray, first: int, size: int, values: np.ndarray | float) -> np.ndarray:
        out = np.zeros((size, self.dense), np.float32 if isinstance(values, float) else np.float64)
        out[side.of[rows] - first, side.code[rows]] = values
        return out

    def meet(self, y: _Side) -> None:
        x, names, size = self.x, set(self.names), y.size
        order, start, many = _by_word(y, np.flatnonzero(y.use), self.codes)
        place = y.of[order]
        common = np.flatnonzero(y.use & (y.code < self.dense))
        counts = {"overlap", "jaccard"} & names
        of_y = {n: self._matrix(y, common, 0, size, y.w[c][common]).T for n, c in (("tfidf", "w"), ("count_cosine", "c"), ("bm25", "bm")) if n in names}
        if counts or "weighted_jaccard" in names:
            of_y["overlap"] = self._matrix(y, common, 0, size, 1.0).T
        if "weighted_jaccard" in names:
            of_y["weighted_jaccard"] = of_y["overlap"].astype(float)
            more, more_start, more_many = _by_word(y, common[y.w["tf"][common] > 1], self.codes)
        found = pc.index_in(y.ids, value_set=x.ids)
        mine = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        who = found.take(pa.array(mine)).to_numpy().astype(np.int64)
        for lo in range(0, x.size, CHUNK):
            hi = min(lo + CHUNK, x.size)
            rows = np.arange(self.bounds[lo], self.bounds[hi])
            rows = rows[x.use[rows]]
            low_rows, rest = rows[x.code[rows] < self.dense], rows[x.code[rows] >= self.dense]
            reps = many[x.code[rest]]
            hit = _ranges(start[x.code[rest]], reps)
            to = np.repeat((x.of[rest] - lo) * size, reps) + place[hit]
            hit = order[hit]
            total = lambda at, v, n=hi - lo: np.bincount(at, v, n * size).reshape(n, size)
            each = lambda c, rest=rest, reps=reps: np.repeat(x.w[c][rest], reps)
            own = lambda c, low_rows=low_rows, lo=lo, hi=hi: self._matrix(x, low_rows, lo, hi - lo, 1.0 if c is None else x.w[c][low_rows])
            shared = (own(None) @ of_y["overlap"]).astype(float) + total(to, None) if counts else None
            at = (who >= lo) & (who < hi)
            for j, name in enumerate(self.names):
                if name == "overlap":
                    score = shared.copy()
                elif name == "jaccard":
                    score = shared / (x.w["n"][lo:hi, None] + y.w["n"] - shared)
                elif name == "tfidf":
                    score = own("w") @ of_y[name] + total(to, each("w") * y.w["w"][hit])
                elif name == "count_cosine":
                    score = own("c") @ of_y[name] + total(to, each("c") * y.w["c"][hit])
                elif name == "bm25":
                    score = own(None).astype(float) @ of_y[name] + total(to, y.w["bm"][hit])
                elif name == "rare":
                    few = rows[x.w["cf"][rows] <= self.rare]
                    r = many[x.code[few]]
                    score = total(np.repeat((x.of[few] - lo) * size, r) + place[_ranges(start[x.code[few]], r)], np.repeat(1.0 / x.w["cf"][few], r))
                else:
                    both = low_rows[x.w["tf"][low_rows] > 1]  # what counts above one add to the matrices' one
                    r = more_many[x.code[both]]
                    over = more[_ranges(more_start[x.code[both]], r)]
                    low = own("idf") @ of_y[name] + total(to, each("idf") * np.minimum(each("tf"), y.w["tf"][hit]))
                    low += total(np.repeat((x.of[both] - lo) * size, r) + y.of[over], np.repeat(x.w["idf"][both], r) * (np.minimum(np.repeat(x.w["tf"][both], r), y.w["tf"][over]) - 1))
                    score = low / (x.w["s"][lo:hi, None] + y.w["s"] - low)
                score[who[at] - lo, mine[at]] = 0
                kth = self.kth[j][lo:hi]
                # whole numbers tie exactly, and later passages come after those that are held
                edge = np.where(kth > 0, kth + 0.5 if name == "overlap" else kth - self.slack[j], LEAST)
                parts = max(self.k, 64)
                if wide := size // parts:
                    top = score[:, : wide * parts].reshape(hi - lo, parts, wide).max(2)
                    edge = np.maximum(edge, np.partition(top, parts - self.k, axis=1)[:, parts - self.k] - self.slack[j])
                q, t = np.nonzero(score >= np.maximum(edge, LEAST)[:, None])
                self.new[j].append((q + lo, t + self.seen, score[q, t]))
        self.ids.append(y.ids)
        self.seen += size
        self.settle()

    def out(self) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids) if self.ids else self.x.ids[:0]
        for j in range(len(self.names)):
            q, t, v = self.best[j]
            for lo in range(0, len(q), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                detector = pa.array(np.full(len(q[cut]), j, np.int32))
                yield pa.RecordBatch.from_arrays([detector, self.x.ids.take(pa.array(q[cut])), ids.take(pa.array(t[cut])), pa.array(v[cut])], ["detector", "q", "t", "score"])


class _Numbered(NamedTuple):
    """Passages as rows (pid, asks, codes, tfs and, with more words than numbers, tail), the numbered words' frequencies, and sizes."""

    rows: DataFrame
    freq: np.ndarray
    words: int
    n_docs: int
    queries: int
    mean: float


def _numbered(bags: DataFrame, head: int) -> _Numbered:
    """bags(pid, asks, words, tfs), written. The ``head`` words of most passages are numbered on the driver, all others are joined."""
    tfs = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)
    one = bags.agg(F.count("pid").alias("n"), F.count_if(F.col("asks") & F.col("pid").isNotNull()).alias("q"), F.sum(tfs).alias("tf"), F.max(F.col("pid").isNull().cast("int")).alias("nameless")).collect()[0]  # one row
    n_docs, mean = one.n, (one.tf or 0) / max(one.n + (one.nameless or 0), 1)  # passages without identifier count as one, and only here and in frequencies
    vocabulary = unpacked(bags).groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    top = vocabulary.orderBy(F.desc("df"), "feature").limit(head + 1).collect()  # a fixed number of rows
    tailed, top = len(top) > head, top[:head]
    words, freq = pa.array([r.feature for r in top], pa.string()), np.array([[r.df for r in top], [r.cf for r in top]], np.int64).reshape(2, -1)
    kind = bags.schema["pid"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            many = pc.list_value_length(r.column("words")).to_numpy()
            code = pc.fill_null(pc.index_in(r.column("words").flatten(), value_set=words), -1).to_numpy()
            fine = code >= 0
            ends = np.searchsorted(np.repeat(np.arange(len(r)), many)[fine], np.arange(len(r) + 1))
            tf = r.column("tfs").flatten().to_numpy()[fine]
            tf = tf if len(tf) and tf.max() > 255 else tf.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([r.column("pid"), r.column("asks"), _binary(code[fine].astype(np.uint16), ends), _binary(tf, ends)], ["pid", "asks", "codes", "tfs"])

    rows = bags.filter("pid is not null").mapInArrow(encode, f"pid {kind}, asks boolean, codes binary, tfs binary")
    if tailed:
        last = top[-1]
        rest = vocabulary.filter((F.col("df") < last.df) | ((F.col("df") == last.df) & (F.col("feature") > last.feature)))
        rest = unpacked(bags.filter("pid is not null")).join(rest, "feature").groupBy("pid").agg(F.collect_list(F.struct("feature", "tf", "df", "cf")).alias("tail"))
        rows = rows.join(rest, "pid", "left")
    return _Numbered(rows, freq, len(words), n_docs, one.q, mean)


def pair_scores(bags: DataFrame, pairs: DataFrame, k1: float = 1.2, b: float = 0.75, rare: int = 3, head: int = HEAD) -> DataFrame:
    """What ``scores(…, pairs=pairs)`` gives, for passages as rows (pid, words, tfs), a pid once, without a row for every word of a pair.

    Pairs go to cells by their second passage; a passage moves once to each cell that needs it.
    """
    bags = materialize(bags.select("pid", F.lit(False).alias("asks"), "words", "tfs"))
    rows, freq, _, n_docs, _, mean = _numbered(bags, head)
    pairs = materialize(pairs.select("q", "t").filter("q <> t"))
    n_cells = max(shuffle_width(bags.sparkSession), -(-pairs.count() // CELL_PAIRS))
    kind, weigh = bags.schema["pid"].dataType.simpleString(), (n_docs, mean, k1, b)
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("t", F.lit(1)), F.lit(n_cells)).cast("int"))
    need = dealt.select("cell", F.col("q").alias("pid")).union(dealt.select("cell", F.col("t").alias("pid"))).distinct().join(rows.drop("asks"), "pid")
    names = ["overlap", "tfidf", "count_cosine", "bm25", "rare", "jaccard", "weighted_jaccard"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([left.column("q")[:0], left.column("t")[:0], *[pa.array([], pa.float64())] * len(names)], ["q", "t", *names])
        x = _Side(right, None, freq, weigh, None)
        bounds, place = np.searchsorted(x.of, np.arange(x.size + 1)), np.full(x.code.max(initial=-1) + 1, -1)
        at = [pc.index_in(left.column(c).combine_chunks(), value_set=x.ids) for c in "qt"]
        left = left.filter(pc.and_(*[c.is_valid() for c in at]))
        q, t = (c.filter(pc.and_(*[e.is_valid() for e in at])).to_numpy().astype(np.int64) for c in at)
        order = np.argsort(q, kind="stable")
        left, q, t = left.take(pa.array(order)), q[order], t[order]
        out = np.zeros((len(names), len(q)))
        firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else []
        for lo, hi in zip(firsts, [*firsts[1:], len(q)]):
            own = np.arange(bounds[q[lo]], bounds[q[lo] + 1])
            place[x.code[own]] = own
            many = bounds[t[lo:hi] + 1] - bounds[t[lo:hi]]
            theirs, of = _ranges(bounds[t[lo:hi]], many), np.repeat(np.arange(hi - lo), many)
            mine = place[x.code[theirs]]
            hit = mine >= 0
            theirs, of, mine = theirs[hit], of[hit], mine[hit]
            place[x.code[own]] = -1
            total = lambda v, of=of, n=hi - lo: np.bincount(of, v, n)
            k, low = total(None), total(x.w["idf"][mine] * np.minimum(x.w["tf"][mine], x.w["tf"][theirs]))
            cf, n, s = x.w["cf"][mine], x.w["n"], x.w["s"]
            out[:, lo:hi] = (
                k, total(x.w["w"][mine] * x.w["w"][theirs]), total(x.w["c"][mine] * x.w["c"][theirs]), total(x.w["bm"][theirs]), total(np.where(cf <= rare, 1.0 / cf, 0.0)),
                k / (n[q[lo]] + n[t[lo:hi]] - k), low / (s[q[lo]] + s[t[lo:hi]] - low),
            )
        found = pa.array(out[0] > 0)
        return pa.Table.from_arrays([left.column("q"), left.column("t"), *map(pa.array, out)], ["q", "t", *names]).filter(found)

    schema = f"q {kind}, t {kind}, " + ", ".join(f"{n} double" for n in names)
    return dealt.groupBy("cell").cogroup(need.toDF(*need.columns).groupBy("cell")).applyInArrow(meet, schema)


def best_partners(
    post: DataFrame, asks: Column, names: tuple[str, ...], k: int, decimals: dict[str, int] | None = None, ratio: float | None = None,
    k1: float = 1.2, b: float = 0.75, rare: int = 3, passages: int | None = None, queries: int | None = None, head: int = HEAD,
) -> DataFrame:
    """The ``k`` best partners of every query by each detector, as ``rank_by(scores(…))`` has them, without a row for every pair:
    detector, q, t, score, rank (1 to ``k``; scores above 0).

    post(pid, feature, tf), a feature of a passage once, or post(pid, words, tfs), a passage once; ``asks``, a condition on a
    row's pid, names the queries. ``ratio``: features of more than this part of the passages don't count as shared, sizes
    and norms are over all.

    A passage is one row with its features as numbers; the ``head`` features of most passages are numbered on the driver and
    sent with the task, all others are joined. Blocks of about ``queries`` queries meet blocks of about ``passages``
    passages, by hash, so every pair meets in one cell. A task holds the queries of a cell; passages stream past them,
    and only a query's best leave the cell.
    """
    spark = post.sparkSession
    if "words" in post.columns:
        bags = post.select("pid", F.coalesce(asks, F.lit(False)).alias("asks"), "words", "tfs")
    else:
        bags = post.select("pid", F.coalesce(asks, F.lit(False)).alias("asks"), F.struct("feature", F.col("tf").cast("bigint").alias("tf")).alias("e"))
        bags = bags.groupBy("pid").agg(F.max("asks").alias("asks"), F.collect_list("e").alias("e")).select("pid", "asks", F.col("e.feature").alias("words"), F.col("e.tf").alias("tfs"))
    bags = materialize(bags)
    rows, freq, n_words, n_docs, n_queries, mean = _numbered(bags, head)
    extra = ["tail"] if "tail" in rows.columns else []
    dense = min(DENSE_WORDS, int((freq[0] >= DENSE * n_docs).sum()))
    kind = post.schema["pid"].dataType.simpleString()
    n_blocks = -(-n_docs // passages) if passages else max(min(-(-n_docs // PASSAGE_BLOCK), BLOCKS), -(-n_docs // MOST_PASSAGES))
    n_blocks, q_blocks = max(1, n_blocks), max(1, -(-n_queries // (queries or max(1, min(QUERY_BLOCK, HELD // (k * len(names)))))))
    at = F.xxhash64("pid", F.lit(1))
    rows = rows.withColumns({"_b": F.pmod(at, F.lit(n_blocks)).cast("int"), "_q": F.pmod(at, F.lit(q_blocks)).cast("int")})
    others = F.transform(F.sequence(F.lit(0), F.lit(q_blocks - 1)), lambda q: F.struct((q * n_blocks + F.col("_b")).cast("bigint").alias("cell"), F.lit(True).alias("other")))
    own = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda p: F.struct((F.col("_q") * n_blocks + p).cast("bigint").alias("cell"), F.lit(False).alias("other")))
    dealt = rows.withColumn("e", F.explode(F.when(F.col("asks"), F.concat(own, others)).otherwise(others))).select("e.cell", "e.other", "pid", "codes", "tfs", *extra)
    width = min(n_blocks * q_blocks, 16 * shuffle_width(spark))
    cells = dealt.repartitionById(width, F.pmod("cell", F.lit(width)).cast("int")).sortWithinPartitions("cell", "other", "pid")
    slack = [0.0 if n == "overlap" else 2 * 10.0 ** -(decimals or {}).get(n, 9) for n in names]
    weigh = (n_docs, mean, k1, b)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one cell and side
        cell: _Cell | None = None
        now = (-1, False)

        def passed() -> None:
            nonlocal cell, held
            if held:
                t, held = pa.Table.from_batches(held), []
                if not now[1]:
                    cell = _Cell(_Side(t, None, freq, weigh, ratio), names, k, slack, rare, dense, n_words)
                elif cell is not None:
                    cell.meet(_Side(t, cell.x.tail_words, freq, weigh, ratio))

        for batch in batches:
            no, other = batch.column("cell").to_numpy(), batch.column("other").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((no[1:] != no[:-1]) | (other[1:] != other[:-1])) + 1).tolist(), len(no)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if (int(no[lo]), bool(other[lo])) != now:
                    passed()
                    if no[lo] != now[0] and cell is not None:
                        yield from cell.out()
                        cell = None
                    now = (int(no[lo]), bool(other[lo]))
                while lo < hi:
                    room = hi - lo if not now[1] else min(hi - lo, STREAM - sum(map(len, held)))
                    held.append(batch.slice(lo, room))
                    lo += room
                    if now[1] and sum(map(len, held)) >= STREAM:
                        passed()
        passed()
        if cell is not None:
            yield from cell.out()

    found = cells.mapInArrow(meet, f"detector int, q {kind}, t {kind}, score double")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("detector") + 1)
    exact = F.lit(None).cast("double")
    for n in names:
        exact = F.when(F.col("detector") == n, F.round("score", (decimals or {}).get(n, 9))).otherwise(exact)
    found = found.withColumn("detector", name).withColumn("score", exact).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("detector", "q").orderBy(F.desc("score"), "t"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("detector", "q", "t", "score", "rank")


def rank_by(scored: DataFrame, names: tuple[str, ...], k: int, decimals: dict[str, int] | None = None) -> DataFrame:
    """The rankings of several score columns, unpivoted: detector, q, t, score, rank (1 to ``k``; scores above 0)."""
    long = scored.select("q", "t", F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.round(n, (decimals or {}).get(n, 9)).alias("score")) for n in names])).alias("e")).select("e.*", "q", "t")
    rank = F.row_number().over(Window.partitionBy("detector", "q").orderBy(F.desc("score"), "t"))
    return long.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("detector", "q", "t", "score", "rank")


def propose(post: DataFrame, queries: DataFrame | Column, n_docs: DataFrame | None, k: int = 250, ratio: float = 0.25, decimals: dict[str, int] | None = None, blocks: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """The ``k`` best partners of every query by fusion of the four proposing detectors: q, t, rrf, proposals.

    Features of more than ``ratio`` of the passages don't propose. Each detector proposes its ``k`` best. ``queries`` are
    the pids of a table, or a condition on a pid of ``post``, as in ``best_partners()``; ``blocks`` are its passages and queries of
    a block. ``n_docs`` is not needed any more.
    """
    asks = queries
    if isinstance(queries, DataFrame):
        post = post.select("pid", "feature", "tf")
        post, asks = post.join(queries.select("pid").distinct().withColumn("asks", F.lit(True)), "pid", "left"), F.col("asks").isNotNull()
        post = post.select("pid", "feature", "tf", asks.alias("asked"))
        asks = F.col("asked")
    ranked = best_partners(post, asks, PROPOSERS, k, decimals, ratio, passages=blocks[0], queries=blocks[1])
    fused = R.fuse(ranked).withColumn("rrf", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), "t"))
    return fused.withColumn("r", rank).filter(F.col("r") <= k).select("q", "t", "rrf", F.col("detectors").alias("proposals"))


def phrase_scores(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Sum of the weights of the phrases that given pairs share: q, t, phrase. own(pid, phrase, weight), distinct."""
    x = pairs.select("q", "t").join(own.select(F.col("pid").alias("q"), "phrase", "weight"), "q")
    return x.join(own.select(F.col("pid").alias("t"), "phrase"), ["t", "phrase"]).groupBy("q", "t").agg(F.sum("weight").alias("phrase"))


def rerank(pairs: DataFrame, sequences: DataFrame, layers: list[Column], idf: DataFrame, align: int = 25, persisted: int = 100, keep: int = 25) -> tuple[DataFrame, DataFrame]:
    """Order scores for scored pairs, the ranks of all nine detectors, and their fusion.

    pairs(q, t, tfidf, …) from ``scores()`` with a column phrase; sequences(pid, seq); ``layers`` are annotations of ``seq`` as
    arrays of the same length; idf(feature, idf) weighs matches. All pairs get the LCS of words over the shorter text
    and the mean of that of the layers; the first ``align`` of a query by (lcs, tfidf, t) are aligned. Out: the ranks
    (detector, q, t, score, rank up to ``persisted``), and the ``keep`` best of a query by fusion, one detector a family.
    """
    side = lambda c: sequences.select(F.col("pid").alias(c), F.col("seq").alias(f"s_{c}"), *[x.alias(f"l{k}_{c}") for k, x in enumerate(layers)])
    x = pairs.join(side("q"), "q").join(side("t"), "t")
    part = lambda a, b: D.lcs_score(D.lcs_length(a, b), F.col(a), F.col(b))
    support = sum((part(f"l{k}_q", f"l{k}_t") for k in range(len(layers))), F.lit(0.0)) / max(len(layers), 1)
    x = x.withColumns({"lcs": F.round(part("s_q", "s_t"), 9), "support": F.round(support, 9)})
    # written once, without the sequences, which only aligned pairs need again
    x = materialize(x.drop("s_q", "s_t", *[f"l{k}_{c}" for k in range(len(layers)) for c in "qt"]))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lcs"), F.desc(F.round("tfidf", 9)), "t"))
    x = x.withColumn("r", first)
    weights = sequences.select("pid", F.posexplode("seq").alias("p", "feature")).join(idf.select("feature", "idf"), "feature", "left")
    weights = weights.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("idf", F.lit(1.0)).alias("v")))), lambda e: e["v"]).alias("v"))
    weights = materialize(sequences.select("pid", "seq").join(weights, "pid"))
    weighed = lambda c: weights.select(F.col("pid").alias(c), F.col("seq").alias(f"s_{c}"), F.col("v").alias(f"v_{c}"))
    near = x.filter(F.col("r") <= align).select("q", "t").join(weighed("q"), "q").join(weighed("t"), "t")
    aligned = near.select("q", "t", F.round(D.weighted_alignment("s_q", "s_t", "v_q", "v_t"), 9).alias("alignment"))
    full = x.drop("r").join(aligned, ["q", "t"], "left").na.fill(0.0, ["alignment", "phrase"])
    ranked = rank_by(full, NINE, persisted)
    fused = R.fuse(ranked, families=FAMILIES, best_of_family=True).withColumn("score", F.round("score", 9))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))
    return ranked, fused.withColumn("rank", best).filter(F.col("rank") <= keep).select("q", "t", "score", "rank", F.col("detectors").alias("families"))
