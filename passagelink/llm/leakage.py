"""Evaluation passages that occur, whole, in part or altered, inside a training corpus."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words of an item that make a case; share of its words in order; length of the stretch against the item's.
RUN, SHARE, STRETCH = 12, 0.6, 1.5
#: Random walks, samples of each walk, sampled steps of a signature, and steps of a walk samples are drawn from (by turns).
WALKS, SAMPLES, BITS, STEPS = 5, 3, 5, (7, 9, 13)
SEED = 7_2017
#: Words of items that one pass over the corpus looks for, 200 bytes each in every worker; more items take more passes.
PASS_WORDS = 500_000


def _marks(begin: int, end: int) -> re.Pattern:
    """Runs of combining marks and invisible characters of a range of code points."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(begin, end) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")) + "]+")


_WORD = re.compile(r"[^\W_]+")
# marks of the first plane are a table look-up for the pattern engine, those beyond are not, and rare
_MARK, _FAR, _FAR_MARK = _marks(0, 0x10000), re.compile("[\U00010000-\U0010ffff]"), _marks(0x10000, sys.maxunicode + 1)


def unmarked(text: str) -> str:
    """A text without combining marks and invisible characters."""
    if text.isascii():
        return text
    text = _MARK.sub("", text)
    return _FAR_MARK.sub("", text) if _FAR.search(text) else text


def fold(word: str) -> str:
    """A word without letter case, diacritics and invisible characters."""
    return unmarked(unicodedata.normalize("NFD", word.casefold()))


def pieces(text: str) -> list[str]:
    """The words of a text as they are written, without marks and invisible characters."""
    return _WORD.findall(unmarked(text))


def words(text: str) -> list[str]:
    """The words of a text: maximal runs of letters and digits, folded."""
    return [fold(w) for w in pieces(text)]


class Items:
    """Evaluation items prepared for the search: vocabulary, word numbers, and the signatures of every offset."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.seq, self.vocabulary = [], [], {}
        for i, t in items:
            if w := words(t or ""):
                self.ids.append(i)
                self.seq.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        rng = np.random.default_rng(SEED)
        size = len(self.vocabulary) + 1
        most = max(STEPS)
        # the random bit of a walk for every step and word
        self.coins = rng.integers(0, 2, (WALKS, most, size), dtype=np.int8)
        self.samples = [[np.sort(rng.permutation(STEPS[(w + s) % len(STEPS)])[:BITS]) for s in range(SAMPLES)] for w in range(WALKS)]
        self.mix = rng.integers(1, 2**62, BITS, dtype=np.int64) | 1
        self.known: dict[int, tuple[np.ndarray, dict[int, int]]] = {}
        flat = np.concatenate([np.array([*s, *[0] * most], np.int32) for s in self.seq]) if self.seq else np.zeros(0, np.int32)
        item = np.concatenate([np.full(len(s) + most, k, np.int32) for k, s in enumerate(self.seq)]) if self.seq else np.zeros(0, np.int32)
        starts = np.flatnonzero(flat)
        self.tables = []
        for w in range(WALKS):
            out = self.walk(flat, starts, w)
            for s in self.samples[w]:
                code, fine = self.signature(out, s)
                pair = np.unique(np.stack([code[fine], item[starts][fine].astype(np.int64)], 1), axis=0)
                self.tables.append((pair[:, 0].copy(), pair[:, 1].copy()))
        self.lengths = np.array(sorted({len(s) for s in self.seq}), np.int64)

    def item(self, k: int) -> tuple[np.ndarray, dict[int, int]]:
        """The distinct words of an item, and for each the places where it stands, as bits; made when first asked for."""
        if k not in self.known:
            places: dict[int, int] = {}
            for j, x in enumerate(self.seq[k]):
                places[x] = places.get(x, 0) | 1 << j
            self.known[k] = np.array(sorted(places), np.int32), places
        return self.known[k]

    def walk(self, flat: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
        """Random-walk embedding of the text from each start: at every step the current word is put out, and a coin that
        depends on step and word decides whether the walk goes on to the next word. Edits shift the walk, and chance
        brings shifted walks together again, so that edit distance turns into Hamming distance."""
        at = starts.copy()
        out = np.empty((max(STEPS), len(starts)), np.int32)
        last = len(flat) - 1
        for j in range(max(STEPS)):
            out[j] = flat[at]
            at = np.minimum(at + self.coins[w, j][out[j]], last)
        return out

    def signature(self, out: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of the sampled steps, and whether every sampled word is a word of some item."""
        picked = out[sample].astype(np.int64)
        with np.errstate(over="ignore"):
            code = (picked * self.mix[:, None]).sum(0)
        return code, (picked > 0).all(0)

    def dense(self, flat: np.ndarray) -> np.ndarray:
        """Positions of words of items that lie in some stretch with as many words of items as a case needs; no case lies outside."""
        n = len(flat)
        hit = np.concatenate([[0], np.cumsum(flat > 0)])
        at = np.flatnonzero(flat)
        # lengths in groups of four: the widest stretch and the fewest words of a group
        groups = [self.lengths[(self.lengths // 4) == g] for g in np.unique(self.lengths // 4)]
        shapes = {(int(STRETCH * g.max()), need(int(g.min()))) for g in groups} | {(RUN, RUN)}
        cover = np.zeros(n + max(w for w, _ in shapes) + 1, np.int32)
        for wide, least in shapes:
            begin = at[hit[np.minimum(at + wide, n)] - hit[at] >= least]
            cover[begin] += 1
            cover[begin + wide] -= 1
        return at[np.cumsum(cover[:n])[at] > 0]

    def candidates(self, flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item) numbers that share a signature."""
        starts, many = self.dense(flat), max(1, len(self.seq))
        got = [np.empty(0, np.int64)]
        for w in range(WALKS if len(starts) else 0):
            out = self.walk(flat, starts, w)
            for s, sample in enumerate(self.samples[w]):
                known, item = self.tables[w * SAMPLES + s]
                code, fine = self.signature(out, sample)
                code, at = code[fine], starts[fine]
                lo, hi = np.searchsorted(known, code, "left"), np.searchsorted(known, code, "right")
                some = hi > lo
                lo, n, at = lo[some], (hi - lo)[some], at[some]
                pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                got.append(np.unique(np.repeat(doc[at], n) * many + item[pick]))
        return np.stack(np.divmod(np.unique(np.concatenate(got)), many), 1)

    def occurs(self, a: np.ndarray, k: int) -> bool:
        """Whether the word numbers of a document hold a case of item k. Exact."""
        size = len(self.seq[k])
        (own, masks), least, wide = self.item(k), need(size), int(STRETCH * size)
        pos = np.flatnonzero(own[np.minimum(np.searchsorted(own, a), len(own) - 1)] == a)
        if len(pos) < min(least, RUN):
            return False
        # consecutive words
        if size >= RUN and len(pos) >= RUN and (pos[RUN - 1 :] - pos[: len(pos) - RUN + 1] == RUN - 1).any():
            # live[j]: ends, in the item, of the common runs of j + 1 words that end here
            live, before = [], -2
            for p in pos.tolist():
                m = masks[int(a[p])]
                live = [m, *(m & y << 1 for y in live)][:RUN] if p == before + 1 else [m]
                before = p
                if len(live) == RUN and live[-1]:
                    return True
        # words in order: longest common subsequence of the item and each stretch that holds enough of its words
        last = np.searchsorted(pos, pos + wide, "left")
        for i in np.flatnonzero(last - np.arange(len(pos)) >= least).tolist():
            v = full = (1 << size) - 1
            for x in a[pos[i : last[i]]].tolist():
                u = v & masks[x]
                v = (v + u | v - u) & full
            if size - v.bit_count() >= least:
                return True
        return False


def need(size: int) -> int:
    """Words of an item of that many words that have to occur in order."""
    return math.ceil(SHARE * size - 1e-9)


def _search(sent):
    """Search a batch for the items of a broadcast; a worker unpacks them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: Items = sent.value
        known: dict[str, int] = {}
        vocabulary, gap = prepared.vocabulary, max(STEPS) + int(STRETCH * (prepared.lengths.max() if len(prepared.lengths) else 0))
        schema = pa.schema([("d", pa.int64()), ("i", pa.int64())])

        def numbers(text: str) -> np.ndarray:
            found = pieces(text)
            try:
                return np.fromiter(map(known.__getitem__, found), np.int32, len(found))
            except KeyError:
                if len(known) > 2_000_000:
                    known.clear()
                for w in set(found):
                    if w not in known:
                        known[w] = vocabulary.get(fold(w), 0)
                return np.fromiter(map(known.__getitem__, found), np.int32, len(found))

        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [numbers(t) if t else np.empty(0, np.int32) for t in b.column(1).to_pylist()]
            between = np.zeros(gap, np.int32)
            flat = np.concatenate([x for t in texts for x in (t, between)]) if texts else between
            doc = np.repeat(np.arange(len(texts)), [len(t) + gap for t in texts])
            out = [(ids[d], prepared.ids[k]) for d, k in prepared.candidates(flat, doc).tolist() if prepared.occurs(texts[d], k)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], schema=schema)

    return run


def find_leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """Every document that reproduces an item: RUN or more consecutive words of it, or at least SHARE of its words in
    order within a stretch of at most STRETCH times its length. Columns out: ident, item; distinct.

    Words are maximal runs of letters and digits without letter case, diacritics and invisible characters. Null and
    empty texts and items without words match nothing; an item of fewer than RUN words needs SHARE of them. ``items``
    is the evaluation set, of a size that does not grow with the corpus; each PASS_WORDS words of it are one broadcast
    and one pass over the corpus. Documents are not shuffled.

    Windows of the corpus that start at any word, and of the items likewise, are embedded by random walks (Chakraborty,
    Goldenberg and Koucky, Streaming algorithms for embedding and computing edit distance, 2016), and windows that
    agree in BITS sampled steps of a walk are candidates; WALKS x SAMPLES such samples are taken. Only windows in
    stretches that hold enough words of items are embedded, which loses nothing. The agreeing document is then
    compared with the item exactly, over its whole text.
    """
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(ident).cast("bigint").alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    out, part, size = None, [], 0

    def one_pass() -> DataFrame:
        one = src.mapInArrow(_search(sc.broadcast(Items(part))), "d bigint, i bigint")
        return one if out is None else out.unionByName(one)

    # the items come to the driver a partition at a time
    for r in items.select(F.col(item).cast("bigint"), item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(words(r[1]))
        if size >= PASS_WORDS:
            out, part, size = one_pass(), [], 0
    if part:
        out = one_pass()
    if out is None:
        out = src.select("d", F.lit(0).cast("bigint").alias("i")).filter("false")
    return out.distinct().select(F.col("d").alias(ident), F.col("i").alias(item))
