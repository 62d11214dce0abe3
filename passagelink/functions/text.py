"""Normalization and parsing of annotated text as column functions.

Unicode normalization and case folding have no built-in function in Spark, so those run as Arrow-batched UDFs;
everything else is made of built-in functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points of the Hebrew and Greek scripts.
CANTILLATION = "".join(map(chr, range(0x0591, 0x05B0))) + "ֽ"
VOWELS = "".join(map(chr, range(0x05B0, 0x05BD))) + "ׇֿׁׂׅׄ"
JOINER = "͏"
LEADING = "([—–«“"
TRAILING = ",.;;··)]—–»”!?"
ELISION = "’ʼ᾽"
GREEK_MARKS = "̀́͂̓̔̈"
MAQAF = "־"
MORPHOLOGY_KEYS = ("case", "cat", "gender", "mood", "number", "person", "pos", "stem", "tense", "type", "voice")
MORPHOLOGY_FALLBACK = ("FormalTag", "FunctionalTag", "morph")


def _per_value(f, s: pd.Series) -> pd.Series:
    """Apply f once to each distinct value of a batch; nulls stay null."""
    known = {v: f(v) for v in s.dropna().unique()}
    return s.map(known).astype(object).where(s.notna(), None)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _per_value(lambda v: unicodedata.normalize("NFC", v), s)


@F.pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    return _per_value(lambda v: unicodedata.normalize("NFKC", v).casefold(), s)


@F.pandas_udf(T.StringType())
def accent_fold(s: pd.Series) -> pd.Series:
    """Accents, breathings and diaeresis away, letter case folded (final sigma becomes medial), composed again."""
    marks = dict.fromkeys(map(ord, GREEK_MARKS))
    return _per_value(lambda v: unicodedata.normalize("NFC", unicodedata.normalize("NFD", v).translate(marks).casefold()), s)


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def hebrew_forms(surface: Column) -> Column:
    """struct<surface, normalized, unpointed> of a Hebrew token; null where a form would be empty.

    ``normalized`` lacks cantillation, ``unpointed`` also vowel points. Null and empty tokens give null.
    """
    base = squeeze(without(nfc(surface), JOINER))
    normalized, unpointed = without(base, CANTILLATION), without(base, CANTILLATION + VOWELS)
    return F.when((normalized != "") & (unpointed != ""), F.struct(surface.alias("surface"), normalized.alias("normalized"), unpointed.alias("unpointed")))


def hebrew_lemma(c: Column) -> Column:
    """A lemma in its own name space; null for null and blank ones."""
    return F.when(F.trim(c) != "", squeeze(without(nfc(c), JOINER)))


def is_punctuation(c: Column) -> Column:
    """Whether a token has no letter and no number: only punctuation, separators and symbols."""
    return c.rlike(r"^[\p{P}\p{Z}\p{S}]+$")


def greek_parts(c: Column) -> Column:
    """struct<leading, core, trailing> whose concatenation is the token; elision marks stay with the core.

    A token of punctuation alone is its own core.
    """
    esc = lambda s: "".join("\\" + x if x in "()[].?" else x for x in s)
    pattern = f"(?s)^([{esc(LEADING)}]*)(.*?)([{esc(TRAILING)}]*)$"
    lead, core, trail = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    alone = core == ""
    return F.struct(F.when(alone, "").otherwise(lead).alias("leading"), F.when(alone, c).otherwise(core).alias("core"), F.when(alone, "").otherwise(trail).alias("trailing"))


def greek_forms(surface: Column) -> Column:
    """struct<surface, normalized, folded, leading, trailing> of a Greek token; null for null and empty tokens."""
    parts = greek_parts(squeeze(surface))
    forms = F.struct(surface.alias("surface"), nfc(parts["core"]).alias("normalized"), accent_fold(parts["core"]).alias("folded"), parts["leading"].alias("leading"), parts["trailing"].alias("trailing"))
    return F.when(squeeze(surface) != "", forms)


def greek_lemma(c: Column) -> Column:
    """A lemma with its homograph marker; null for null and blank ones."""
    return F.when(F.trim(c) != "", nfc(squeeze(c)))


def is_elided(c: Column) -> Column:
    """Whether the core of a token ends in an elision mark after a letter."""
    return greek_parts(c)["core"].rlike(rf"\p{{L}}[{ELISION}]$")


def gloss_words(c: Column) -> Column:
    """Words of an English gloss: compatibility form, folded, punctuation as blanks; an empty list for null."""
    text = F.regexp_replace(nfkc_fold(c), r"(?U)[^\w\s'-]+", " ")
    text = F.regexp_replace(squeeze(text), r"^[ '\-]+|[ '\-]+$", "")
    return F.coalesce(F.filter(F.split(text, " "), lambda w: w != ""), F.array().cast("array<string>"))


def coarse_morphology(c: Column) -> Column:
    """Compact JSON of the allowed morphology keys of a JSON object, keys and values in lower case and sorted by key.

    Where none is present, the first of the source's compact tags; null for null, invalid and other JSON.
    """
    m = F.from_json(c, "map<string,string>")
    low = F.transform_keys(m, lambda k, _: F.lower(k))
    kept = F.map_filter(low, lambda k, v: k.isin(*MORPHOLOGY_KEYS) & (F.coalesce(v, F.lit("")) != ""))
    tags = F.coalesce(*[F.when(m[k] != "", F.create_map(F.lit(k.lower()), m[k])) for k in MORPHOLOGY_FALLBACK])
    chosen = F.when(F.size(kept) > 0, kept).otherwise(tags)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(chosen)))
    return F.when(F.size(chosen) > 0, F.to_json(F.transform_values(ordered, lambda _, v: F.lower(v))))


def namespaced(namespace: Column | str, family: Column | str, value: Column) -> Column:
    """``namespace:family:value``; null where the value is null or empty."""
    one = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(value != "", F.concat_ws(":", one(namespace), one(family), value))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 5, "short").when(n <= 15, "medium").otherwise("long")


def length_ratio_bucket(a: Column, b: Column) -> Column:
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    return F.when(ratio <= 1.25, "close").when(ratio <= 2.0, "moderate").otherwise("wide")


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, the same in every engine."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_words(c: Column) -> Column:
    """Words of running text: runs of letters and their marks."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


# --- references such as ``Gen.1.3-Gen.1.5``

#: Status of a reference that parses.
PARSED = "parsed"


def parse_reference(c: Column, books: Column, chapters: Column) -> Column:
    """struct<status, book, c1, v1, c2, v2, is_range> of a reference ``Book.c.v``, ``…-Book.c.v``, ``…-c.v`` or ``…-v``.

    books: map of alias to canonical book; chapters: map of canonical book to its chapter count. Statuses: parsed,
    empty_reference, invalid_syntax, unknown_book, invalid_chapter, invalid_verse, cross_book_range, backward_range,
    empty_range. Null gives null.
    """
    point = r"^([1-3]?[A-Za-z]+)\.(\d{1,9})\.(\d{1,9})$"
    parts = F.split(c, "-")
    left, right = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    num = lambda s, p, i: F.try_to_number(F.regexp_extract(s, p, i), F.lit("999999999")).cast("int")
    full_right, cv, v = right.rlike(point), right.rlike(r"^\d{1,9}\.\d{1,9}$"), right.rlike(r"^\d{1,9}$")
    b1 = F.try_element_at(books, F.regexp_extract(left, point, 1))
    b2 = F.when(full_right, F.try_element_at(books, F.regexp_extract(right, point, 1))).otherwise(b1)
    c1, v1 = num(left, point, 2), num(left, point, 3)
    c2 = F.when(right.isNull(), c1).when(full_right, num(right, point, 2)).when(cv, num(right, r"^(\d+)\.", 1)).when(v, c1)
    v2 = F.when(right.isNull(), v1).when(full_right, num(right, point, 3)).when(cv, num(right, r"\.(\d+)$", 1)).when(v, num(right, r"^(\d+)$", 1))
    unknown = lambda s: s.rlike(r"^[1-3]?[A-Za-z]+") & ~F.coalesce(F.map_contains_key(books, F.regexp_extract(s, r"^([^.]*)", 1)), F.lit(False))
    bad_chapter = lambda b, n: (n < 1) | (n > F.coalesce(F.try_element_at(chapters, b), F.lit(0)))
    status = (
        F.when(c == "", "empty_reference")
        .when((F.trim(c) != c) | (F.size(parts) > 2), "invalid_syntax")
        .when(b1.isNull() & unknown(left), "unknown_book")
        .when(~left.rlike(point), "invalid_syntax")
        .when(v1 < 1, "invalid_verse")
        .when(bad_chapter(b1, c1), "invalid_chapter")
        .when(right.isNull(), PARSED)
        .when(right == "", "empty_range")
        .when(full_right & b2.isNull(), "unknown_book")
        .when(~(full_right | cv | v), "invalid_syntax")
        .when(v2 < 1, "invalid_verse")
        .when(bad_chapter(b2, c2), "invalid_chapter")
        .when(b1 != b2, "cross_book_range")
        .when((c1 == c2) & (v1 == v2), "empty_range")
        .when((c2 < c1) | ((c2 == c1) & (v2 < v1)), "backward_range")
        .otherwise(PARSED)
    )
    fields = (("book", b1), ("c1", c1), ("v1", v1), ("c2", c2), ("v2", v2), ("is_range", right.isNotNull()))
    return F.when(c.isNotNull(), F.struct(status.alias("status"), *[F.when(status == PARSED, x).alias(n) for n, x in fields], b1.alias("first_book"), b2.alias("last_book")))


def reference_corpus(parsed: Column, hebrew: list[str], greek: list[str]) -> Column:
    """Corpus of both books of a parsed reference; null for mixed and malformed ones. Cross-book ranges count."""
    fine = parsed["status"].isin(PARSED, "cross_book_range")
    both = lambda books: parsed["first_book"].isin(*books) & parsed["last_book"].isin(*books)
    return F.when(fine & both(hebrew), "hebrew").when(fine & both(greek), "greek")


def expand_reference(parsed: Column, bounds: Column) -> Column:
    """Verse labels ``BOOK c:v`` of a parsed reference in order; null where a chapter's bound is missing or exceeded.

    bounds: map of ``BOOK c`` to the number of its verses.
    """
    p = parsed
    top = lambda ch: F.try_element_at(bounds, F.concat_ws(" ", p["book"], ch.cast("string")))
    first = lambda ch: F.when(ch == p["c1"], p["v1"]).otherwise(1)
    last = lambda ch: F.when(ch == p["c2"], p["v2"]).otherwise(top(ch))
    chapters = F.sequence(p["c1"], p["c2"])
    sound = F.forall(chapters, lambda ch: F.coalesce((first(ch) <= top(ch)) & (last(ch) <= top(ch)) & (first(ch) <= last(ch)), F.lit(False)))
    labels = F.flatten(F.transform(chapters, lambda ch: F.transform(F.sequence(first(ch), last(ch)), lambda v: F.concat(p["book"], F.lit(" "), ch.cast("string"), F.lit(":"), v.cast("string")))))
    return F.when((p["status"] == PARSED) & sound, labels)


# --- reconstruction of passages

OPENING, CLOSING = r"^[\(\[«“]+$", r"^[\)\]\}»”,.;:!?·׃]+$"


def reconstruct_hebrew(words: Column) -> Column:
    """Text of ordered words, array<struct<text, after>>: the source's separator, or where null a blank unless the word
    ends in a maqaf or the next begins with closing punctuation."""
    n = F.size(words)
    piece = F.transform(
        words,
        lambda w, i: F.concat(
            w["text"],
            F.when(i + 1 >= n, "").when(w["after"].isNotNull(), w["after"])
            .when(w["text"].endswith(MAQAF) | F.get(words, i + 1)["text"].rlike(r"^[\)\]\}»”,.;:!?׃]") | w["text"].rlike(r"[\(\[«“]$") | (w["text"] == ""), "").otherwise(" "),
        ),
    )
    return F.array_join(piece, "")


def reconstruct_greek(words: Column) -> Column:
    """Text of ordered tokens, array<struct<text, punctuation>>: blanks between, but none before closing punctuation and
    none after opening punctuation. Empty tokens are skipped."""
    kept = F.filter(words, lambda w: w["text"] != "")
    piece = F.transform(
        kept,
        lambda w, i: F.concat(
            F.when((i == 0) | (w["punctuation"] & w["text"].rlike(CLOSING)) | (F.get(kept, i - 1)["punctuation"] & F.get(kept, i - 1)["text"].rlike(OPENING)), "").otherwise(" "),
            w["text"],
        ),
    )
    return F.array_join(piece, "")


def reconstruct(corpus: Column, words: Column) -> Column:
    """Text of ordered tokens array<struct<text, after, punctuation>> by the rule of their corpus."""
    return F.when(corpus == "hebrew", reconstruct_hebrew(words)).when(corpus == "greek", reconstruct_greek(words))
