"""Content-addressed identities, hash partitions and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of the fields in the order of their names; nulls are written, as they are part of an identity."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    """Prefix and SHA-256 of the canonical payload. Scores, paths and clocks do not belong into it."""
    return F.concat(F.lit(prefix), F.sha2(canonical_json(fields), 256))


def token_id(prefix: str, book: Column, chapter: Column, verse: Column, position: Column, sub: Column | None = None, record: Column | None = None) -> Column:
    """``PFX_BOOK_ccc_vvv_pppp[.ss][~digest]``; null where the book or a number isn't valid."""
    base = F.format_string("%s_%s_%03d_%03d_%04d", F.lit(prefix), F.upper(book), chapter, verse, position)
    if sub is not None:
        base = F.concat(base, F.when(sub.isNotNull(), F.format_string(".%02d", sub)).otherwise(""))
    if record is not None:
        base = F.concat(base, F.lit("~"), F.substring(F.sha2(record, 256), 1, 12))
    return F.when(source_book(book).isNotNull() & (chapter >= 1) & (verse >= 1) & (position >= 1), base)


def source_book(book: Column) -> Column:
    """A source's book identifier in upper case: 1 to 16 ASCII letters or digits, else null."""
    return F.when(book.rlike("^[A-Za-z0-9]{1,16}$"), F.upper(book))


def canonical_pair(a: Column, b: Column) -> Column:
    """struct<lo, hi> of two different identifiers; null for a pair of one with itself."""
    return F.when(a != b, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def pair_id(prefix: str, a: Column, b: Column, ordered: bool = False) -> Column:
    """Identity of a pair; the order of its members counts only if ``ordered``."""
    lo, hi = (a, b) if ordered else (F.least(a, b), F.greatest(a, b))
    return F.when(a != b, F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", lo, hi), 256)))


def unit_hash(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 64 bits of SHA-256 over ``seed|part|…``."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_split(seed: int | str, value: Column, test: float, development: float) -> Column:
    u = unit_hash(seed, value)
    return F.when(u < test, "test").when(u < test + development, "development").otherwise("train")


def sequence_digest(values: Column) -> Column:
    """SHA-256 of an ordered list of values."""
    return F.sha2(F.array_join(values, "␟", "␀"), 256)


def logical_hash(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Row count and an order-independent hash of all columns, each written as text; equal tables give equal rows.

    Every row's 64-bit hash is summed exactly, so partial sums combine on the map side and repeated rows count.
    """
    cols = sorted(c for c in df.columns if c not in (group or []))
    row = F.conv(F.substring(F.md5(F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in cols])), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("row_hash"))
