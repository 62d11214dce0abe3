"""Token ids of a whole corpus under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelink.operators.spread import hot_keys, spread_join
from passagelink.session import materialize

#: Where the vocabulary files lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary (fixed value, published with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that make up one block.
BLOCK = 2_000_000


def _ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def _blocks(ident: str, text: str, block: int):
    """Cut a partition into blocks; each row out is one block with its distinct pre-tokens and its documents as numbers of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        part = TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        docs, lens, flat, chars = [], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal words, docs, lens, flat, chars, part
            row = [[part], [list(words)], [np.array(docs, np.int64).tobytes()], [np.array(lens, np.int32).tobytes()], [np.concatenate(flat).tobytes() if flat else b""]]
            words, docs, lens, flat, chars = {}, [], [], [], 0
            part += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()))], ["block", "words", "docs", "lens", "at"])

        for b in batches:
            for d, t in zip(b.column(ident).to_pylist(), b.column(text).to_pylist()):
                found = find(t) if t else ()
                docs.append(d)
                lens.append(len(found))
                flat.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                chars += len(t or "")
                if chars >= block:
                    yield emit()
        if docs:
            yield emit()

    return run


def encode_corpus(docs: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``ids`` of every document by the vocabulary, special tokens' names being ordinary text. Columns out: ident, ids.

    One row for each row of ``docs`` (identifiers are 64-bit integers, not null); a null and an empty text give an
    empty list; extra columns are dropped.

    The text is split into pre-tokens, which are exploded with their positions; within a block of documents equal
    pre-tokens are combined before any shuffle. The distinct pre-tokens of all blocks are each encoded once, joined
    back to the blocks, and the ids of every document put together by position: within a block that is done on packed
    numbers in Arrow batches. A pre-token of all blocks is one row a block; such hot ones are salted. A text is never cut.
    The vocabulary file is read by the driver and broadcast.
    """
    blocks = materialize(docs.select(F.col(ident).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(_blocks("doc", "text", block), "block bigint, words array<string>, docs binary, lens binary, at binary"))
    spread = blocks.select("block", F.posexplode("words").alias("pos", "word"))

    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a word is one pre-token already, so the pattern takes all of it
        bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            ids = [bpe.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    counts = materialize(spread.groupBy("word").agg(F.count("*").alias("n")))
    known = counts.select("word").mapInArrow(encode, "word string, ids array<int>")
    ids = spread_join(spread, known, "word", hot_keys(counts, "word", "n"), F.xxhash64("block")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("words"))
    whole = blocks.select("block", "docs", "lens", "at").join(ids.select("block", F.col("words.ids").alias("ids")), "block", "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                doc, lens, at = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in (("docs", np.int64), ("lens", np.int32), ("at", np.int32)))
                piece = b.column("ids")[r]
                if piece.is_valid and len(piece):
                    flat = piece.values.flatten().to_numpy(zero_copy_only=False)
                    size = np.fromiter((len(x) for x in piece.values), np.int64, len(piece))
                else:
                    flat, size = np.empty(0, np.int32), np.empty(0, np.int64)
                start = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else np.empty(0, np.int64)
                n = size[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                # position of each id of the block: start of its pre-token, and on
                src = np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])
                bound = ends[np.concatenate([[0], np.cumsum(lens)])]
                lo = 0
                while lo < len(doc):  # batches of bounded size
                    hi = min(len(doc), lo + 512)
                    part = flat[src[bound[lo] : bound[hi]]].astype(np.int32)
                    off = (bound[lo : hi + 1] - bound[lo]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi]), pa.ListArray.from_arrays(pa.array(off), pa.array(part))], ["doc", "ids"])
                    lo = hi

    return whole.mapInArrow(put, "doc bigint, ids array<int>").select(F.col("doc").alias(ident), "ids")


def token_bytes(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """The vocabulary as a table: token id and its bytes. Of fixed size, whatever the corpus."""
    rows = [(i, bytearray(b)) for b, i in _ranks(vocabulary).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, ident: str, ids: str, table: DataFrame) -> DataFrame:
    """The text of every list of token ids, by a join of its ids to the token-byte table. Columns out: ident, text.

    Ids are exploded with their positions, the bytes joined and put together by position. An empty or null list gives
    an empty text; an id that the table lacks adds nothing; bytes that are no valid UTF-8 become U+FFFD.
    """
    at = encoded.select(F.col(ident).alias("doc"), F.posexplode(ids).alias("pos", "id"))
    back = at.join(F.broadcast(table), "id").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = back.select("doc", F.make_valid_utf8(F.unhex(F.array_join("p.h", "")).cast("string")).alias("text"))
    return encoded.select(F.col(ident).alias("doc")).join(text, "doc", "left").select(F.col("doc").alias(ident), F.coalesce("text", F.lit("")).alias("text"))
