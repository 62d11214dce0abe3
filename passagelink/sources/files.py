"""Scans of cross-reference text, strict CSV, typed and canonical JSON lines, Parquet artifacts, and inventories."""

from __future__ import annotations

import hashlib
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REF = r"^[1-3]?[A-Za-z]+\.\d+\.\d+(-([1-3]?[A-Za-z]+\.)?(\d+\.)?\d+)?$"


def cross_references(spark: SparkSession, path: str) -> DataFrame:
    """Every physical line after the header, malformed and blank ones too, each with a parse status.

    Columns out: line_number, raw, ref_a, ref_b, votes, parse_status (parsed, invalid_blank_record, invalid_column_count,
    invalid_encoding, invalid_empty_reference, invalid_reference_syntax, invalid_weight), record_hash, duplicate_ordinal.
    Lines keep their bytes; a broken encoding is seen as such. Files are read line by line, so a line number is the order
    within the file's splits; it is counted per file in a narrow pass.
    """
    lines = spark.read.format("text").option("wholetext", "false").load(path)
    raw = F.regexp_replace("value", "\r$", "")
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), raw.alias("raw"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("block", "i")) - 1
    f = F.split("raw", "\t")
    a, b, v = (F.get(f, F.lit(i)) for i in range(3))
    votes = F.when(v.rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(v, r"^\+", "").cast("bigint"))
    status = (
        F.when(F.col("raw") == "", "invalid_blank_record").when(F.size(f) != 3, "invalid_column_count").when(F.col("raw").contains("�"), "invalid_encoding")
        .when(votes.isNull(), "invalid_weight").when((a == "") | (b == ""), "invalid_empty_reference").when(~a.rlike(_REF) | ~b.rlike(_REF), "invalid_reference_syntax").otherwise("parsed")
    )
    three = F.size(f) == 3
    out = numbered.withColumn("line_number", number).filter("line_number > 0").select("line_number", "raw", F.when(three, a).alias("ref_a"), F.when(three, b).alias("ref_b"), F.when(three, votes).alias("votes"), status.alias("parse_status"), F.sha2("raw", 256).alias("record_hash"))
    return out.withColumn("duplicate_ordinal", F.row_number().over(Window.partitionBy("record_hash").orderBy("line_number")))


def strict_csv(spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """CSV with exactly this header and these types; malformed lines fail. ``rows`` is the exact number wanted, if any."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path}: {n} rows, wanted {rows}")
    return df


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def typed_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of one type; a line that isn't fails."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def canonical_json(df: DataFrame) -> Column:
    """The one way to write a row: compact JSON, fields by name, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def canonical_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines whose bytes aren't the canonical form of what they say."""
    x = spark.read.text(path).withColumn("r", F.from_json("value", schema))
    rows = x.select("value", "r.*")
    return rows.drop("value"), rows.filter(~F.col("value").eqNullSafe(canonical_json(rows.drop("value")))).select("value")


def artifact(spark: SparkSession, root: str, schema: T.StructType | None = None, order: list[str] | None = None) -> DataFrame:
    """All partitions of one logical table, with its declared schema and in its order if asked for."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(root)
    return df.orderBy(*order) if order else df


def passage_sequences(passages: DataFrame, members: DataFrame, tokens: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Ordered features of the passages of one scope (corpus, profile, reading, granularity): passage_id, elements
    array<struct<position, token_id, …>>. Fails where a token doesn't resolve or positions aren't 1 to n.

    tokens has token_id and any annotation columns. The scope filters passages before anything is joined.
    """
    p = passages
    for c, v in scope.items():
        p = p.filter(F.col(c) == v)
    cols = [c for c in tokens.columns if c != "token_id"]
    t = tokens.withColumn("known", F.lit(True))
    j = p.select("passage_id").distinct().join(members.select("passage_id", "token_id", "position_in_passage"), "passage_id").join(t, "token_id", "left")
    element = F.struct(F.col("position_in_passage").alias("position"), "token_id", *cols)
    out = j.groupBy("passage_id").agg(F.array_sort(F.collect_list(element)).alias("elements"), F.count_if(F.col("known").isNull()).alias("lost"))
    whole = (F.col("lost") == 0) & (F.transform("elements", lambda e: e["position"].cast("int")) == F.sequence(F.lit(1), F.size("elements")))
    checked = F.when(whole, F.col("elements")).otherwise(F.raise_error(F.concat(F.lit("unresolved tokens or positions in "), "passage_id")).cast(out.schema["elements"].dataType))
    return out.select("passage_id", checked.alias("elements"))


def pair_projection(pairs: DataFrame, evidence: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with their evidence collected to one row, and the audit of keys that one side lacks."""
    a, b = pairs.select(key).distinct().withColumn("p", F.lit(1)), evidence.select(key).distinct().withColumn("e", F.lit(1))
    audit = a.join(b, key, "full_outer").filter("p is null or e is null")
    rows = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in evidence.columns if c != key]))).alias("evidence"))
    return pairs.join(rows, key), audit


def hydrate(details: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Detail rows of the selected keys only, collected per key."""
    cols = [c for c in details.columns if c != key]
    return details.join(selection.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("details"))


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder with its size and SHA-256, hashed where it is read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def zip_inventory(path: str, expected: dict[str, str]) -> list[tuple[str, str]]:
    """What is wrong with an archive against expected member hashes: (member, problem); empty if it is as expected.

    Absolute and parent paths, repeated and unexpected members, missing ones and wrong contents are problems.
    """
    wrong, seen = [], set()
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            name = m.filename
            if m.is_dir():
                continue
            if name.startswith("/") or ".." in Path(name).parts:
                wrong.append((name, "unsafe path"))
            elif name in seen:
                wrong.append((name, "repeated"))
            elif name not in expected:
                wrong.append((name, "unexpected"))
            elif hashlib.sha256(z.read(m)).hexdigest() != expected[name]:
                wrong.append((name, "contents differ"))
            seen.add(name)
    return wrong + [(n, "missing") for n in sorted(set(expected) - seen)]


def unpack(path: str, expected: dict[str, str], target: str) -> list[str]:
    """Members of a sound archive written below a folder."""
    if wrong := zip_inventory(path, expected):
        raise ValueError(f"{path}: {wrong[0][0]}: {wrong[0][1]}")
    with zipfile.ZipFile(path) as z:
        z.extractall(target, members=sorted(expected))
    return sorted(expected)
