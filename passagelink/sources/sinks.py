"""Sinks: partitioned Parquet with atomic promotion, canonical JSON lines, CSV bundles, catalogs, manifests and packages."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelink.functions.identity import logical_hash
from passagelink.sources.files import canonical_json


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_artifact(df: DataFrame, target: str, partition_by: list[str] | None = None, order: list[str] | None = None, force: bool = False, partitions: int | None = None) -> dict:
    """Write one table as zstd Parquet to a staging folder beside the target, then promote it by rename.

    Rows are range-partitioned and sorted by ``order``, or clustered by the partition columns so that a partition has few
    files. An existing target fails without ``force``. Returns row count and logical hash as read back from the files.
    """
    spark = df.sparkSession
    fs, path = _fs(spark, target)
    if fs.exists(path) and not force:
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    if order:
        df = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif partition_by:
        df = df.repartition(*partition_by)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staging)
    got = logical_hash(spark.read.schema(df.schema).parquet(staging)).collect()[0]
    _promote(spark, staging, target)
    return {"rows": got.n_rows, "logical_hash": got.row_hash, "schema": df.schema.simpleString()}


def _promote(spark: SparkSession, staging: str, target: str) -> None:
    fs, path = _fs(spark, target)
    _, src = _fs(spark, staging)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    moved = fs.exists(path) and fs.rename(path, old)
    if not fs.rename(src, path):
        if moved:
            fs.rename(old, path)
        raise OSError(f"could not promote {staging}")
    if moved:
        fs.delete(old, True)


def recover(spark: SparkSession, target: str) -> list[str]:
    """Clear what interrupted writes left beside a target: staged folders go, and a set-aside one comes back where the target is gone."""
    fs, path = _fs(spark, target)
    done = []
    for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.*-*")) or []:
        p = s.getPath()
        if ".old-" in p.getName() and not fs.exists(path):
            fs.rename(p, path)
            done.append(f"restored {p.getName()}")
        else:
            fs.delete(p, True)
            done.append(f"removed {p.getName()}")
    return done


def stage_tables(tables: dict[str, DataFrame], root: str, force: bool = False) -> dict[str, dict]:
    """Several tables under one gate: all are staged, then all are promoted by renaming their common folder."""
    spark = next(iter(tables.values())).sparkSession
    fs, path = _fs(spark, root)
    if fs.exists(path) and not force:
        raise FileExistsError(root)
    staging = f"{root.rstrip('/')}.staging-{uuid.uuid4().hex}"
    info = {n: write_artifact(df, f"{staging}/{n}") for n, df in tables.items()}
    _promote(spark, staging, root)
    return info


def write_jsonl(df: DataFrame, target: str, order: list[str]) -> None:
    """Canonical JSON lines in order; an existing target fails. Files are consecutive ranges of the order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(canonical_json(df).alias("value")).write.mode("error").option("compression", "none").text(target)


def merge_sorted(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Sorted runs as one table in order, by the engine's external sort."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def write_review_bundle(candidates: DataFrame, dossiers: DataFrame, target: str) -> None:
    """Candidates as CSV and Parquet, and one Markdown text per candidate, grouped in files: dossiers(candidate, markdown)."""
    candidates.write.mode("error").option("compression", "zstd").parquet(f"{target}/candidates.parquet")
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in candidates.schema]
    candidates.select(*flat).write.mode("error").csv(f"{target}/candidates.csv", header=True)
    dossiers.select(F.concat(F.lit("# "), F.col("candidate").cast("string"), F.lit("\n\n"), "markdown").alias("value")).write.mode("error").text(f"{target}/dossiers")


def dossier(title: str, fields: list[str]):
    """Markdown of a candidate from its columns: a heading and one line for each field that isn't null."""
    lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"- {f}: "), F.col(f).cast("string"))) for f in fields]
    return F.concat_ws("\n", F.lit(f"## {title}"), *lines)


def register_catalog(tables: dict[str, DataFrame], unique: dict[str, list[str]] | None = None) -> list[str]:
    """Tables as temporary views, after a check that their keys don't repeat; calling it again binds the names anew."""
    for name, keys in (unique or {}).items():
        if not tables[name].groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name}: repeated {keys}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def write_postings(post: DataFrame, target: str, representation: str) -> dict:
    """A sparse index as postings by representation: (pid, feature, tf …) clustered by feature, so that probes prune."""
    return write_artifact(post.withColumn("representation", F.lit(representation)), target, order=["representation", "feature", "pid"])


def load_postings(spark: SparkSession, target: str, representation: str) -> DataFrame:
    """Postings of one representation, after a check of what they hold."""
    p = spark.read.parquet(target).filter(F.col("representation") == representation).drop("representation")
    bad = p.filter("tf is null or tf < 1 or feature is null or pid is null")
    if not bad.isEmpty():
        raise ValueError(f"{target}: broken postings")
    return p


def manifest(name: str, inputs: dict[str, dict], settings: dict) -> str:
    """Provenance of a run as canonical JSON, without paths and clocks."""
    return json.dumps({"inputs": inputs, "name": name, "settings": settings}, sort_keys=True, separators=(",", ":"), default=str)


class StageStore:
    """Results of named stages, kept by the hash of their settings and of what they depend on.

    A stage whose folder is complete is read, any other is computed and written; so an interrupted chain goes on where it
    stopped.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), {}

    def run(self, name: str, build, settings: dict | None = None, needs: tuple[str, ...] = ()) -> DataFrame:
        import hashlib

        key = hashlib.sha256(manifest(name, {n: self.keys[n] for n in needs}, settings or {}).encode()).hexdigest()[:24]
        self.keys[name] = key
        where = f"{self.root}/{name}-{key}"
        fs, done = _fs(self.spark, f"{where}/_SUCCESS")
        if not fs.exists(done):
            write_artifact(build(), where, force=True)
        return self.spark.read.parquet(where)


def package(root: str, archive: str) -> int:
    """A tar archive that depends on names and contents only; the number of its files."""
    files = sorted(p for p in Path(root).rglob("*") if p.is_file())
    with tarfile.open(archive, "w") as tar:
        for p in files:
            info = tarfile.TarInfo(p.relative_to(root).as_posix())
            data = p.read_bytes()
            info.size, info.mtime, info.mode = len(data), 0, 0o644
            tar.addfile(info, io.BytesIO(data))
    return len(files)


def publish(spark: SparkSession, root: str, target: str) -> bool:
    """Copy a local tree to any Hadoop file system and compare the inventories."""
    fs, dst = _fs(spark, target)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(root), dst)
    from passagelink.sources.files import inventory

    names = lambda df, base: {(r.path.rpartition("/")[2], r.sha256) for r in df.collect()}
    return names(inventory(spark, root), root) == names(inventory(spark, target), target)
