"""Incremental ingest of documents (an extension: the batch analyses need none of it).

New documents arrive as files; each micro-batch appends the postings of documents not yet indexed. Watermarked counts
show late arrivals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagelink.functions.text import text_words
from passagelink.operators.features import occurrences, postings


def document_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def index_documents(stream: DataFrame, ident: str, text: str, index: str, checkpoint: str) -> StreamingQuery:
    """Append postings of every new document to ``index``; a document that is already there is left alone.

    The batch id is a partition of the index and written by overwrite, so a batch that is tried again replaces what it
    wrote before.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = batch.select(F.col(ident).alias("pid"), F.col(text).alias("text")).filter("text is not null").dropDuplicates(["pid"])
        try:
            known = spark.read.parquet(index).filter(F.col("batch") != batch_id).select("pid").distinct()
            docs = docs.join(known, "pid", "left_anti")
        except Exception as x:  # no index yet
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER" not in str(x):
                raise
        words = docs.select("pid", F.posexplode(text_words(F.col("text"))).alias("pos", "word"))
        postings(occurrences(words, "pid", "pos", "word")).write.mode("overwrite").option("compression", "zstd").parquet(f"{index}/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, created: str, received: str, lateness: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Documents per window of creation and how many came late, with a watermark that bounds the state."""
    s = stream.withColumn("created_ts", F.col(created).cast("timestamp")).withColumn("late", F.col(received).cast("timestamp") > F.col("created_ts") + F.expr("INTERVAL 1 HOUR"))
    return s.withWatermark("created_ts", lateness).groupBy(F.window("created_ts", width)).agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))
