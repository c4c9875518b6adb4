"""Incremental ingestion: each document is claimed once, and an index grows by postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.operators import search
from paperlake.sources import files

_DOCS = "doc_id long, text string"


def watch_documents(spark: SparkSession, folder: str, schema: str = _DOCS, files_per_batch: int = 10) -> DataFrame:
    """New Parquet files below a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def index_stream(docs: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append postings and document lengths of what is new, then stop. A document id is taken once, however often its row comes: a batch leaves out the ids
    that other batches have stored, so the stream keeps no state of its own; a batch that runs twice overwrites its own files, so the index holds each batch once."""
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["doc_id"])
        if files.exists(spark, f"{index}/documents"):
            stored = spark.read.schema("doc_id long, dl long, batch long").option("basePath", f"{index}/documents").parquet(f"{index}/documents")
            fresh = fresh.join(stored.where(F.col("batch") != number).select("doc_id"), "doc_id", "left_anti")
        fresh = fresh.persist()
        search.postings(fresh).write.mode("overwrite").parquet(f"{index}/postings/batch={number}")
        fresh.select("doc_id", F.size(search.T.tokens(F.col("text"))).cast("long").alias("dl")).write.mode("overwrite").parquet(f"{index}/documents/batch={number}")
        fresh.unpersist()

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame]:
    """Postings and document lengths of all batches."""
    return spark.read.parquet(f"{index}/postings").drop("batch"), spark.read.parquet(f"{index}/documents").drop("batch")
