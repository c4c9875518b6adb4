"""Token counts behind a cache of digests.

A text's key is the SHA-256 of its content and a tokenizer's that of its file. Stored
counts are joined by key; only distinct misses are encoded, and then appended to the
cache, a Parquet table in a folder that all executors share. Appends of two runs at once
may store a count twice, which is harmless.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlake.llm.common import checkpoint, join_counted, shared_dir, text_batches

_PIECE = 1 << 17
_BETWEEN = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_SCHEMA = "digest binary, version string, n_tokens long"


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def cut(text: str, least: int = _PIECE) -> Iterator[str]:
    """A text in parts that byte-level pre-tokenization would part as well: before a blank between two letters."""
    a = 0
    while len(text) - a > least:
        m = _BETWEEN.search(text, a + least)
        if not m:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


def count(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library's encode has them without added special tokens."""
    t, out = _library(path), [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for part in cut(text or ""):
            batch.append(part)
            owner.append(i)
            held += len(part)
            if held >= _PIECE:
                for k, e in zip(owner, t.encode_batch_fast(batch, add_special_tokens=False)):
                    out[k] += len(e)
                batch, owner, held = [], [], 0
    for k, e in zip(owner, t.encode_batch_fast(batch, add_special_tokens=False)):
        out[k] += len(e)
    return out


def counter(path: str):
    """A vectorised function from texts to token counts; the file must be on every executor."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return pd.Series(count(texts.tolist(), path), dtype="int64")

    return tokens


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def new_cache(spark: SparkSession) -> str:
    """A folder of its own for a cache, in the shared folder."""
    return f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_SCHEMA).parquet(cache) if there else spark.createDataFrame([], _SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_bytes (UTF-8), n_tokens; counts that the cache lacked are in it afterwards.

    Null texts count as empty: 0 bytes and tokens. Null ids and equal rows stay; other columns are not read;
    an empty table gives none. Copies of a text are one before texts are shuffled, and the rows of digests that come very
    often get their counts by broadcast, so that no task has them all.
    """
    spark, v = docs.sparkSession, version(path)
    text_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = checkpoint(docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col(text_col)).alias("digest")))

    def stored() -> DataFrame:
        return read_cache(spark, cache).where(F.col("version") == v).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    distinct = docs.select(content_digest(F.col(text_col)).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    # an anti join would be pushed below the aggregation, where every copy of a text is a row
    misses = distinct.join(stored().withColumnRenamed("n_tokens", "known"), "digest", "left").where("known IS NULL")
    misses.select("digest", F.lit(v).alias("version"), counter(path)("text").alias("n_tokens")).write.mode("append").parquet(cache)
    counted = checkpoint(keyed.groupBy("digest").agg(F.count("*").alias("n")).join(stored(), "digest"))
    return join_counted(keyed, counted, "digest", "n").select(id_col, "n_bytes", "n_tokens")
