"""From raw documents to token ids: quality rules, language, near-duplicates, benchmark passages, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.llm import bpe, decontam, langid, quality_rules, simhash
from paperlake.llm.common import shared_dir

#: A document whose pooled probability is lower is of no known language.
MIN_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many different texts of their host share.

    Null and empty texts are too short and go; null hosts are one host; repeated rows stay and count once; texts are not shuffled.
    """
    return quality_rules.clean(docs, copies_once=True)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with lang set to it; all of them where no language could be learned.

    Null texts and those without a letter are of no language and go; null ids are predicted but not learned from; repeated rows stay.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    known = langid.predict(packed, model, keep=["doc", "doc_id"])
    known = known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Null and empty texts have one fingerprint and are a group; of repeated rows one stays, and of groups whose ids are all null one row.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null and empty texts have none and stay; repeated rows stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each document; null texts have no ids."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding", encoding_stage),
]

#: The language model and the encoder have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; what a stage wrote goes when the next one has read it."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
