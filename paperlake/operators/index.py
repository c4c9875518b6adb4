"""Stored indexes: collections of vectors and of postings, with append, slices, search, export and deletion.

An index is a folder. `vectors` and `chunks` hold one row for each record, in folders by collection; a chunk's
row has its postings too, as columns of their own. `secrets` has a digest for each protected collection.
Appending adds files and never rewrites what is there; statistics are counted when a search runs.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paperlake.operators import search
from paperlake.sources import files
from paperlake.sources.shared import checkpoint

_RECORD = ["collection", "pos", "id", "content", "metadata"]


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Rows numbered from 0 inside each value of `keys`, in the order of `order`, without bringing a key's rows into one task."""
    ranged = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each task
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*keys, *order)) - 1 + F.col("__before")
    all_ = ranged.join(F.broadcast(before), "__p").withColumn(name, at)
    first = checkpoint(all_).groupBy(*keys).agg(F.min(name).alias("__first"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys], F.lit(True))
    named = first.select(*[F.col(k).alias("__k_" + k) for k in keys], "__first")
    return all_.join(F.broadcast(named), on).withColumn(name, (F.col(name) - F.col("__first")).cast("long")).drop("__p", "__before", "__first", *["__k_" + k for k in keys])


def _table(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    if not files.exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")


_VECTORS = "pos long, id string, content string, metadata map<string,string>, vector array<double>, collection string"
_CHUNKS = "id long, dl long, terms array<struct<term: string, tf: int>>, content string, metadata map<string,string>, collection string"


def save_vectors(spark: SparkSession, root: str, records: DataFrame, normalize: bool = True, secrets: dict[str, str] | None = None) -> None:
    """Append records (collection, ord, id, content, metadata, vector); a collection's positions go on where it ends. Null vectors are left out."""
    have = _table(spark, root, "vectors", _VECTORS).groupBy(F.col("collection").alias("c")).agg(F.count("*").alias("n"))
    fresh = numbered(records.where("vector IS NOT NULL"), ["collection"], ["ord"])
    v = F.transform("vector", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    kept = F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v) if normalize else v
    rows = fresh.join(F.broadcast(have), F.col("collection") == F.col("c"), "left").select(
        (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), F.col("id").cast("string").alias("id"), "content", "metadata", kept.alias("vector"), "collection")
    checkpoint(rows).write.mode("append").partitionBy("collection").parquet(f"{root}/vectors")
    _keep_secrets(spark, root, secrets)


def _keep_secrets(spark: SparkSession, root: str, secrets: dict[str, str] | None) -> None:
    known = _secrets(spark, root)
    fresh = [(c, hashlib.sha256(s.encode()).hexdigest()) for c, s in (secrets or {}).items() if c not in known]
    if fresh:
        spark.createDataFrame(fresh, "collection string, digest string").coalesce(1).write.mode("append").parquet(f"{root}/secrets")


def _secrets(spark: SparkSession, root: str) -> dict[str, str]:
    return {r["collection"]: r["digest"] for r in _table(spark, root, "secrets", "collection string, digest string").collect()}  # a row for each protected collection


def _check(spark: SparkSession, root: str, collection: str, secret: str | None) -> None:
    need = _secrets(spark, root).get(collection)
    if need and hashlib.sha256((secret or "").encode()).hexdigest() != need:
        raise ValueError(f"the secret of {collection} does not match")


def get_records(spark: SparkSession, root: str, start: int = 0, end: int = -1, include_vector: bool = False, collection: str | None = None) -> DataFrame:
    """(collection, pos, id, content, metadata, vector_size[, vector]): records of a range of positions, to the end for -1."""
    rows = _table(spark, root, "vectors", _VECTORS).where(F.col("pos") >= start)
    rows = rows.where(F.col("pos") < end) if end != -1 else rows
    rows = rows.where(F.col("collection") == collection) if collection is not None else rows
    return rows.select(*_RECORD, F.size("vector").alias("vector_size"), *(["vector"] if include_vector else []))


def export(spark: SparkSession, root: str, path: str, start: int = 0, end: int = -1, include_vector: bool = True) -> None:
    """The records of get_records as JSON."""
    get_records(spark, root, start, end, include_vector).write.mode("errorifexists").json(path)


def delete_collection(spark: SparkSession, root: str, collection: str, secret: str | None = None) -> None:
    """Drop a collection from all tables; a protected one only with its secret, else an error."""
    _check(spark, root, collection, secret)
    for kind in ("vectors", "chunks"):
        files.delete(spark, f"{root}/{kind}/collection={collection}")


def custom_metadata_keys(spark: SparkSession, root: str) -> DataFrame:
    """(collection, key): the metadata keys that some record has."""
    both = _table(spark, root, "vectors", _VECTORS).select("collection", "metadata").unionByName(_table(spark, root, "chunks", _CHUNKS).select("collection", "metadata"))
    return both.select("collection", F.explode(F.map_keys("metadata")).alias("key")).distinct()


def search_vectors(spark: SparkSession, root: str, questions: DataFrame, k: int, fetch_k: int = 100, metadata: dict[str, str] | None = None,
                   least: float | None = None, most: float | None = None, secrets: dict[str, str] | None = None) -> DataFrame:
    """Every question (qid, collection, qvec) against its collection: fetch_k nearest, then those whose metadata is as wanted, the k best, the window, and a message row for none."""
    collections = [r["collection"] for r in questions.select("collection").distinct().collect()]  # those that are asked
    parts = []
    for c in collections:
        _check(spark, root, c, (secrets or {}).get(c))
        rows = _table(spark, root, "vectors", _VECTORS).where(F.col("collection") == c)
        asked = questions.where(F.col("collection") == c)
        near = search.vector_top(rows, asked, fetch_k, "pos", "vector", normalize=True)
        j = near.join(rows.select(F.col("pos").alias("id"), F.col("id").alias("record"), "metadata"), "id")
        for key, value in (metadata or {}).items():
            j = j.where(F.coalesce(F.element_at("metadata", F.lit(key)) == value, F.lit(False)))
        best = search.top(j.select("qid", "id", "score", "record"), k, ascending=True)
        found = search.window_or_message(best, asked, least, most).join(best.select("qid", "id", "record"), ["qid", "id"], "left")
        parts.append(found.select(F.lit(c).alias("collection"), "qid", F.col("record").alias("id"), "score", "rank", "message"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "collection string, qid long, id string, score double, rank long, message string")


def save_chunks(spark: SparkSession, root: str, chunks: DataFrame, secrets: dict[str, str] | None = None) -> None:
    """Append chunks (collection, id, content, metadata) with their postings, in one pass over the new chunks alone: texts are put in the order of their folders, then tokenised and written where they are."""
    rows = chunks.select("collection", "id", "content", "metadata").sortWithinPartitions("collection")
    search.term_counts(rows, "content").select("id", "dl", "terms", "content", "metadata", "collection").write.mode("append").partitionBy("collection").parquet(f"{root}/chunks")
    _keep_secrets(spark, root, secrets)


def search_chunks(spark: SparkSession, root: str, questions: DataFrame, k: int, secrets: dict[str, str] | None = None) -> DataFrame:
    """(collection, qid, id, score, rank) of every question (qid, collection, question) by BM25 over its collection's stored postings; texts are not read."""
    parts = []
    for c in [r["collection"] for r in questions.select("collection").distinct().collect()]:
        _check(spark, root, c, (secrets or {}).get(c))
        chunks = _table(spark, root, "chunks", _CHUNKS).where(F.col("collection") == c)
        stats = chunks.agg(F.count("*").alias("n"), F.sum("dl").alias("len")).first()
        postings = chunks.select("id", "dl", F.explode_outer("terms").alias("p")).select("id", "dl", "p.*")
        for block in search.blocks(questions.where(F.col("collection") == c)):
            times = search.question_terms(block)
            terms = sorted(set(times["term"]))
            number = {t: i for i, t in enumerate(terms)}
            wanted = spark.createDataFrame(pd.DataFrame({"term": terms, "number": range(len(terms))}, columns=["term", "number"]), "term string, number int")
            met = postings.join(F.broadcast(wanted), "term").groupBy("id", "dl").agg(F.flatten(F.collect_list(F.array_repeat("number", F.col("tf")))).alias("terms"))
            rows = checkpoint(met)
            df = rows.select(F.explode(F.array_distinct("terms")).alias("number")).groupBy("number").agg(F.count("*").alias("df")).toPandas()  # a row for each term of the block
            scores = search.score_terms(rows, times.assign(term=times["term"].map(number)), df, stats["n"], (stats["len"] or 0) / max(stats["n"], 1), search.K1, search.B, k)
            parts.append(search.top(scores, k).select(F.lit(c).alias("collection"), "qid", "id", "score", "rank"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "collection string, qid long, id long, score double, rank long")


def index_documents(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame | None = None, method: str | None = None, chunking: str = "chunking_method") -> dict:
    """Both indexes of chunks (collection, id, content, metadata): postings, and vectors (id, vector) where they are given; of one chunking method alone if it is named. What was written is told by kind."""
    rows = chunks.where(F.element_at("metadata", F.lit(chunking)) == method) if method else chunks
    save_chunks(spark, f"{root}/sparse", rows)
    written = {"sparse": f"{root}/sparse"}
    if vectors is not None:
        joined = rows.join(vectors.select(F.col("id").alias("__i"), "vector"), F.col("id") == F.col("__i")).select("collection", F.col("id").alias("ord"), "id", "content", "metadata", "vector")
        save_vectors(spark, f"{root}/vectors", joined)
        written["vectors"] = f"{root}/vectors"
    return written


def index_id(name: str, group: str) -> str:
    """An index's id: its name and the last part of its group's identifier."""
    return f"{name}-{group.split('-')[-1]}"
