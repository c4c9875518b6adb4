"""The life cycle of processing requests as tables: files become requests once, wait in groups, are read again, and are closed.

A manifest has one row for each claim of a file and one for each change of its group's state; nothing is rewritten, so the newest
row counts. Its folder is on storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paperlake.functions import text as T
from paperlake.sources import files

_CLAIMS = "claim string, group_id string, document_id string, path string, filename string, extension string, work_path string, mode string"
_STATES = "group_id string, state string, step long"
#: The modes of a request, of which the first enabled one counts, and the folders below each document's work folder.
MODES = {
    "inference": ("input", "output"), "evaluation": ("input", "output"), "report": ("input", "report"), "qna_generator": ("input", "qna"),
    "segmentDetection": ("input", "detection"), "content_evaluation": ("input", "evaluation"), "rag_evaluation": ("input", "evaluation"),
}


def mode(config: dict) -> str:
    """The first enabled mode of a configuration {mode: {enabled}}; none is an error."""
    for m in MODES:
        if config.get(m, {}).get("enabled"):
            return m
    raise ValueError("no mode is enabled")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def plan_requests(listed: DataFrame, group_id: str, work_root: str, chosen: str = "inference") -> DataFrame:
    """Listed files (path, filename, extension, claim) as requests: an id that follows from the path, a work path below the document's own folder, and the mode; a file that is listed twice once."""
    once = listed.withColumn("__n", F.row_number().over(Window.partitionBy("claim").orderBy("path"))).where("__n = 1")
    document = T.stable_id("D", F.col("path"))
    return once.select("claim", F.lit(group_id).alias("group_id"), document.alias("document_id"), "path", "filename", "extension",
                       F.concat(F.lit(work_root + "/"), document, F.lit(f"/{MODES[chosen][0]}/"), "filename").alias("work_path"), F.lit(chosen).alias("mode"))


def create_requests(spark: SparkSession, listed: DataFrame, manifest: str, group_id: str, work_root: str, config: dict, batch: int | None = None) -> DataFrame:
    """The requests of files that no open group has claimed, the first `batch` by path, added to the manifest as a pending group. No such file leaves the manifest as it is."""
    held = _table(spark, f"{manifest}/claims", _CLAIMS).join(states(spark, manifest).where("state <> 'closed'"), "group_id").select("claim").distinct()
    fresh = listed.join(held, "claim", "left_anti")
    fresh = fresh.orderBy("path").limit(batch) if batch is not None else fresh
    plan = plan_requests(fresh, group_id, work_root, mode(config)).cache()
    if plan.limit(1).count():
        plan.write.mode("append").parquet(f"{manifest}/claims")
        _note(spark, manifest, group_id, "pending")
    plan.unpersist()
    return _table(spark, f"{manifest}/claims", _CLAIMS).where(F.col("group_id") == group_id)


def _note(spark: SparkSession, manifest: str, group_id: str, state: str) -> None:
    step = _table(spark, f"{manifest}/states", _STATES).count()
    spark.createDataFrame([(group_id, state, step)], _STATES).coalesce(1).write.mode("append").parquet(f"{manifest}/states")


def states(spark: SparkSession, manifest: str) -> DataFrame:
    """(group_id, state): each group's newest state: pending, taken or closed."""
    return _table(spark, f"{manifest}/states", _STATES).groupBy("group_id").agg(F.max_by("state", "step").alias("state"))


def take_group(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The requests of the oldest pending group, which is then taken; None if no group waits."""
    log = _table(spark, f"{manifest}/states", _STATES)
    first = states(spark, manifest).where("state = 'pending'").join(log.groupBy("group_id").agg(F.min("step").alias("since")), "group_id").orderBy("since").select("group_id").first()
    if first is None:
        return None
    _note(spark, manifest, first["group_id"], "taken")
    return _table(spark, f"{manifest}/claims", _CLAIMS).where(F.col("group_id") == first["group_id"])


def close_group(spark: SparkSession, manifest: str, group_id: str, results: DataFrame, output: str, on_close: Callable[[str], bool] | None = None) -> None:
    """Write the group's results (document_id, …) as JSON below output/group_id and close it, so that its files may be claimed again. on_close is told the group; if it answers False, an error, and the group stays."""
    if on_close is not None and not on_close(group_id):
        raise RuntimeError(f"the event of {group_id} failed")
    mine = _table(spark, f"{manifest}/claims", _CLAIMS).where(F.col("group_id") == group_id).select("document_id")
    save_documents(results.join(mine, "document_id", "left_semi"), f"{output}/{group_id}")
    _note(spark, manifest, group_id, "closed")


def pseudo_request(spark: SparkSession, document_id: str = "D-0", path: str = "") -> DataFrame:
    """One request without a file."""
    return plan_requests(spark.createDataFrame([(path, path.split("/")[-1], "", document_id)], "path string, filename string, extension string, claim string"), "G-0", "").withColumn("document_id", F.lit(document_id))


def query_sheet(rows: DataFrame, document: str = "") -> DataFrame:
    """Question rows (Q_No, doc_name, …) of a sheet, of one document unless it is ''; a number that comes twice is an error."""
    mine = rows.where(F.col("doc_name") == document) if document else rows
    if mine.groupBy("Q_No").count().where("count > 1").limit(1).count():
        raise ValueError("a Q_No comes twice")
    return mine


def with_metadata(docs: DataFrame) -> DataFrame:
    """Documents with filename, filetype and title filled from the path where they are missing."""
    have = docs.columns
    name = F.element_at(F.split("path", "/"), -1)
    fill = {"filename": name, "filetype": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "title": F.regexp_replace(name, r"\.[^.]*$", "")}
    return docs.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in fill.items()})


def save_documents(rows: DataFrame, path: str) -> None:
    """Whole rows as lines of JSON, their document's id among them. Files follow the size of the table: a folder for each document would cost more than its few bytes."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("errorifexists").text(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "document_id") -> DataFrame:
    """(document_id, value) as save_documents wrote them, value a row's JSON."""
    return spark.read.text(path).select(F.get_json_object("value", f"$.{id_col}").alias(id_col), "value")


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (chunk_key, content, metadata map) as two texts each, in a folder of its key: kind=text with the content, kind=metadata with its JSON."""
    text = chunks.select("chunk_key", F.lit("text").alias("kind"), F.col("content").alias("value"))
    meta = chunks.select("chunk_key", F.lit("metadata").alias("kind"), F.to_json("metadata").alias("value"))
    text.unionByName(meta).write.mode("errorifexists").partitionBy("chunk_key", "kind").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_key, content, metadata) as save_chunks wrote them."""
    raw = spark.read.format("text").option("wholetext", "true").schema("value string, chunk_key string, kind string").load(path)
    text = raw.where("kind = 'text'").select("chunk_key", F.regexp_replace("value", "\n$", "").alias("content"))
    meta = raw.where("kind = 'metadata'").select("chunk_key", F.from_json("value", "map<string,string>").alias("metadata"))
    return text.join(meta, "chunk_key", "left")


def resource_paths(docs: DataFrame, root: str) -> DataFrame:
    """Documents (document_id, path) with `resources`: where their source is kept, by type."""
    kept = F.concat(F.lit(root.rstrip("/") + "/"), "document_id", F.lit("/"), F.element_at(F.split("path", "/"), -1))
    return docs.withColumn("resources", F.array(F.struct(F.lit("source").alias("type"), kept.alias("path"))))


def results_of(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """rag_result rows: answers put beside the sheet's questions by their position (pos)."""
    a = answers.select(F.col("pos").alias("__pos"), *[F.col(c) for c in answers.columns if c != "pos" and c not in questions.columns])
    return questions.join(a, F.col("pos") == F.col("__pos"), "left").drop("__pos")


def unzip(archives: DataFrame) -> DataFrame:
    """(path, content) of zip files -> (path, member, size, text, folder_files): every file of each archive as UTF-8 text, with how many files its folder has."""
    import pandas as pd

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.file_size, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["path", "member", "size", "text"])

    out = archives.select("path", "content").mapInPandas(run, "path string, member string, size long, text string")
    return out.withColumn("folder_files", F.count("*").over(Window.partitionBy("path", F.regexp_replace("member", "[^/]*$", ""))))
