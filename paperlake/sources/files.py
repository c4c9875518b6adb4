"""Document sources and sinks: files, JSON detections, truth tables, templates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIME = {"pdf": "application/pdf", "txt": "text/plain", "json": "application/json", "html": "text/html", "png": "image/png", "jpg": "image/jpeg", "csv": "text/csv"}


def list_files(spark: SparkSession, folder: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """(path, filename, extension, size, modified, mime_type, claim): files below a folder by extension; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = files.select("path", name.alias("filename"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("path").alias("claim"))
    out = out.where(F.col("filename") != "empty.fsh")
    out = out.where(F.col("extension").isin(*include)) if include else out
    out = out.where(~F.col("extension").isin(*exclude)) if exclude else out
    mime = F.create_map(*[F.lit(x) for kv in _MIME.items() for x in kv])
    return out.withColumn("mime_type", F.coalesce(mime[F.col("extension")], F.lit("application/octet-stream")))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file, or a folder with all in it; False if there is none."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; the target's parent is made, and what stands at the target is an error."""
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        raise FileExistsError(target)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder between any two file systems that Spark can open."""
    fs, p = _fs(spark, source)
    to, q = _fs(spark, target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, False, spark._jsc.hadoopConfiguration()):
        raise OSError(target)


def info(spark: SparkSession, path: str) -> dict:
    """name, size, type and modification time (milliseconds) of a path."""
    fs, p = _fs(spark, path)
    s = fs.getFileStatus(p)
    return {"name": p.getName(), "size": s.getLen(), "type": "directory" if s.isDirectory() else "file", "modified": s.getModificationTime()}


def read_file(spark: SparkSession, path: str) -> bytes:
    """One file's bytes, for configurations and the like."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_file(spark: SparkSession, path: str, data: bytes, append: bool = False) -> None:
    """Write one small file; with append, behind what it holds."""
    fs, p = _fs(spark, path)
    before = read_file(spark, path) if append and fs.exists(p) else b""
    out = fs.create(p, True)
    out.write(bytearray(before + data))
    out.close()


def write_if_different(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file unless it holds the same already; whether it was written."""
    if exists(spark, path) and read_file(spark, path) == data:
        return False
    write_file(spark, path, data)
    return True


def batch(files: DataFrame, size: int) -> DataFrame:
    """The first `size` files by path."""
    return files.orderBy("path").limit(size)


def human_size(size: Column) -> Column:
    """Bytes as `1.5 KB`, in units of 1024 up to GB."""
    step = F.when(size > 0, F.least(F.lit(3), F.floor(F.log(1024.0, size)))).otherwise(F.lit(0)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    return F.concat(F.format_number(size / F.pow(F.lit(1024.0), step), 2), F.lit(" "), unit)


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, text): one row for each whole text file; ids follow from paths."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def truth_tables(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows of a CSV with a header (a byte order mark is dropped); coordinates as integers."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.col(c).cast("long").alias(c) if c in ("x1", "y1", "x2", "y2", "rows", "columns") else F.col(c) for c in raw.columns])


_DETECTIONS = "metadata MAP<STRING, STRING>, records ARRAY<STRUCT<image: STRING, model_name: STRING, confidence: DOUBLE, bbox: ARRAY<DOUBLE>>>"


def detections(spark: SparkSession, path: str, one_dataset: bool = False) -> DataFrame:
    """(image, model, det_id, confidence, box) of detection files {metadata, records}; model_ metadata goes to each record.

    A record that has such a key itself is an error, and with one_dataset so are files of several dataset names.
    """
    raw = spark.read.schema(_DETECTIONS).json(path, multiLine=True)
    r = raw.select("metadata", F.posexplode("records").alias("det_id", "r"))
    if r.where(F.col("r.model_name").isNotNull() & F.map_contains_key("metadata", "model_name")).limit(1).count():
        raise ValueError("a record has a key of its file's metadata")
    if one_dataset and raw.select(F.col("metadata")["dataset_name"].alias("d")).distinct().limit(2).count() > 1:
        raise ValueError("the files are of several datasets")
    b = F.col("r.bbox")
    return r.select("r.image", F.coalesce("r.model_name", F.col("metadata")["model_name"]).alias("model"), F.col("det_id").cast("long").alias("det_id"), "r.confidence", b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2"))


def fill_json_template(rows: DataFrame, json_col: str, template: str) -> DataFrame:
    """Rows with `content`: a template whose {$.path} placeholders take values of the JSON; ,delimiter=x joins an array by x."""
    import re

    out = F.lit(template)
    for whole, path, delimiter in re.findall(r"(\{(\$[^},]*)(?:,delimiter=([^}]*))?\})", template):
        value = F.get_json_object(json_col, path)
        if delimiter:
            value = F.coalesce(F.array_join(F.from_json(value, "array<string>"), delimiter), value)
        out = F.replace(out, F.lit(whole), F.coalesce(value, F.lit("")))
    return rows.withColumn("content", out)


def save_snapshots(rows: DataFrame, path: str, id_col: str = "document_id") -> None:
    """Rows as JSON by document; an id that comes twice is an error."""
    if rows.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError(f"{id_col} is not unique")
    rows.write.mode("errorifexists").json(path)


def save_report(rows: DataFrame, path: str, kind: str = "csv", append: bool = False) -> None:
    """A report as csv, json or parquet."""
    writer = rows.write.mode("append" if append else "errorifexists")
    writer.option("header", "true").csv(path) if kind == "csv" else getattr(writer, kind)(path)
