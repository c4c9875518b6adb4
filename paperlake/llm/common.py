"""Expressions and helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that is no part of an alphanumeric word, and everything that is white space.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
#: Copies of one row that a task makes at once.
COPIES = 4096
#: A key has very many rows if over one row in HOT_SHARE has it, and over HOT_LEAST rows.
HOT_SHARE = 10_000
HOT_LEAST = 1000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 512
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; lower() is as good, and faster, where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def pieces(text: Column, gap: str) -> Column:
    """The non-empty pieces between gaps; null has none."""
    return F.coalesce(F.array_remove(F.split(text, gap), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return pieces(ascii_lower(text), WORD_GAP)


def text_digest(text: Column) -> Column:
    """Stands for a text in keys, so that rows of one doc_id with other texts stay apart; null stays null."""
    return F.md5(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if the master is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            folder = "file://" + tempfile.mkdtemp(prefix="paperlake-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def text_batches(spark: SparkSession) -> None:
    """Texts may be long, so Arrow batches get fewer rows than by default; a session's own setting stays."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """Rows joined with a table that has each of their keys once, and in `count` how many rows have it (the column goes).

    Keys of very many rows, at most HOT_SHARE of them, are broadcast, so that no task gets all rows of one.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_LEAST, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(table.drop(count), key)
    hot = table.where(F.col(count) > limit).drop(count)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(table.drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as many times as its column `times` says: first once for every COPIES of them, dealt out over all tasks, then each of these that often."""
    part = df.withColumn("__part", F.explode(F.expr(f"sequence(0L, (CAST({times} AS bigint) - 1) div {COPIES})"))).hint("rebalance")
    left = F.expr(f"least({COPIES}L, CAST({times} AS bigint) - __part * {COPIES})")
    return part.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("__copy", "__part", times)
