"""The folder that driver and executors share, for tables that cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if the master is local, else an error."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperlake-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, for Python that takes whole texts; any other setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "512")
