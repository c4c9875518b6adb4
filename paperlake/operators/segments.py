"""Segments from text, text transforms, layout order, headers and footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import bbox, text as T

_HAS_TEXT = r"[^\x20\x09-\x0D]"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, content): the lines of a text that are not blank, unstripped, numbered from 0."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(_HAS_TEXT))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("ord", "content"))


def prepare(segments: DataFrame, replacements: list[tuple[str, str]] = (), delimiter: str = "") -> DataFrame:
    """Content cleaned, then replaced, then delimited."""
    return segments.withColumn("content", F.concat(T.replace_all(T.clean(F.col("content")), list(replacements)), F.lit(delimiter)))


def merge_titles(segments: DataFrame, merged: tuple[str, ...] = ("Text", "List")) -> DataFrame:
    """A Title and the following rows of `merged` types become one row `title:text:...`; other rows pass through."""
    line = Window.partitionBy("doc_id").orderBy("ord")
    part = F.col("type").isin("Title", *merged)
    s = segments.withColumn("grp", F.sum((F.col("type") == "Title").cast("int")).over(line))
    joined = s.where(part & (F.col("grp") > 0)).groupBy("doc_id", "grp").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda e: e["content"]), ":").alias("content"))
    joined = joined.select("doc_id", "ord", F.lit("Title").alias("type"), "content")
    return joined.unionByName(s.where(~part | (F.col("grp") == 0)).select("doc_id", "ord", "type", "content"))


def column_islands(segments: DataFrame) -> DataFrame:
    """(doc_id, column_seq, page, box): columns of a page; one starts where x1 lies right of all boxes before it."""
    order = Window.partitionBy("doc_id", "page").orderBy("x1", "y1", "ord")
    start = F.coalesce(F.col("x1") > F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    s = segments.withColumn("new", start.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = s.groupBy("doc_id", "page", "island").agg(*bbox.envelope(), F.count("*").alias("n_segments"))
    across = Window.partitionBy("doc_id").orderBy("page", "island")
    return islands.select("doc_id", F.row_number().over(across).cast("long").alias("column_seq"), "page", "x1", "y1", "x2", "y2", "n_segments")


def assign_columns(segments: DataFrame, columns: DataFrame) -> DataFrame:
    """Segments with column_seq: the first column of the page with x1 <= segment x1 < x2, or -1."""
    c = columns.select(F.col("doc_id").alias("c_doc"), F.col("page").alias("c_page"), F.col("x1").alias("c_x1"), F.col("x2").alias("c_x2"), "column_seq")
    inside = (F.col("doc_id") == F.col("c_doc")) & (F.col("page") == F.col("c_page")) & (F.col("x1") >= F.col("c_x1")) & (F.col("x1") < F.col("c_x2"))
    return segments.join(c, inside, "left").groupBy("doc_id", "page", "ord").agg(F.coalesce(F.min("column_seq"), F.lit(-1)).alias("column_seq"))


def sequence(segments: DataFrame, pattern: str = "default") -> DataFrame:
    """Segments with `sequence`, from 1 in every page: default (list order), left-right (y1, x1), or zig-zag
    (columns by x1, a new one where x1 jumps by more than 50, and y1 in each)."""
    page = Window.partitionBy("doc_id", "page")
    if pattern == "default":
        order = page.orderBy("ord")
    elif pattern == "left-right":
        order = page.orderBy("y1", "x1", "ord")
    elif pattern == "zig-zag":
        by_x = page.orderBy("x1", "y1", "ord")
        jump = F.coalesce((F.col("x1") - F.lag("x1").over(by_x) > 50).cast("int"), F.lit(0))
        segments = segments.withColumn("jump", jump).withColumn("sub", F.sum("jump").over(by_x.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")
        order = page.orderBy("sub", "y1", "x1", "ord")
    else:
        raise ValueError(f"pattern: {pattern}")
    return segments.withColumn("sequence", F.row_number().over(order).cast("long"))


def empty_line_marks(segments: DataFrame) -> DataFrame:
    """Content with a line break where the gap below is over the column's mean and a sentence seems to end; segments carry column_seq."""
    column = Window.partitionBy("doc_id", "page", "column_seq")
    order = column.orderBy("x1", "y1", "ord")
    gap = F.lead("y1").over(order) - F.col("y2")
    s = segments.withColumn("gap", gap).withColumn("next", F.lead("content").over(order))
    s = s.withColumn("mean_gap", F.avg("gap").over(column))
    ends = F.trim(F.col("content")).rlike(r"[,.]$") | F.col("next").rlike(r"^[A-Z]")
    return s.withColumn("content", F.when((F.col("gap") > F.col("mean_gap")) & ends, F.concat("content", F.lit("\n"))).otherwise(F.col("content")))


def header_footer_auto(segments: DataFrame, page_dims: DataFrame, band: float = 0.1, near: int = 75) -> DataFrame:
    """Segments with `role`: header or footer in the outer bands of a page, if at most two neighbours stand on one side and none on the other."""
    d = page_dims.select(F.col("doc_id").alias("d_doc"), F.col("page").alias("d_page"), "height")
    s = segments.join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("page") == F.col("d_page")), "left")
    # neighbours are counted with frames over y, not by pairing the rows of a page
    by_top = Window.partitionBy("doc_id", "page").orderBy("y1")
    below = F.count("*").over(by_top.rangeBetween(1, near))
    above = F.count("*").over(by_top.rangeBetween(-near, -1))
    lone = ((below <= 2) & (above == 0)) | ((above <= 2) & (below == 0))
    role = F.when((F.col("y1") <= F.col("height") * band) & lone, "header").when((F.col("y2") >= F.col("height") * (1 - band)) & lone, "footer").otherwise("body")
    return s.withColumn("role", role)


def header_footer_manual(segments: DataFrame, page_dims: DataFrame, header: float, footer: float) -> DataFrame:
    """Segments with `role` by fixed shares of the page height at its top and bottom."""
    d = page_dims.select(F.col("doc_id").alias("d_doc"), F.col("page").alias("d_page"), "height")
    s = segments.join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("page") == F.col("d_page")), "left")
    return s.withColumn("role", F.when(F.col("y2") <= F.col("height") * header, "header").when(F.col("y1") >= F.col("height") * (1 - footer), "footer").otherwise("body"))


def consolidation_priority(kind: Column) -> Column:
    return F.when(kind == "image_text", 0).when(kind == "table", 1).otherwise(2)
