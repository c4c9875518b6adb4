"""Chunks of segments: by segment, by page, by page and type, and by length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import bbox, text as T
from paperlake.sources.shared import text_batches

#: Characters of parts that leave a task's Python together.
_OUT_CHARS = 1 << 21


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda e: e["content"]), "\n")


def segment_chunks(segments: DataFrame, min_chars: int = 0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One chunk for each segment longer than min_chars whose type is not excluded."""
    s = segments.where(F.length("content") > min_chars)
    s = s.where(~F.col("type").isin(*exclude)) if exclude else s
    key = F.concat_ws("_", F.col("page").cast("string"), F.lit("segment"), F.col("ord").cast("string"))
    return s.select("doc_id", T.stable_id("C", F.col("doc_id"), key).alias("chunk_id"), key.alias("chunk_key"), "page", "content", F.length("content").cast("long").alias("char_count"))


def page_chunks(segments: DataFrame) -> DataFrame:
    """One chunk for each page: contents in order, and the box around them."""
    g = segments.groupBy("doc_id", "page").agg(_joined().alias("content"), *bbox.envelope())
    return g.select("doc_id", T.stable_id("C", F.col("doc_id"), F.col("page")).alias("chunk_id"), "page", "content", F.length("content").cast("long").alias("char_count"), "x1", "y1", "x2", "y2")


def typed_chunks(segments: DataFrame, types: tuple[str, ...] = ("text", "table", "image_text"), together: bool = True) -> DataFrame:
    """Chunks of a page's enabled types: all in one, or the text in one and each other segment in its own, numbered by type."""
    s = segments.where(F.col("type").isin(*types))
    if together:
        name = F.concat_ws("_", F.col("page").cast("string"), F.lit("_".join(types)))
        return s.groupBy("doc_id", "page").agg(_joined().alias("content")).select("doc_id", name.alias("chunk_key"), "page", "content")
    texts = s.where(F.col("type") == "text").groupBy("doc_id", "page").agg(_joined().alias("content")).select(
        "doc_id", F.concat_ws("_", F.col("page").cast("string"), F.lit("text")).alias("chunk_key"), "page", "content")
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "type").orderBy("ord")).cast("string")
    others = s.where(F.col("type") != "text").select("doc_id", F.concat_ws("_", F.col("page").cast("string"), F.col("type"), n).alias("chunk_key"), "page", "content")
    return texts.unionByName(others)


def split_text(text: str, limit: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of at most `limit` characters, cut at the coarsest separator that serves; nothing but separators at cuts is lost."""
    if len(text) <= limit:
        return [text] if text.strip() else []
    sep, rest = separators[0], separators[1:] or ("",)
    if sep == "":
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    out, held = [], ""
    for piece in text.split(sep):
        if held and len(held) + len(sep) + len(piece) > limit:
            out.append(held)
            held = ""
        if len(piece) > limit:
            if held:
                out.append(held)
                held = ""
            out.extend(split_text(piece, limit, rest))
        elif piece:
            held = held + sep + piece if held else piece
    return out + ([held] if held.strip() else [])


def character_chunks(pages: DataFrame, limit: int = 1000) -> DataFrame:
    """(doc_id, page, part, content): page texts in parts of at most `limit` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):  # a text at a time, and parts of so many characters
                d, p, c = (x[i].as_py() for x in batch.columns)
                for n, t in enumerate(split_text(c or "", limit)):
                    rows.append((d, p, n, t))
                    size += len(t)
                    if size > _OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    names, kinds = ["doc_id", "page", "part", "content"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    text_batches(pages.sparkSession)
    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), "content").mapInArrow(run, "doc_id long, page long, part long, content string")
