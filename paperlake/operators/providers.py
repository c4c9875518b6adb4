"""Engines that need a native library, behind one interface: a provider turns a batch of inputs into a batch of results, and runs in the executors.

A provider is registered under a kind and a name with the schema of its results. Those here need no library and give the same
results everywhere: they stand in for real engines in tests, and show what a real one returns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.operators import ocr

KINDS = ("ocr", "pdf", "table_detector", "structure", "embedding", "llm", "moderation", "parser", "strategy", "metrics", "rule")


@dataclass(frozen=True)
class Provider:
    """run: a list of inputs to a list of lists of rows, each a tuple of the schema's columns."""

    run: Callable[[list], list[list[tuple]]]
    schema: str


_REGISTRY: dict[tuple[str, str], Provider] = {}


def register(kind: str, name: str, provider: Provider) -> None:
    """Put a provider under a kind and a name; a name that is taken is an error."""
    if kind not in KINDS:
        raise ValueError(f"kind: {kind}")
    if (kind, name) in _REGISTRY:
        raise ValueError(f"{kind} {name} is registered")
    _REGISTRY[kind, name] = provider


def get(kind: str, name: str) -> Provider:
    if (kind, name) not in _REGISTRY:
        raise KeyError(f"no {kind} provider {name}")
    return _REGISTRY[kind, name]


def apply(rows: DataFrame, input_col: str, provider: Provider, keep: list[str], batch: int = 64) -> DataFrame:
    """A row for each result of each input, with the kept columns; null inputs have no results."""
    names = [c.strip().split(" ")[0] for c in provider.schema.split(", ")]
    kinds = dict(rows.dtypes)
    run = provider.run

    def each(batches):
        for pdf in batches:
            pdf = pdf[pdf[input_col].notna()]
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                got = run(part[input_col].tolist())
                out = [(*[part[c].iloc[i] for c in keep], *r) for i, found in enumerate(got) for r in found]
                yield pd.DataFrame(out, columns=[*keep, *names])

    return rows.select(*dict.fromkeys([*keep, input_col])).mapInPandas(each, ", ".join([f"{c} {kinds[c]}" for c in keep] + [provider.schema]))


#: Pixels of a character cell of the stand-in engines.
CELL_W, CELL_H = 8, 16


def _typed_pages(texts: list) -> list[list[tuple]]:
    """Text as pages: form feeds part them."""
    return [[(i + 1, p) for i, p in enumerate((t if isinstance(t, str) else bytes(t).decode("utf-8", "replace")).split("\f"))] for t in texts]


def _typed_ocr(texts: list) -> list[list[tuple]]:
    """A page of text as read results: a line for each line with a word, in cells of fixed size."""
    def box(row: int, a: int, b: int) -> list[int]:
        x1, x2, y1, y2 = a * CELL_W, b * CELL_W, row * CELL_H, (row + 1) * CELL_H
        return [x1, y1, x2, y1, x2, y2, x1, y2]

    out = []
    for t in texts:
        lines = []
        for row, line in enumerate(t.split("\n")):
            words, at = [], 0
            for w in line.split(" "):
                if w:
                    words.append({"boundingBox": box(row, at, at + len(w)), "text": w, "confidence": 1.0})
                at += len(w) + 1
            if words:
                lines.append({"boundingBox": box(row, 0, len(line)), "text": line.strip(" "), "words": words})
        out.append([(json.dumps({"readResults": [{"unit": "pixel", "lines": lines}]}),)])
    return out


def _dark_boxes(images: list) -> list[list[tuple]]:
    """Tables as the box around the dark pixels of an image (rows of grey values from 0 to 255), with the share of dark pixels in it."""
    out = []
    for image in images:
        dark = np.array([list(r) for r in image], dtype=np.float64) < 128
        rows, columns = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
        if not len(rows):
            out.append([])
            continue
        y1, y2, x1, x2 = int(rows[0]), int(rows[-1]) + 1, int(columns[0]), int(columns[-1]) + 1
        out.append([(x1, y1, x2, y2, round(float(dark[y1:y2, x1:x2].mean()), 6))])
    return out


register("pdf", "typed", Provider(_typed_pages, "page long, text string"))
register("ocr", "typed", Provider(_typed_ocr, "content string"))
register("table_detector", "dark", Provider(_dark_boxes, "x1 long, y1 long, x2 long, y2 long, confidence double"))


def convert_pages(docs: DataFrame, content_col: str, provider: str = "typed") -> DataFrame:
    """(doc_id, page, text) of documents by a pdf provider."""
    return apply(docs.select("doc_id", content_col), content_col, get("pdf", provider), ["doc_id"])


def recognise(pages: DataFrame, image_col: str, provider: str = "typed", parser: str = "azure_read") -> DataFrame:
    """Tokens of pages (doc_id, page, image): an engine's results, read by the parser of its format."""
    return ocr.parse(apply(pages.select("doc_id", "page", image_col), image_col, get("ocr", provider), ["doc_id", "page"]), parser)


def detect_tables(images: DataFrame, image_col: str, provider: str = "dark") -> DataFrame:
    """(image, model, det_id, confidence, box) of images by a detector."""
    found = apply(images.select("image", image_col), image_col, get("table_detector", provider), ["image"])
    n = F.row_number().over(Window.partitionBy("image").orderBy("y1", "x1")) - 1
    return found.select("image", F.lit(provider).alias("model"), n.cast("long").alias("det_id"), "confidence", "x1", "y1", "x2", "y2")


def box_states(images: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """(image, box_id, dark, is_set): the share of dark pixels of each box (image, box_id, x1, y1, x2, y2; ends left out) in its image (image, pixels: rows of grey values), and whether it is at least `least`. A box without pixels is not set."""
    cut = F.flatten(F.transform(F.slice("pixels", F.col("y1") + 1, F.greatest(F.lit(0), F.col("y2") - F.col("y1"))), lambda r: F.slice(r, F.col("x1") + 1, F.greatest(F.lit(0), F.col("x2") - F.col("x1")))))
    j = boxes.join(images.select("image", "pixels"), "image").withColumn("__c", cut)
    dark = F.when(F.size("__c") > 0, F.round(F.size(F.filter("__c", lambda v: v < 128)) / F.size("__c"), 6)).otherwise(F.lit(0.0))
    return j.select("image", "box_id", dark.alias("dark"), (dark >= least).alias("is_set"))


def field_values(tokens: DataFrame, keys: dict[str, str], side: str = "right") -> DataFrame:
    """(doc_id, page, name, value): for each named key text (lower case, equal) the nearest token on a side; null for none."""
    from paperlake.operators import regions

    named = F.create_map(*[F.lit(x) for n, t in keys.items() for x in (t, n)])
    k = tokens.withColumn("name", named[F.lower(F.trim("text"))]).where("name IS NOT NULL")
    near = regions.nearest(tokens, side).select(F.col("doc_id").alias("n_doc"), F.col("page").alias("n_page"), F.col("ord").alias("n_ord"), "near_ord")
    v = tokens.select(F.col("doc_id").alias("v_doc"), F.col("page").alias("v_page"), F.col("ord").alias("v_ord"), F.col("text").alias("value"))
    j = k.join(near, (F.col("doc_id") == F.col("n_doc")) & (F.col("page") == F.col("n_page")) & (F.col("ord") == F.col("n_ord")), "left")
    return j.join(v, (F.col("doc_id") == F.col("v_doc")) & (F.col("page") == F.col("v_page")) & (F.col("near_ord") == F.col("v_ord")), "left").select("doc_id", "page", "ord", "name", "value")


def ruled_cells(lines: DataFrame, gap: float = 5) -> DataFrame:
    """Cells (doc_id, page, row_index, column_index, box) between the ruling lines of a page: lines (doc_id, page, upright, at) at most `gap` apart are one."""
    c = ocr.clusters(lines, ["doc_id", "page", "upright"], "at", gap).groupBy("doc_id", "page", "upright", "cluster").agg(F.avg("at").alias("at"))
    nxt = F.lead("at").over(Window.partitionBy("doc_id", "page", "upright").orderBy("cluster"))
    bands = c.withColumn("to", nxt).where("to IS NOT NULL")
    rows = bands.where("NOT upright").select("doc_id", "page", F.col("cluster").alias("row_index"), F.col("at").alias("y1"), F.col("to").alias("y2"))
    columns = bands.where("upright").select("doc_id", "page", F.col("cluster").alias("column_index"), F.col("at").alias("x1"), F.col("to").alias("x2"))
    return rows.join(columns, ["doc_id", "page"]).select("doc_id", "page", "row_index", "column_index", "x1", "y1", "x2", "y2")


def unruled_cells(words: DataFrame, row_gap: float = 10, column_gap: float = 20) -> DataFrame:
    """Cells (doc_id, page, row_index, column_index, text) of words without lines: rows are clusters of y1, columns of x1; a cell's words by x1 and ord."""
    r = ocr.clusters(words, ["doc_id", "page"], "y1", row_gap).withColumnRenamed("cluster", "row_index")
    c = ocr.clusters(r, ["doc_id", "page"], "x1", column_gap).withColumnRenamed("cluster", "column_index")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "ord", "content"))), lambda e: e["content"]), " ")  # a cell's words
    return c.groupBy("doc_id", "page", "row_index", "column_index").agg(text.alias("text"))


def aggregate_detections(results: DataFrame) -> DataFrame:
    """(image_subpath, model, det_id, confidence, box) of detection files (path, value: JSON {image, model_name, bboxes: [[…]], confidences: […]}): the image's subpath is the first two parts of its path."""
    j = results.select(F.from_json("value", "image string, model_name string, bboxes array<array<double>>, confidences array<double>").alias("j"))
    z = j.select("j.image", "j.model_name", F.posexplode(F.arrays_zip("j.bboxes", "j.confidences")).alias("p", "z"))
    sub = F.array_join(F.slice(F.split("image", "/"), 1, 2), "/")
    return z.select(sub.alias("image_subpath"), F.col("model_name").alias("model"), F.col("p").cast("long").alias("det_id"), F.col("z.confidences").alias("confidence"), *[F.col("z.bboxes")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def file_date(millis: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A file's time in milliseconds as text, in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis), pattern)
