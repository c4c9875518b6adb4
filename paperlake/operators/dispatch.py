"""Steps chosen by configuration: segment generators, consolidation, classifier rules, sequence patterns, chunk methods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import bbox
from paperlake.operators import chunks, layout, segments

_IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
#: A technique by file type and by text provider; a model provider makes a pdf `ocr_based`.
_PDF = {"table_contents": "pdf_table_extraction", "detected_tables": "detected_table_extraction", "image_contents": "pdf_image_extraction", "structured_tables": "structured_table_extraction",
        "tesseract": "scanned_extraction", "ocr_engine": "scanned_extraction", "azure_read": "scanned_extraction"}
_IMAGE = {"detected_tables": "detected_table_extraction", "structured_tables": "structured_table_extraction"}

Generator = Callable[[DataFrame], DataFrame]


def technique(extension: str, step: dict) -> str | None:
    """The technique of one configured step {enabled, input_file_type, text_provider, model_provider} for a file; None if the step is not for it."""
    kind, e = step.get("input_file_type"), extension.lower()
    if not step.get("enabled"):
        return None
    if kind == "json":
        return "json" if e == ".json" else None
    if kind == "pdf" and e == ".pdf":
        return "ocr_based" if step.get("model_provider") else _PDF.get(step.get("text_provider"), "native_pdf")
    if kind == "image" and e in _IMAGES:
        return _IMAGE.get(step.get("text_provider"), "ocr_based")
    if kind == "txt" and e == ".txt":
        return "text"
    return None


def generate(docs: DataFrame, steps: list[dict], generators: dict[str, Generator]) -> DataFrame:
    """Segments of all documents (…, extension) with `technique`: each step's generator runs on the documents of the extensions that it is for; columns that one lacks are null."""
    parts = []
    for step in steps:
        by: dict[str, list[str]] = {}
        for e in (".json", ".pdf", ".txt", *_IMAGES):
            name = technique(e, step)
            if name:
                by.setdefault(name, []).append(e)
        for name, extensions in by.items():
            if name not in generators:
                raise KeyError(f"no generator {name}")
            parts.append(generators[name](docs.where(F.lower("extension").isin(*extensions))).withColumn("technique", F.lit(name)))
    if not parts:
        raise ValueError("no enabled step")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def consolidate(generated: DataFrame, max_height: float = 1500) -> DataFrame:
    """Segments of all techniques as one list: text is kept as it is; column boxes go; of the rest, too high boxes that are no tables or images go, then what overlaps what was accepted, then what has no letter or digit."""
    text = generated.where("technique = 'text'").select("doc_id", "page", "ord", "type", "content", "x1", "y1", "x2", "y2")
    rest = generated.where("technique <> 'text' AND technique NOT LIKE 'column\\_%'").where(F.col("type").isin("table", "image_text") | (F.col("y2") - F.col("y1") < max_height))
    # ords of several techniques clash, so rows are numbered anew
    order = Window.partitionBy("doc_id", "page").orderBy("technique", "ord")
    one = rest.withColumn("ord", F.row_number().over(order).cast("long"))
    return text.unionByName(layout.drop_overlaps(one).where(F.col("content").rlike(r"[\p{L}\p{N}]")))


def classifier_rule(config: dict) -> str:
    """auto or manual: the one enabled technique of header and footer, which must be the same; else an error."""
    def one(part: str) -> str | None:
        on = [k for k, v in config.get(part, {}).items() if isinstance(v, dict) and v.get("enabled")]
        if len(on) > 1:
            raise ValueError(f"{part}: {on}")
        return on[0] if on else None

    header, footer = one("header"), one("footer")
    if header and footer and header != footer:
        raise ValueError(f"header is {header} and footer is {footer}")
    found = header or footer
    if not found:
        raise ValueError("no classifier rule is enabled")
    return found


def classify(rows: DataFrame, page_dims: DataFrame, config: dict) -> DataFrame:
    """Segments with `role` by the rule of the configuration; a segment without a box is an error."""
    rule = classifier_rule(config)
    if rows.where("x1 IS NULL OR y1 IS NULL OR x2 IS NULL OR y2 IS NULL").limit(1).count():
        raise ValueError("a segment has no box")
    if rule == "auto":
        return segments.header_footer_auto(rows, page_dims)
    return segments.header_footer_manual(rows, page_dims, config.get("header", {}).get(rule, {}).get("share", 0.0), config.get("footer", {}).get(rule, {}).get("share", 0.0))


def zigzag_dynamic(rows: DataFrame) -> DataFrame:
    """Segments with `sequence` from 1 in every page: by x1, a new column where x1 is at least 1.05 times the last one's, and y1 in each."""
    by_x = Window.partitionBy("doc_id", "page").orderBy("x1", "y1", "ord")
    jump = F.coalesce((F.col("x1") >= F.lag("x1").over(by_x) * 1.05).cast("int"), F.lit(0))
    s = rows.withColumn("__j", jump).withColumn("__g", F.sum("__j").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("sequence", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("__g", "y1", "x1", "ord")).cast("long")).drop("__j", "__g")


def sequence_by_layout(rows: DataFrame, columns: DataFrame, config: dict | None = None) -> DataFrame:
    """Segments with `layout` (single-column or multi-column, by the page's columns) and `sequence` by the layout's enabled pattern in `config`, else default and zig-zag."""
    def pattern(kind: str, other: str) -> str:
        on = [k for k, v in (config or {}).get(kind, {}).items() if v.get("enabled")]
        return {"sequence-order": "default"}.get(on[0], on[0]) if on else other

    n = columns.groupBy(F.col("doc_id").alias("__d"), F.col("page").alias("__p")).agg(F.count("*").alias("__n"))
    j = rows.join(n, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")), "left")
    j = j.withColumn("layout", F.when(F.coalesce("__n", F.lit(0)) > 1, "multi-column").otherwise("single-column")).drop("__d", "__p", "__n")
    keep = [*rows.columns, "layout", "sequence"]
    return segments.sequence(j.where("layout = 'single-column'"), pattern("single-column", "default")).select(*keep).unionByName(
        segments.sequence(j.where("layout = 'multi-column'"), pattern("multi-column", "zig-zag")).select(*keep))


def make_chunks(rows: DataFrame, config: dict) -> DataFrame:
    """Chunks (doc_id, page, method, chunk_key, content, char_count) of every enabled method {page, page_character, segment, page_and_segment_type}: texts are cleaned, replaced and delimited, segments of excluded types go, titles are merged first."""
    s = rows
    if config.get("exclude"):
        s = s.where(~F.col("type").isin(*config["exclude"]))
    s = segments.prepare(s, [(r["find"], r["replace"]) for r in config.get("replace", [])], config.get("delimiter", ""))
    if config.get("merge_titles"):
        pages = s.groupBy("doc_id", "ord").agg(F.min("page").alias("page"))
        s = segments.merge_titles(s, tuple(config["merge_titles"])).join(pages, ["doc_id", "ord"])
    methods, parts = config.get("methods", {}), []

    def add(name: str, c: DataFrame, key: Column) -> None:
        parts.append(c.select("doc_id", "page", F.lit(name).alias("method"), key.alias("chunk_key"), "content", F.length("content").cast("long").alias("char_count")))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda e: e["content"]), "\n")  # a page's segments
    for name, how in methods.items():
        if not how.get("enabled"):
            continue
        if name == "page":
            add(name, s.groupBy("doc_id", "page").agg(joined.alias("content")), F.col("page").cast("string"))
        elif name == "page_character":
            pages = s.groupBy("doc_id", "page").agg(joined.alias("content"))
            add(name, chunks.character_chunks(pages, how.get("max_chars", 1000)), F.concat_ws("_", F.col("page").cast("string"), F.lit("page_char"), (F.col("part") + 1).cast("string")))
        elif name == "segment":
            add(name, s, F.concat_ws("_", F.col("page").cast("string"), F.lit("segment"), F.col("ord").cast("string")))
        elif name == "page_and_segment_type":
            add(name, chunks.typed_chunks(s, tuple(how.get("types", ("text", "table", "image_text"))), how.get("together", True)), F.col("chunk_key"))
        else:
            raise KeyError(f"no chunk method {name}")
    if not parts:
        raise ValueError("no chunk method is enabled")
    return reduce(DataFrame.unionByName, parts)


def update_documents(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows after every rule in turn: {rename, to}, {set, value} (a column or a field `a.b` of a struct), {boxes: prefix} for x, y, w, h of a box."""
    out = rows
    for r in rules:
        if "rename" in r:
            out = out.withColumnRenamed(r["rename"], r["to"])
        elif "set" in r:
            name, _, field = r["set"].partition(".")
            value = F.lit(r["value"])
            out = out.withColumn(name, F.col(name).withField(field, value) if field else value)
        elif "boxes" in r:
            box = bbox.box(r["boxes"])
            out = out.withColumns({f"{r['boxes']}{n}": v for n, v in zip("xywh", bbox.to_xywh(box))})
        else:
            raise KeyError(f"rule: {sorted(r)}")
    return out


def scale_to_image(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes in image units: x by image_width / width and y by image_height / height of the page (doc_id, page, …), as they are where a page has no sizes."""
    p = pages.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), (F.col("image_width") / F.col("width")).alias("__kx"), (F.col("image_height") / F.col("height")).alias("__ky"))
    j = rows.join(p, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")), "left")
    scaled = bbox.rescale(bbox.box(), F.col("__kx"), F.col("__ky"))
    others = [c for c in rows.columns if c not in ("x1", "y1", "x2", "y2")]
    return j.select(*others, *[F.round(c, 6).alias(n) for c, n in zip(scaled, ("x1", "y1", "x2", "y2"))])
