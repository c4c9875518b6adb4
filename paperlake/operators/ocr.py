"""Tokens from the output of recognition engines: (doc_id, page, kind, ord, text, x, y, w, h, conf), one row for each line and word.

Every parser takes (doc_id, page, content), one row for each result file, where page is used if the file
has none of its own. Text that is no such output gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import text as T

_OUT = ["doc_id", "page", "kind", "ord", "text", "x", "y", "w", "h", "conf"]
#: The field in which the producer of a result file may note its page and the page's size; set it to what the producer writes.
NOTE = "generator_metadata"


def _parsed(results: DataFrame, schema: str) -> DataFrame:
    """(doc_id, given, j): files that parse, each parsed once: as the rows of a generator, `j` cannot be computed anew for every use."""
    return results.select("doc_id", F.col("page").alias("given"), F.explode_outer(F.array(F.from_json("content", schema))).alias("j")).where("j IS NOT NULL")


def _rows(df: DataFrame, items: dict[str, str], text: str, box: list[str], conf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of an array for each kind, all of one type, as tokens of one pass; box is left, top, right and bottom as SQL over `t`."""
    kinds = F.array(*[F.expr(f"named_struct('kind', '{k}', 'items', {v})") for k, v in items.items()])
    e = df.select("doc_id", "page", *keep, F.explode(kinds).alias("k")).select("doc_id", "page", *keep, "k.kind", F.posexplode_outer("k.items").alias("ord", "t")).where("ord IS NOT NULL")
    l, t, r, b = box
    return e.selectExpr("doc_id", "CAST(page AS bigint) AS page", "kind", "CAST(ord AS bigint) AS ord", f"{text} AS text", f"CAST({l} AS double) AS x", f"CAST({t} AS double) AS y",
                        f"CAST({r} - ({l}) AS double) AS w", f"CAST({b} - ({t}) AS double) AS h", f"CAST({conf} AS double) AS conf").select(*_OUT)


def _page(own: str) -> Column:
    """The page that the file's producer noted, else the file's own, else the given one."""
    return F.expr(f"coalesce(CAST(j.{NOTE}.doc_page_num AS bigint), {own}, given)")


def azure_read(results: DataFrame) -> DataFrame:
    """readResults of pages with lines and words; boxes are eight numbers, of which the outermost count; confidence in percent."""
    word = "struct<boundingBox: array<double>, text: string, confidence: double>"
    schema = f"struct<{NOTE}: struct<doc_page_num: string>, readResults: array<struct<page: bigint, unit: string, width: double, height: double, lines: array<struct<boundingBox: array<double>, text: string, words: array<{word}>>>>>>"
    j = _parsed(results, schema)
    pages = j.select("doc_id", "given", "j", F.explode("j.readResults").alias("p")).select("doc_id", _page("p.page").alias("page"), "p")
    box = [f"least(t.boundingBox[{a}], t.boundingBox[{b}])" for a, b in ((0, 6), (1, 3))] + [f"greatest(t.boundingBox[{a}], t.boundingBox[{b}])" for a, b in ((2, 4), (5, 7))]
    lines = "transform(p.lines, l -> named_struct('boundingBox', l.boundingBox, 'text', l.text, 'confidence', CAST(NULL AS double)))"
    return _rows(pages, {"line": lines, "word": "flatten(transform(p.lines, l -> l.words))"}, "t.text", box, "if(kind = 'line', -1, coalesce(t.confidence, 0) * 100)")


def azure_regions(results: DataFrame) -> DataFrame:
    """regions of lines of words; boxes are text `x,y,w,h`; a line's text is that of its words; no confidence."""
    schema = f"struct<{NOTE}: struct<doc_page_num: string>, regions: array<struct<lines: array<struct<boundingBox: string, words: array<struct<boundingBox: string, text: string>>>>>>>"
    j = _parsed(results, schema).select("doc_id", _page("CAST(NULL AS bigint)").alias("page"), "j")
    part = lambda i: f"CAST(split(t.boundingBox, ',')[{i}] AS double)"
    box = [part(0), part(1), f"{part(0)} + {part(2)}", f"{part(1)} + {part(3)}"]
    lines = "transform(flatten(transform(j.regions, r -> r.lines)), l -> named_struct('boundingBox', l.boundingBox, 'text', array_join(transform(l.words, w -> w.text), ' ')))"
    return _rows(j, {"line": lines, "word": "flatten(flatten(transform(j.regions, r -> transform(r.lines, l -> l.words))))"}, "t.text", box, "-1")


def aws_blocks(results: DataFrame) -> DataFrame:
    """Blocks of type LINE and WORD; boxes are shares of the page, whose size the producer noted: left and top rounded down, width and height up."""
    schema = f"struct<{NOTE}: struct<doc_page_num: string, width: double, height: double>, Blocks: array<struct<BlockType: string, Text: string, Confidence: double, Geometry: struct<BoundingBox: struct<Width: double, Height: double, Left: double, Top: double>>>>>"
    j = _parsed(results, schema).select("doc_id", _page("CAST(NULL AS bigint)").alias("page"), F.col(f"j.{NOTE}").alias("m"), F.col("j.Blocks").alias("blocks"))
    g = "t.Geometry.BoundingBox"
    left, top = f"floor({g}.Left * m.width)", f"floor({g}.Top * m.height)"
    box = [left, top, f"{left} + ceil({g}.Width * m.width)", f"{top} + ceil({g}.Height * m.height)"]
    return _rows(j, {k: f"filter(blocks, b -> b.BlockType = '{k.upper()}')" for k in ("line", "word")}, "t.Text", box, "t.Confidence", ("m",))


def pdf_tokens(results: DataFrame) -> DataFrame:
    """tokens of type line with boxes left, top, right, bottom; no words and no confidence."""
    schema = f"struct<{NOTE}: struct<doc_page_num: string>, page: bigint, width: double, height: double, tokens: array<struct<type: string, text: string, bbox: array<double>>>>"
    j = _parsed(results, schema).select("doc_id", _page("j.page").alias("page"), "j")
    return _rows(j, {"line": "filter(j.tokens, t -> t.type = 'line')"}, "t.text", [f"t.bbox[{i}]" for i in range(4)], "-1")


_HOCR_PAGE = r"(?s)<div[^>]*class=['\"]ocr_page['\"][^>]*bbox (\d+) (\d+) (\d+) (\d+)[^>]*ppageno (\d+)"


def _span(classes: str) -> str:
    """The start of a span up to its class, read once: of several classes the first one serves as well as any, since titles behind a later one are behind it too."""
    own = f"class=['\"]{classes}['\"]"
    return f"<span[^>c]*+(?:(?!{own})c[^>c]*+)*+{own}"


_HOCR_LINE = _span("(?:ocr_line|ocr_header)") + r"[^>]*title=['\"]bbox (\d+) (\d+) (\d+) (\d+)"
_HOCR_WORD = r"(?s)" + _span("ocrx_word") + r"[^>]*title=['\"]bbox (\d+) (\d+) (\d+) (\d+);[^'\"]*?x_wconf (\d+)[^>]*>([^<]*+(?:<(?!/?span)[^<]*+)*+)</span>"
#: The groups of what the pattern of a word has found.
_HOCR_PARTS = r"(?s)^[^>]*title=['\"]bbox (\d+) (\d+) (\d+) (\d+);[^'\"]*?x_wconf (\d+)[^>]*>(.*)</span>$"


def _plain(html: Column) -> Column:
    """Text of markup: tags out, white space as one blank, the entities of markup resolved."""
    out = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.when(html.rlike(r"[<&\s]"), out).otherwise(html)  # most words are plain


def hocr(results: DataFrame) -> DataFrame:
    """hOCR text: page boxes, lines (and header lines) with the text of their words, and words with their confidence. The page is the file's ppageno plus one."""
    own = F.regexp_extract("content", _HOCR_PAGE, 5)
    base = results.select("doc_id", F.coalesce(F.when(own != "", own.cast("bigint") + 1), F.col("page")).cast("bigint").alias("page"), "content").where("content IS NOT NULL")
    raw = {
        "page": F.regexp_extract_all("content", F.lit(_HOCR_PAGE), F.lit(0)),
        "line": F.filter(F.split("content", f"(?={_HOCR_LINE})"), lambda x: x.rlike("^" + _HOCR_LINE)),
        "word": F.regexp_extract_all("content", F.lit(_HOCR_WORD), F.lit(0))}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("items")) for k, v in raw.items()])
    e = base.select("doc_id", "page", F.explode(kinds).alias("k")).select("doc_id", "page", "k.kind", F.posexplode_outer("k.items").alias("ord", "m")).where("ord IS NOT NULL")
    line, word = F.col("kind") == "line", F.col("kind") == "word"
    # what a pattern's groups found, blank by blank; the last one may have blanks
    groups = F.split(F.when(word, F.regexp_replace("m", _HOCR_PARTS, "$1 $2 $3 $4 $5 $6")).when(line, F.regexp_replace("m", f"(?s)^{_HOCR_LINE}.*$", "$1 $2 $3 $4")).otherwise(
        F.regexp_replace("m", _HOCR_PAGE, "$1 $2 $3 $4")), " ", 6)
    z = e.select("doc_id", "page", "kind", F.col("ord").cast("bigint").alias("ord"), F.when(line, F.col("m")).alias("m"), F.explode_outer(F.array(groups)).alias("g"))
    l, t, r, b = (F.get("g", F.lit(i)).cast("double") for i in range(4))
    words = F.array_join(F.transform(F.regexp_extract_all("m", F.lit(_HOCR_WORD), F.lit(6)), _plain), " ")
    text = F.when(F.col("kind") == "word", _plain(F.get("g", F.lit(5)))).when(F.col("kind") == "line", words).otherwise("")
    conf = F.when(F.col("kind") == "word", F.get("g", F.lit(4)).cast("double")).otherwise(-1.0)
    return z.select("doc_id", "page", "kind", "ord", text.alias("text"), l.alias("x"), t.alias("y"), (r - l).alias("w"), (b - t).alias("h"), conf.alias("conf"))


PARSERS = {"hocr": hocr, "azure_read": azure_read, "azure_ocr": azure_regions, "aws_detect": aws_blocks, "pdf_tokens": pdf_tokens}


def parse(results: DataFrame, provider: str) -> DataFrame:
    """Tokens by the name of the engine."""
    if provider not in PARSERS:
        raise KeyError(f"no parser {provider}")
    return PARSERS[provider](results)


def to_segments(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, ord, type, content, box, conf): line tokens as segments, words where a page has no lines; a page of `pages` (doc_id, page) without text has a single row `[NO DATA FOUND]` without a box."""
    lines = tokens.where("kind = 'line' AND trim(text) <> ''")
    s = lines.select("doc_id", "page", "ord", F.lit("line").alias("type"), F.col("text").alias("content"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "conf")
    blank = pages.select("doc_id", "page").join(s.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    none = F.lit(None).cast("double")
    return s.unionByName(blank.select("doc_id", "page", F.lit(0).cast("long").alias("ord"), F.lit("line").alias("type"), F.lit("[NO DATA FOUND]").alias("content"), none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"), F.lit(-1.0).alias("conf")))


def content_segments(contents: DataFrame) -> DataFrame:
    """Tables and images (doc_id, page, ord, kind, data, data_html, text, box) as segments: a table's HTML, else its data as JSON; an image's text."""
    content = F.when(F.col("kind") == "table", F.coalesce("data_html", "data")).otherwise(F.coalesce("text", F.lit("")))
    return contents.select("doc_id", "page", "ord", F.when(F.col("kind") == "table", "table").otherwise("image_text").alias("type"), content.alias("content"), "x1", "y1", "x2", "y2")


def link_words(words: DataFrame, links: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, page, ord, uri): each word's first link (by link_id) of the page that covers at least `least` of the word's area; null for none."""
    k = links.select(F.col("doc_id").alias("k_doc"), F.col("page").alias("k_page"), "link_id", "uri", *[F.col(c).alias("k_" + c) for c in ("x1", "y1", "x2", "y2")])
    w = F.least("x2", "k_x2") - F.greatest("x1", "k_x1")
    h = F.least("y2", "k_y2") - F.greatest("y1", "k_y1")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on = (F.col("doc_id") == F.col("k_doc")) & (F.col("page") == F.col("k_page")) & (w > 0) & (h > 0) & (w * h >= area * least)
    return words.join(k, on, "left").groupBy("doc_id", "page", "ord").agg(F.min_by("uri", "link_id").alias("uri"))


def rows_to_cells(tokens: DataFrame) -> DataFrame:
    """Words of tables (doc_id, page, table_no, text, x1, y1) as cells (…, cell_id, row_index, column_index, is_header): rows by equal y1, the topmost is the header; columns by equal x1."""
    of = Window.partitionBy("doc_id", "page", "table_no")
    cell = tokens.withColumn("row_index", F.dense_rank().over(of.orderBy("y1")) - 1).withColumn("column_index", F.dense_rank().over(of.orderBy("x1")) - 1)
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_tb"), F.col("table_no").cast("string"))
    return cell.select("doc_id", "page", "table_no", name.alias("cell_id"), F.col("row_index").cast("long").alias("row_index"), F.col("column_index").cast("long").alias("column_index"), (F.col("row_index") == 0).alias("is_header"), "text")


def pick_cells(cells: DataFrame, rows: list[tuple[int, int]] = (), columns: list[tuple[int, int]] = ()) -> DataFrame:
    """Cells in any of the row ranges and of the column ranges (ends included; none: all), of which rows and columns without any text are left out."""
    def inside(c: str, ranges: list[tuple[int, int]]) -> Column:
        out = F.lit(not ranges)
        for a, b in ranges:
            out = out | F.col(c).between(a, b)
        return out

    kept = cells.where(inside("row_index", list(rows)) & inside("column_index", list(columns)))
    full = F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))) .over(Window.partitionBy("doc_id", "page", "table_no", "row_index"))
    wide = F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))).over(Window.partitionBy("doc_id", "page", "table_no", "column_index"))
    return kept.withColumn("__f", full).withColumn("__w", wide).where("__f > 0 AND __w > 0").drop("__f", "__w")


def header_names(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, column_index, name): header texts made distinct: the second `a` is `a1`; a column without one is `col_n`."""
    h = cells.where("is_header").withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "table_no", "t").orderBy("column_index")) - 1
    name = F.when(F.col("t") == "", F.concat(F.lit("col_"), F.col("column_index").cast("string"))).when(n == 0, F.col("t")).otherwise(F.concat("t", n.cast("string")))
    return h.select("doc_id", "page", "table_no", "column_index", name.alias("name"))


def clusters(values: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Rows with `cluster`, from 0 in each key: values in order whose steps are at most `gap` are one."""
    line = Window.partitionBy(*keys).orderBy(value)
    jump = F.coalesce((F.col(value) - F.lag(value).over(line) > gap).cast("int"), F.lit(0))
    return values.withColumn("__j", jump).withColumn("cluster", F.sum("__j").over(line.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__j")


def line_groups(words: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, page, line, content, box): words whose y1 is within a share of the first word's height of the line's first y1, left to right."""
    page = Window.partitionBy("doc_id", "page").orderBy("y1", "x1", "ord")
    start = F.coalesce((F.col("y1") - F.lag("y1").over(page)) > (F.lag("y2").over(page) - F.lag("y1").over(page)) * share, F.lit(True))
    s = words.withColumn("__s", start.cast("int")).withColumn("line", F.sum("__s").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x1", "ord", "content"))), lambda e: e["content"])  # a line's words
    return s.groupBy("doc_id", "page", "line").agg(F.array_join(parts, " ").alias("content"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def distinct_text(rows: DataFrame) -> DataFrame:
    """Segments with a letter or digit whose text is not that of the kept one before it on the page."""
    kept = rows.where(F.col("content").rlike(r"[\p{L}\p{N}]"))
    before = F.lag("content").over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    return kept.withColumn("__b", before).where("__b IS NULL OR __b <> content").drop("__b")


def sized(boxes: DataFrame, min_w: float = 0, max_w: float | None = None, min_h: float = 0, max_h: float | None = None, aspect: tuple[float, float] | None = None) -> DataFrame:
    """Boxes of allowed width, height and width over height."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = boxes.where((w >= min_w) & (h >= min_h))
    out = out.where(w <= max_w) if max_w is not None else out
    out = out.where(h <= max_h) if max_h is not None else out
    return out.where((w >= h * aspect[0]) & (w <= h * aspect[1])) if aspect else out


def approximate_tokens(text: Column) -> Column:
    """A stand-in for an encoder's length: pieces between blanks."""
    return F.size(F.filter(F.split(T.clean(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))
