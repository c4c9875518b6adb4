"""Regions from anchors, tokens in regions, nearest tokens, and region subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import bbox


def _on(left: str, right: str):
    return (F.col(f"{left}doc_id") == F.col(f"{right}doc_id")) & (F.col(f"{left}page") == F.col(f"{right}page"))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


#: Units of a band down a page and of one across it, as wide as a column; boxes meet only where they share one.
BAND, WIDE = 100, 600


def _bands(low: Column, high: Column, band: int = BAND) -> Column:
    """The bands that an interval lies in."""
    return F.explode(F.sequence(F.floor(low / band), F.floor(F.greatest(low, high) / band)))


def tokens_within(tokens: DataFrame, regions: DataFrame, tolerance: float = 0) -> DataFrame:
    """(region_id, doc_id, page, ord): tokens that lie wholly inside a region of their page, borders included."""
    r = _named(regions, "r_").withColumn("__rb", _bands(F.col("r_y1") - tolerance, F.col("r_y2") + tolerance))
    t = tokens.withColumn("__tb", F.floor(F.col("y1") / BAND))  # a token's top is in one band
    on = _on("r_", "") & (F.col("__rb") == F.col("__tb")) & bbox.contains(bbox.box("r_"), bbox.box(), tolerance)
    return t.join(r, on).select(F.col("r_region_id").alias("region_id"), "doc_id", "page", "ord")


def tokens_outside(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens of which no region of their page holds them, and which hold none."""
    r = _named(regions, "r_")
    a, b = bbox.box("r_"), bbox.box()
    return tokens.join(r, _on("r_", "") & (bbox.contains(a, b) | bbox.contains(b, a)), "left_anti")


def nearest(tokens: DataFrame, side: str, threshold: float = 0) -> DataFrame:
    """(doc_id, page, ord, near_ord, distance): each token's nearest one on a side of the page, of those that share `threshold` of its extent or more across."""
    low, high, band = ("y1", "y2", BAND) if side in ("right", "left") else ("x1", "x2", WIDE)
    tokens = tokens.select("doc_id", "page", "ord", "x1", "y1", "x2", "y2")
    t = tokens.withColumn("__b", _bands(F.col(low), F.col(high), band))
    o = _named(tokens, "o_").withColumn("__ob", _bands(F.col("o_" + low), F.col("o_" + high), band))
    meet = F.col("__b") == F.floor(F.greatest(low, "o_" + low) / band)  # two that share a stretch meet once, in the band where it starts
    a, b = bbox.box(), bbox.box("o_")
    across_y = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    across_x = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    gap, shared, whole = {
        "right": (b[0] - a[2], across_y, a[3] - a[1]), "left": (a[0] - b[2], across_y, a[3] - a[1]),
        "bottom": (b[1] - a[3], across_x, a[2] - a[0]), "top": (a[1] - b[3], across_x, a[2] - a[0]),
    }[side]
    j = t.join(o, _on("", "o_") & (F.col("__b") == F.col("__ob")) & meet & (F.col("ord") != F.col("o_ord")) & (gap >= 0) & (shared > 0) & (shared >= whole * threshold))
    return j.groupBy("doc_id", "page", "ord").agg(F.min(F.struct(gap.alias("distance"), F.col("o_ord").alias("near_ord"))).alias("b")).select("doc_id", "page", "ord", "b.near_ord", "b.distance")


def anchor_regions(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, page, from_ord, to_ord, box): from each first anchor to the next second one below it on the page; each second anchor closes one region, the nearest."""
    s = _named(second, "s_")
    order = Window.partitionBy("doc_id", "page", "ord").orderBy("s_y1", "s_ord")
    j = first.join(s, _on("", "s_") & (F.col("s_y1") > F.col("y1"))).withColumn("r", F.row_number().over(order)).where("r = 1")
    last = Window.partitionBy("doc_id", "page", "s_ord").orderBy(F.desc("y1"), "ord")
    j = j.withColumn("k", F.row_number().over(last)).where("k = 1")
    return j.select("doc_id", "page", F.col("ord").alias("from_ord"), F.col("s_ord").alias("to_ord"), F.least("x1", "s_x1").alias("x1"), "y1", F.greatest("x2", "s_x2").alias("x2"), F.col("s_y1").alias("y2"))


def subtract(regions: DataFrame, cuts: DataFrame) -> DataFrame:
    """(region_id, doc_id, page, x1, y1, x2, y2): regions without the vertical bands of a cut on their page; one inside leaves two parts."""
    c = _named(cuts, "c_")
    hit = _on("", "c_") & (F.col("c_y1") < F.col("y2")) & (F.col("c_y2") > F.col("y1"))
    j = regions.join(c, hit, "left")
    gaps = j.groupBy("region_id", "doc_id", "page", "x1", "y1", "x2", "y2").agg(
        F.array_sort(F.collect_set(F.when(F.col("c_y1").isNotNull(), F.struct(F.col("c_y1").alias("a"), F.col("c_y2").alias("b"))))).alias("cuts"))
    free = F.expr(
        "aggregate(cuts, named_struct('y', y1, 'out', CAST(array() AS array<struct<a:bigint,b:bigint>>)), (s, c) -> named_struct("
        "'y', greatest(s.y, c.b), 'out', if(c.a > s.y, concat(s.out, array(named_struct('a', s.y, 'b', c.a))), s.out)),"
        " s -> if(s.y < y2, concat(s.out, array(named_struct('a', s.y, 'b', y2))), s.out))")
    return gaps.select("region_id", "doc_id", "page", "x1", "x2", F.explode(free).alias("p")).select("region_id", "doc_id", "page", "x1", F.col("p.a").alias("y1"), "x2", F.col("p.b").alias("y2"))


def hocr_tokens(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(…, kind, text, x, y, w, h, conf) of the words of hOCR text; ocr.hocr has lines and page boxes as well."""
    pattern = r"(?s)<span class=['\"]ocrx_word['\"][^>]*title=['\"]bbox (\d+) (\d+) (\d+) (\d+); x_wconf (\d+)[^>]*>(.*?)</span>"
    parts = [F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(i)) for i in range(1, 7)]
    rest = [c for c in pages.columns if c != text_col]
    z = pages.select(*rest, F.posexplode(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])).alias("ord", "z"))
    g = [F.col(f"z.g{i}") for i in range(6)]
    x, y, x2, y2, conf = (c.cast("long") for c in g[:5])
    return z.select(*rest, "ord", F.lit("word").alias("kind"), F.regexp_replace(g[5], "<[^>]*>", "").alias("text"), x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"), conf.alias("conf"))


def region_confidence(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, conf): the mean word confidence in each region, two decimals, -1 without words."""
    inside = tokens_within(words, regions).join(words.select("doc_id", "page", "ord", "conf"), ["doc_id", "page", "ord"])
    means = inside.groupBy("region_id").agg(F.round(F.avg("conf"), 2).alias("conf"))
    return regions.select("region_id").join(means, "region_id", "left").select("region_id", F.coalesce("conf", F.lit(-1.0)).alias("conf"))
