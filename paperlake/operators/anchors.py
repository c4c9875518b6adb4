"""Regions by definition: anchor texts, points in pixels, percent or text sizes, and what stands inside or next to them.

Tokens are (doc_id, page, ord, text, box) with box x1, y1, x2, y2, and pages (doc_id, page, width, height).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.operators import evaluate, regions

_BOX = ("x1", "y1", "x2", "y2")
BEGIN, END = "{{BOD}}", "{{EOD}}"


def char_cosine(a: str, b: Column) -> Column:
    """Cosine of the counts of characters of a given text and a column, three decimals; 0 for an empty one."""
    chars = sorted(set(a))
    length = sum(a.count(c) ** 2 for c in chars) ** 0.5
    shared = reduce(lambda x, y: x + y, [F.lit(a.count(c)) * (F.length(b) - F.length(F.replace(b, F.lit(c), F.lit("")))) for c in chars], F.lit(0))
    own = F.sqrt(F.aggregate(F.array_distinct(F.split(b, "")), F.lit(0.0), lambda s, c: s + F.pow(F.length(b) - F.length(F.replace(b, c)), F.lit(2.0))))
    return F.when((own > 0) & F.lit(length > 0), F.round(shared / own / F.lit(length or 1.0), 3)).otherwise(F.lit(0.0))


def similar(anchor: str, text: Column, least: float) -> Column:
    """Whether some run of as many words of the text as the anchor has is as similar as `least`, in lower case."""
    a = anchor.lower()
    if a and least > 0.001:
        return F.when(F.trim(text) != "", _similar_runs(a, least)(F.lower(text))).otherwise(F.lit(False))
    n = len(a.split(" "))
    w = F.split(F.lower(text), " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when((F.size(w) >= n) & (F.trim(text) != ""), F.exists(runs, lambda r: char_cosine(a, r) >= least)).otherwise(F.lit(False))


#: Characters that are looked at together.
_CHARS = 1 << 20


def _similar_runs(a: str, least: float):
    """The test of `similar` for lower-case texts, by batch.

    Sums over runs of words are differences of running sums. They give the product of the counts as it is, and bounds of the run's length from below: characters
    that the anchor has equally often count together. Only runs that such a bound leaves are compared character by character.
    """
    own = Counter(a)
    times = sorted(set(own.values()))
    groups = [sorted(c for c in own if own[c] == t) for t in times]
    length, n = sum(t * t for t in own.values()) ** 0.5, len(a.split(" "))

    def close(run: str) -> bool:
        have = Counter(run)
        size = math.sqrt(sum(float(x) ** 2 for x in have.values()))
        value = sum(own[c] * x for c, x in have.items()) / size / length if size else 0.0
        return float(Decimal(repr(value)).quantize(Decimal("0.001"), ROUND_HALF_UP)) >= least

    def found(texts: list[str]) -> np.ndarray:
        hit = np.zeros(len(texts), dtype=bool)
        codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(codes)]])
        words = np.array([t.count(" ") + 1 for t in texts])
        of = np.repeat(np.arange(len(texts)), words)
        if len(of) < n:
            return hit
        same = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        low, high = starts[same], ends[same + n - 1]
        both, least_square, rest = np.zeros(len(same)), np.zeros(len(same)), (high - low).astype(np.float64)
        for t, chars in zip(times, groups):
            inside = codes == ord(chars[0])
            for c in chars[1:]:
                inside |= codes == ord(c)
            sums = np.concatenate([[0], np.cumsum(inside)])
            y = (sums[high] - sums[low]).astype(np.float64)
            both += t * y
            least_square += np.maximum(y * y / len(chars), y)
            rest -= y
        bound = both / np.sqrt(np.maximum(least_square + rest, 1)) / length
        known: dict[str, bool] = {}
        for i in np.flatnonzero(bound >= least - 0.001):
            k = of[same[i]]
            if not hit[k]:
                run = codes[low[i] : high[i]].tobytes().decode("utf-32-le", "surrogatepass")
                if run not in known:
                    known[run] = close(run)
                hit[k] = known[run]
        return hit

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        out, all_ = np.zeros(len(texts), dtype=bool), [t or "" for t in texts]
        a = size = 0
        for i, t in enumerate(all_):
            size += len(t)
            if size > _CHARS or i == len(all_) - 1:
                out[a : i + 1] = found(all_[a : i + 1])
                a, size = i + 1, 0
        return pd.Series(out)

    return test


def matches(anchor: str, text: Column, mode: str = "normal", least: float = 1.0) -> Column:
    """normal: similar words; regex: a search in lower case; word: equal but for case."""
    if mode == "regex":
        return F.coalesce(F.lower(text).rlike(anchor.lower()), F.lit(False))
    if mode == "word":
        return F.coalesce(F.lower(text) == anchor.lower(), F.lit(False))
    if mode != "normal":
        raise ValueError(f"mode: {mode}")
    return F.coalesce(similar(anchor, text, least), F.lit(False))


def options(anchor: list) -> list[list[str]]:
    """An anchor expression as alternatives of lines: strings are alternatives; a list inside is an anchor of several lines, each a string or a list of alternatives."""
    out: list[list[str]] = []
    for item in anchor:
        if isinstance(item, str):
            out.append([item])
        else:
            out.extend([list(p) for p in product(*[[x] if isinstance(x, str) else list(x) for x in item])])
    return out


def find_anchors(tokens: DataFrame, anchor: list, mode: str = "normal", least: float = 1.0) -> DataFrame:
    """(doc_id, page, ord, box) of the places of an anchor expression: one token for an anchor of one line, or tokens each of which is the nearest below the last and shares its breadth."""
    below = None
    parts = []
    for lines in options(anchor):
        hit = tokens.where(matches(lines[0], F.col("text"), mode, least)).select("doc_id", "page", "ord", F.col("ord").alias("last"), *_BOX)
        for line in lines[1:]:
            if below is None:
                below = regions.nearest(tokens, "bottom").select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), F.col("ord").alias("b_ord"), "near_ord")
            nxt = tokens.where(matches(line, F.col("text"), mode, least)).select(F.col("doc_id").alias("n_doc"), F.col("page").alias("n_page"), F.col("ord").alias("n_ord"), *[F.col(c).alias("n_" + c) for c in _BOX])
            hit = hit.join(below, (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & (F.col("last") == F.col("b_ord")))
            hit = hit.join(nxt, (F.col("doc_id") == F.col("n_doc")) & (F.col("page") == F.col("n_page")) & (F.col("near_ord") == F.col("n_ord"))).select(
                "doc_id", "page", "ord", F.col("n_ord").alias("last"), F.least("x1", "n_x1").alias("x1"), F.least("y1", "n_y1").alias("y1"), F.greatest("x2", "n_x2").alias("x2"), F.greatest("y2", "n_y2").alias("y2"))
        parts.append(hit.drop("last"))
    return reduce(DataFrame.unionByName, parts).distinct()


def document_ends(pages: DataFrame, end: bool) -> DataFrame:
    """(doc_id, page, ord, box): the whole first page of a document, or its last, as an anchor."""
    p = pages.groupBy("doc_id").agg((F.max_by if end else F.min_by)(F.struct("page", "width", "height"), "page").alias("p"))
    return p.select("doc_id", "p.page", F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("double").alias("x1"), F.lit(0).cast("double").alias("y1"), F.col("p.width").cast("double").alias("x2"), F.col("p.height").cast("double").alias("y2"))


def point(label: str, value: str | float, empty: bool = False) -> Column:
    """One coordinate from a side of the anchor's box (left, top, right, bottom): `10px` or 10 further, `20%r` of what is left of the page (of the side itself for a negative share), `20%a` of the page, `2t` text sizes, kept on the page."""
    side = F.col({"left": "x1", "top": "y1", "right": "x2", "bottom": "y2"}[label])
    across = label in ("left", "right")
    whole, size = (F.col("width"), F.col("x2") - F.col("x1")) if across else (F.col("height"), F.col("y2") - F.col("y1"))
    m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)(px|%r|%a|t)?\s*", str(value))
    if not m:
        raise ValueError(f"point: {value}")
    n, unit = float(m[1]), m[2] or "px"
    if unit == "px":
        return side + n
    if unit == "t":
        return F.greatest(F.lit(0.0), F.least(whole, side + size * n))
    if unit == "%a":
        return F.abs(whole * n / 100)
    rest = whole - side if n >= 0 else side
    base = F.when(side == 0, rest).otherwise(side) if empty else rest
    return F.abs(side + base * n / 100)


def corner(points: dict[str, str | float] | None, last: bool = False, empty: bool = False) -> tuple[Column, Column]:
    """The x and y of a definition like {left: 0, bottom: 1t}; none: the box's first corner, or its last one."""
    if not points:
        return (F.col("x2"), F.col("y2")) if last else (F.col("x1"), F.col("y1"))
    x = next((point(k, v, empty) for k, v in points.items() if k in ("left", "right") and v is not None), F.lit(0.0))
    y = next((point(k, v, empty) for k, v in points.items() if k in ("top", "bottom") and v is not None), F.lit(0.0))
    return x, y


def one_anchor_regions(found: DataFrame, pages: DataFrame, first: dict | None, second: dict | None, empty: bool = False) -> DataFrame:
    """(doc_id, page, ord, box): the rectangle of two points of every anchor; without points its own box."""
    a = found.join(pages, ["doc_id", "page"])
    if not first or not second:
        return a.select("doc_id", "page", "ord", *[F.col(c).cast("double").alias(c) for c in _BOX])
    (x, y), (u, v) = corner(first, empty=empty), corner(second, empty=empty)
    a = a.withColumn("c", F.struct(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")))
    return a.select("doc_id", "page", "ord", *[f(F.col(f"c.{p}"), F.col(f"c.{q}")).cast("double").alias(n) for f, p, q, n in (
        (F.least, "x", "u", "x1"), (F.least, "y", "v", "y1"), (F.greatest, "x", "u", "x2"), (F.greatest, "y", "v", "y2"))])


def two_anchor_regions(first: DataFrame, second: DataFrame, pages: DataFrame, points: tuple[dict | None, dict | None] = (None, None)) -> DataFrame:
    """(doc_id, page, from_ord, to_ord, box): from anchors of one kind to those of the other further down, in both directions, boxes once.

    The lowest anchor chooses first and takes the nearest other below it on its page, else the first on a later page; an anchor is
    taken once. A region over pages has one row for each of them: the rest of the first, whole pages, and the start of the last.
    """
    return _one_way(first, second, pages, points).unionByName(_one_way(second, first, pages, points[::-1])).dropDuplicates(["doc_id", "page", *_BOX])


def _one_way(first: DataFrame, second: DataFrame, pages: DataFrame, points: tuple) -> DataFrame:
    def placed(df: DataFrame, p: str, pts: dict | None) -> DataFrame:
        x, y = corner(pts)
        j = df.join(pages, ["doc_id", "page"]).withColumn("c", F.struct(x.alias("x"), y.alias("y")))
        return j.select(F.col("doc_id").alias(p + "doc"), F.col("page").alias(p + "page"), F.col("ord").alias(p + "ord"), F.col("y1").alias(p + "top"), F.col("c.x").alias(p + "x"), F.col("c.y").alias(p + "y"), F.col("width").alias(p + "w"), F.col("height").alias(p + "h"))

    a = placed(first, "a_", points[0]).withColumn("a_rank", F.row_number().over(Window.partitionBy("a_doc").orderBy(F.desc("a_page"), F.desc("a_top"), "a_ord")))
    b = placed(second, "b_", points[1])
    on = (F.col("a_doc") == F.col("b_doc")) & (((F.col("a_page") == F.col("b_page")) & (F.col("a_top") < F.col("b_top"))) | (F.col("a_page") < F.col("b_page")))
    j = a.join(b, on).withColumn("to", F.struct("b_page", "b_ord"))
    got = evaluate.assign(j, ["a_doc"], "a_rank", "to", [F.col("b_page"), F.col("b_top"), F.col("b_ord")])
    m = got.join(a, ["a_doc", "a_rank"]).join(b.withColumnRenamed("b_doc", "doc_id"), (F.col("a_doc") == F.col("doc_id")) & (F.col("to.b_page") == F.col("b_page")) & (F.col("to.b_ord") == F.col("b_ord")))
    m = m.withColumn("page", F.explode(F.sequence("a_page", "b_page")))
    same, begin, end = F.col("a_page") == F.col("b_page"), F.col("page") == F.col("a_page"), F.col("page") == F.col("b_page")
    own = pages.select(F.col("doc_id").alias("p_doc"), F.col("page").alias("p_page"), F.col("width").alias("p_w"), F.col("height").alias("p_h"))
    m = m.join(own, (F.col("doc_id") == F.col("p_doc")) & (F.col("page") == F.col("p_page")))
    zero = F.lit(0.0)
    return m.select("doc_id", "page", F.col("a_ord").alias("from_ord"), F.col("b_ord").alias("to_ord"),
                    F.when(same, F.least("a_x", "b_x")).otherwise(zero).cast("double").alias("x1"),
                    F.when(same, F.least("a_y", "b_y")).when(begin, F.col("a_y")).otherwise(zero).cast("double").alias("y1"),
                    F.when(same, F.greatest("a_x", "b_x")).otherwise(F.col("p_w")).cast("double").alias("x2"),
                    F.when(same, F.greatest("a_y", "b_y")).when(end & ~begin, F.col("b_y")).otherwise(F.col("p_h")).cast("double").alias("y2"))


def pick_occurrences(found: DataFrame, numbers: list[int]) -> DataFrame:
    """The n-th regions (from 1, by page, y and x) of each document; a number below 1 is an error, one that a document lacks gives none."""
    if any(n < 1 for n in numbers):
        raise ValueError(f"occurrences: {numbers}")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y1", "x1", "ord"))
    return found.withColumn("__n", n).where(F.col("__n").isin(*numbers)).drop("__n") if numbers else found


def distinct_boxes(found: DataFrame) -> DataFrame:
    """Regions of other boxes than those before them on the page."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page", *_BOX).orderBy("ord"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n")


def region_text(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, ord, content): the tokens wholly inside each region, by y, x and ord, joined by blanks; empty without any."""
    named = found.select("doc_id", "page", F.col("ord").alias("region_id"), *_BOX)
    inside = regions.tokens_within(tokens, named).join(tokens.select("doc_id", "page", "ord", "text", "y1", "x1"), ["doc_id", "page", "ord"])
    text = inside.groupBy("doc_id", "page", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "ord", "text"))), lambda e: e["text"]), " ").alias("content"))  # a region's tokens
    return named.select("doc_id", "page", "region_id").join(text, ["doc_id", "page", "region_id"], "left").select("doc_id", "page", F.col("region_id").alias("ord"), F.coalesce("content", F.lit("")).alias("content"))


def extract_attributes(tokens: DataFrame, pages: DataFrame, definitions: dict[str, dict]) -> DataFrame:
    """(doc_id, name, page, value): every named definition {anchor, match, least, first, second, occurrences} applied to every document."""
    parts = []
    for name, d in definitions.items():
        found = find_anchors(tokens, d["anchor"], d.get("match", "normal"), d.get("least", 1.0))
        found = pick_occurrences(distinct_boxes(found), d.get("occurrences", []))
        text = region_text(tokens, one_anchor_regions(found, pages, d.get("first"), d.get("second")))
        parts.append(text.select("doc_id", F.lit(name).alias("name"), "page", F.col("content").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def nearest_chain(tokens: DataFrame, side: str, hops: int, threshold: float = 0) -> DataFrame:
    """(doc_id, page, ord, hop, near_ord): from each token to its nearest on a side, from that to the next, up to `hops` times."""
    step = regions.nearest(tokens, side, threshold).select("doc_id", "page", F.col("ord").alias("at"), F.col("near_ord").alias("next"))
    here = step.select("doc_id", "page", F.col("at").alias("ord"), F.lit(1).alias("hop"), F.col("next").alias("near_ord"))
    parts = [here]
    for h in range(2, hops + 1):
        here = here.join(step, (here.doc_id == step.doc_id) & (here.page == step.page) & (here.near_ord == step["at"])).select(here.doc_id, here.page, here.ord, F.lit(h).alias("hop"), F.col("next").alias("near_ord"))
        parts.append(here)
    return reduce(DataFrame.unionByName, parts)


def nearest_field(texts: DataFrame, fields: DataFrame, side: str) -> DataFrame:
    """(doc_id, page, ord, field_id): each text's nearest field box (field_id) on a side of the page, of those that share its extent; side `any`: by the distance of the left edges, then of the top edges."""
    f = fields.select(F.col("doc_id").alias("f_doc"), F.col("page").alias("f_page"), "field_id", *[F.col(c).alias("f_" + c) for c in _BOX])
    on = (F.col("doc_id") == F.col("f_doc")) & (F.col("page") == F.col("f_page"))
    if side == "any":
        key = F.struct(F.abs(F.col("x1") - F.col("f_x1")).alias("a"), F.abs(F.col("y1") - F.col("f_y1")).alias("b"), "field_id")
    else:
        over_y = F.least("y2", "f_y2") > F.greatest("y1", "f_y1")
        over_x = F.least("x2", "f_x2") > F.greatest("x1", "f_x1")
        gap, over = {"right": (F.col("f_x1") - F.col("x2"), over_y), "left": (F.col("x1") - F.col("f_x2"), over_y), "bottom": (F.col("f_y1") - F.col("y2"), over_x), "top": (F.col("y1") - F.col("f_y2"), over_x)}[side]
        on, key = on & over & (gap >= 0), F.struct(gap.alias("a"), "field_id")
    return texts.join(f, on).groupBy("doc_id", "page", "ord").agg(F.min(key).alias("k")).select("doc_id", "page", "ord", "k.field_id")
