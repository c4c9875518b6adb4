"""Order-dependent layout operators: folds inside one page, parallel over pages; tables as grids and their similarity."""

from __future__ import annotations

import difflib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


_COLS = ["doc_id", "page", "ord", "type", "content", "x1", "y1", "x2", "y2"]


def _folded(rows: DataFrame, order: list[Column], linked: Column, start: str, step: str, extra: list[Column] = ()) -> DataFrame:
    """(doc_id, page, state): rows of a page in order, folded into a state by `step` over (s, r), where r.k is a row's number from 1, r.adj the numbers of
    those before it that `linked` (columns of the row as they are, of the one before with b_) holds for, with `extra` columns of the one before.

    Sequential inside a page, so a page is one row here.
    """
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))
    a = rows.withColumn("k", n)
    b = a.select(*[F.col(c).alias("b_" + c) for c in a.columns])
    on = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page")) & (F.col("b_k") < F.col("k")) & linked
    adj = a.join(b, on).groupBy("doc_id", "page", "k").agg(F.array_sort(F.collect_list(F.struct(F.col("b_k").alias("j"), *extra) if extra else F.col("b_k"))).alias("adj"))
    items = a.select("doc_id", "page", "k", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")).join(adj, ["doc_id", "page", "k"], "left")
    kind = dict(adj.dtypes)["adj"]
    page = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("adj", F.array().cast(kind)).alias("adj"), "area"))).alias("rows"))
    return page.select("doc_id", "page", F.expr(f"aggregate(rows, {start}, (s, r) -> {step})").alias("state"))


def _overlap() -> Column:
    return (F.col("x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("x2")) & (F.col("y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("y2"))


def _kept(rows: DataFrame, order: list[Column], state: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))
    alive = state.select("doc_id", "page", F.explode("state").alias("k"))
    return rows.withColumn("k", n).join(alive, ["doc_id", "page", "k"], "left_semi").select(*rows.columns)


_INTS = "CAST(array() AS array<int>)"


def drop_overlaps(segments: DataFrame, by_type: bool = True) -> DataFrame:
    """(doc_id, page, ord, type, content, box) without rows that overlap one accepted before: images first, then tables, then
    the rest, by x1, or in order of ord. A table goes only if an accepted one has the same content."""
    rank = F.when(F.col("type") == "image_text", 0).when(F.col("type") == "table", 1).otherwise(2)
    order = [rank, F.col("x1"), F.col("ord")] if by_type else [F.col("ord")]
    bars = _overlap() & ((F.col("type") != "table") | F.col("content").eqNullSafe(F.col("b_content")))
    rows = segments.select(*_COLS)
    return _kept(rows, order, _folded(rows, order, bars, _INTS, "if(arrays_overlap(r.adj, s), s, concat(s, array(r.k)))"))


def prefer_larger(segments: DataFrame, max_height: float = 1500) -> DataFrame:
    """Segments in order, each of which takes the place of those that it overlaps if it is larger than every one of them, and else goes; too high ones go."""
    rows = segments.select(*_COLS).where(F.col("y2") - F.col("y1") < max_height)
    order = [F.col("ord")]
    area = ((F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1"))).alias("area")
    step = "transform(array(filter(r.adj, x -> array_contains(s, x.j))), o -> CASE WHEN size(o) = 0 THEN concat(s, array(r.k)) WHEN forall(o, x -> r.area > x.area) THEN concat(array_except(s, transform(o, x -> x.j)), array(r.k)) ELSE s END)[0]"
    return _kept(rows, order, _folded(rows, order, _overlap(), _INTS, step, [area]))


def _grouped(rows: DataFrame, order: list[Column], state: DataFrame, name: str) -> DataFrame:
    """Rows with the number from 0 of the group that the fold put them into."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))
    of = state.select("doc_id", "page", F.posexplode("state").alias("p", name)).withColumn("k", F.col("p") + 1).drop("p")
    return rows.withColumn("k", n).join(of, ["doc_id", "page", "k"])


def merge_adjacent(segments: DataFrame, vertical_gap: float = 0, horizontal_gap: float = 0, length_ratio: float = 1.7) -> DataFrame:
    """(doc_id, page, grp, type, n, content, box): by y1 and x1, a segment joins the first group with a box of its page that is of its type or long enough
    (its length at most length_ratio times the box's) and stands next to it within the gaps or overlaps it; tables and images start groups of their own.
    Texts are joined by line breaks, the box is the one around all, the type the first one's."""
    rows, order = segments.select(*_COLS), [F.col("y1"), F.col("x1"), F.col("ord")]
    across = F.greatest("x1", "b_x1") <= F.least("x2", "b_x2")
    middle = F.abs((F.col("b_x1") + F.col("b_x2")) / 2 - (F.col("x1") + F.col("x2")) / 2) <= 0.5 * (F.col("b_x2") - F.col("b_x1"))
    upright = (F.abs(F.col("b_y2") - F.col("y1")) <= vertical_gap) & (across | middle)
    level = (F.abs(F.col("b_x2") - F.col("x1")) <= horizontal_gap) & (F.greatest("y1", "b_y1") <= F.least("y2", "b_y2"))
    alike = (F.col("type") == F.col("b_type")) | (F.col("x2") - F.col("x1") <= length_ratio * (F.col("b_x2") - F.col("b_x1")))
    linked = ~F.col("type").isin("table", "image_text") & alike & (upright | level | _overlap())
    state = _folded(rows, order, linked, _INTS, "concat(s, array(coalesce(array_min(transform(r.adj, j -> s[j - 1])), coalesce(array_max(s) + 1, 0))))")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda e: e["content"]), "\n")  # a page's group
    return _grouped(rows, order, state, "grp").groupBy("doc_id", "page", F.col("grp").cast("long").alias("grp")).agg(
        F.min_by("type", "k").alias("type"), F.count("*").alias("n"), text.alias("content"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def phrases(words: DataFrame, max_space: float = 1.5, diagonal: bool = False) -> DataFrame:
    """(doc_id, page, phrase, content, box) of words (doc_id, page, ord, content, box): by x (or x + y), a word joins the first chain whose end is at most max_space
    heights to its left and whose band holds its middle line."""
    rows = words.select("doc_id", "page", "ord", F.lit("word").alias("type"), "content", "x1", "y1", "x2", "y2")
    order = [F.col("x1") + F.col("y1"), F.col("x1"), F.col("ord")] if diagonal else [F.col("x1"), F.col("y1"), F.col("ord")]
    gap, mid = F.col("x1") - F.col("b_x2"), (F.col("y1") + F.col("y2")) / 2
    linked = (gap > 0) & (gap <= max_space * (F.col("y2") - F.col("y1"))) & (F.col("b_y1") <= mid) & (mid <= F.col("b_y2"))
    # s.ends has the last word of every chain, s.of the chain of every word
    place = "coalesce(get(filter(transform(s.ends, (e, i) -> if(array_contains(r.adj, e), i, -1)), i -> i >= 0), 0), size(s.ends))"
    step = f"transform(array({place}), c -> named_struct('ends', if(c = size(s.ends), concat(s.ends, array(r.k)), transform(s.ends, (e, i) -> if(i = c, r.k, e))), 'of', concat(s.of, array(c))))[0]"
    state = _folded(rows, order, linked, f"named_struct('ends', {_INTS}, 'of', {_INTS})", step).select("doc_id", "page", F.col("state.of").alias("state"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda e: e["content"]), " ")  # a page's chain
    return _grouped(rows, order, state, "phrase").groupBy("doc_id", "page", F.col("phrase").cast("long").alias("phrase")).agg(
        text.alias("content"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def lcs_similarity(a, b) -> float:
    """Twice the matching characters over both lengths; 1 for two empty strings, 0 if either is no string."""
    if not isinstance(a, str) or not isinstance(b, str):
        return 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


def box_reward(a, b) -> float:
    """Intersection over union of two boxes; 0 for boxes without area."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def _alignment(reward: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The best total reward over two increasing sequences, and the pairs it comes from; of equal ways a pair goes first, then leaving out on the left."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        for j in range(m):
            best[i + 1, j + 1] = max(best[i, j] + reward[i, j], best[i, j + 1], best[i + 1, j])
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + reward[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return float(best[n, m]), pairs[::-1]


def _f(hits: float, predicted: int, true: int) -> tuple[float, float, float]:
    p, r = hits / predicted if predicted else 1.0, hits / true if true else 1.0
    return (2 * p * r / (p + r) if p + r else 0.0), p, r


#: Strings beyond this length are compared one by one, shorter ones by blocks.
_SHORT = 255
_PAD, _NONE = 0xFFFF, 0xFFFE


class _Strings:
    """Distinct strings that others are compared with: codes of their characters, a column for each string, in groups of like lengths."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        letters = sorted(set().union(*texts)) if texts else []
        self.code = {c: i for i, c in enumerate(letters)}
        self.whole = len(letters) >= _NONE
        self.groups, self.long = [], [i for i, t in enumerate(texts) if len(t) > _SHORT or self.whole]
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= _SHORT] if not self.whole else []
        for width in sorted({-(-len(texts[i]) // 8) * 8 for i in short}):
            of = np.array([i for i in short if width - 8 < len(texts[i]) <= width])
            for part in np.split(of, range(4096, len(of), 4096)):  # so many columns at a time
                codes = np.full((width, len(part)), _PAD, dtype=np.uint16)
                for column, i in enumerate(part):
                    codes[: len(texts[i]), column] = [self.code[c] for c in texts[i]]
                self.groups.append((part, codes))

    def matching(self, a: str) -> np.ndarray:
        """difflib's number of matching characters of a and each string: the longest common block, the first in a and then in the string, and what matches on both sides of it."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        one_by_one = range(len(self.texts)) if len(a) > _SHORT else self.long
        for i in one_by_one:
            out[i] = sum(x.size for x in difflib.SequenceMatcher(None, a, self.texts[i], autojunk=False).get_matching_blocks())
        if a and len(a) <= _SHORT:
            codes = np.array([self.code.get(c, _NONE) for c in a] + [_NONE], dtype=np.uint16)
            for part, theirs in self.groups:
                out[part] = _block_matches(codes, theirs, self.lengths[part])
        return out


def _block_matches(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Matching characters of one string (codes and a last one that fits nothing) and of each column of b. Every round looks at all ranges that are left, of any column."""
    total = np.zeros(b.shape[1], dtype=np.int64)
    column, sub = np.arange(b.shape[1]), b
    a_low, b_low = np.zeros(len(column), dtype=np.int64), np.zeros(len(column), dtype=np.int64)
    a_high, b_high = np.full(len(column), len(a) - 1), lengths
    while len(column):
        width, depth = sub.shape[0], int((a_high - a_low).max())
        run, best = np.zeros(sub.shape, dtype=np.uint8), np.zeros(sub.shape, dtype=np.uint16)
        first = a_low.max() == 0 and (a_high == len(a) - 1).all()
        for i in range(depth):
            here = a[i] if first else a[np.where(a_low + i < a_high, a_low + i, len(a) - 1)]
            if first and here == _NONE:
                run[:] = 0
                continue
            after = np.empty_like(run)
            after[0] = 1
            np.add(run[:-1], 1, out=after[1:])
            after *= sub == here
            run = after
            np.maximum(best, (run.astype(np.uint16) << 8) | np.uint16(255 - i), out=best)  # longest, then first in a
        key = ((best.astype(np.uint32) << 8) | (255 - np.arange(width, dtype=np.uint32))[:, None]).max(axis=0).astype(np.int64)  # then first in b
        size = key >> 16
        total += np.bincount(column, weights=size, minlength=len(total)).astype(np.int64)
        i, j = a_low + 256 - ((key >> 8) & 255) - size, b_low + 256 - (key & 255) - size
        left, right = (size > 0) & (i > a_low) & (j > b_low), (size > 0) & (i + size < a_high) & (j + size < b_high)
        column, a_low, a_high, b_low, b_high = (np.concatenate([x[left], y[right]]) for x, y in (
            (column, column), (a_low, i + size), (i, a_high), (b_low, j + size), (j, b_high)))
        if len(column):
            at = b_low + np.arange(int((b_high - b_low).max()))[:, None]
            sub = np.where(at < b_high, b[np.minimum(at, len(b) - 1), column], np.uint16(_PAD))
    return total


def _lcs_rewards(found: list):
    texts = sorted({x for x in found if isinstance(x, str)})
    place = {t: i for i, t in enumerate(texts)}
    strings, of = _Strings(texts), np.array([place[x] if isinstance(x, str) else -1 for x in found])

    def scores(a) -> np.ndarray:
        if not isinstance(a, str) or not texts:
            return np.zeros(len(found))
        both = len(a) + strings.lengths
        ratio = np.where(both > 0, 2.0 * strings.matching(a) / np.maximum(both, 1), 1.0)
        return np.where(of >= 0, ratio[of], 0.0)

    return scores


def _box_rewards(found: list):
    boxes, of = np.unique(np.array(found, dtype=np.float64).reshape(-1, 4), axis=0, return_inverse=True)
    low, high, area = boxes[:, :2], boxes[:, 2:], (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])

    def scores(a) -> np.ndarray:
        a = np.array(a, dtype=np.float64)
        side = np.maximum(np.minimum(a[2:], high) - np.maximum(a[:2], low), 0)
        both = side[:, 0] * side[:, 1]
        union = (a[2] - a[0]) * (a[3] - a[1]) + area - both
        return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)[of.reshape(-1)]

    return scores


def _advance(before: np.ndarray, reward: np.ndarray) -> np.ndarray:
    """The next row of best totals of an alignment (or of many, on the last axis) after `before`."""
    after = np.zeros_like(before)
    np.maximum(before[..., 1:], before[..., :-1] + reward, out=after[..., 1:])
    return np.maximum.accumulate(after, axis=-1)


def grid_similarity(truth: list[list], found: list[list], reward=lcs_similarity) -> tuple[float, float, float, float]:
    """(F, precision, recall, upper bound of F) of the most similar substructures of two cell grids.

    Rows and columns are aligned one after the other; the score is that of the cells where aligned rows and columns meet. Every
    cell meets every other, a row of truth at a time: what is kept is a byte for each two rows, and a row of totals for each two columns.
    """
    n, m = sum(map(len, truth)), sum(map(len, found))
    if not n or not m:
        return (*_f(0.0, m, n), _f(0.0, m, n)[0])
    theirs = [y for row in found for y in row]
    make = {lcs_similarity: _lcs_rewards, box_reward: _box_rewards}.get(reward)
    scores = make(theirs) if make else lambda x: np.array([reward(x, y) for y in theirs], dtype=np.float64)
    wide, other = len(truth[0]), len(found[0])
    best, totals = np.zeros(len(found) + 1), np.zeros((wide, other, len(found) + 1))
    way = np.empty((len(truth), len(found)), dtype=np.uint8)
    kept: dict = {}
    for i, row in enumerate(truth):
        cells = np.empty((wide, other, len(found)))
        for j, x in enumerate(row):
            key = x if isinstance(x, str) else tuple(x) if isinstance(x, (list, np.ndarray)) else None
            got = kept.get(key) if key is not None else None
            if got is None:
                got = scores(x).reshape(len(found), other).T
                if key is not None and len(kept) < 16:
                    kept[key] = got
            cells[j] = got
        pair = np.zeros((other + 1, len(found)))
        for j in range(wide):  # cells of this row and of each found one, aligned
            after = np.zeros_like(pair)
            for q in range(other):
                after[q + 1] = np.maximum(np.maximum(pair[q] + cells[j, q], pair[q + 1]), after[q])
            pair = after
        after = _advance(best, pair[other])
        way[i] = np.where(after[1:] == best[:-1] + pair[other], 0, np.where(after[1:] == best[1:], 1, 2))
        best, totals = after, _advance(totals, cells)
    rows, i, k = [], len(truth), len(found)
    while i and k:
        step = way[i - 1, k - 1]
        i, k = i - (step < 2), k - (step != 1)
        if step == 0:
            rows.append((i, k))
    by_columns, columns = _alignment(totals[:, :, -1])
    total = 0.0
    for i, k in rows[::-1]:
        for j, q in columns:
            total += float(reward(truth[i][j], found[k][q]))
    return (*_f(total, m, n), _f(min(float(best[-1]), by_columns), m, n)[0])


def span_grids(cells: list[tuple]) -> tuple[list[list[str]], list[list[list[int]]]]:
    """Grids of texts and of relative spans from (row, row_span, column, column_span, text, ...) of a table's cells; empty places are single cells without text."""
    rows = max((c[0] + c[1] for c in cells), default=0)
    columns = max((c[2] + c[3] for c in cells), default=0)
    text = [[""] * columns for _ in range(rows)]
    span = [[[0, 0, 1, 1] for _ in range(columns)] for _ in range(rows)]
    for r, rs, c, cs, t, *_ in cells:
        for i in range(r, r + rs):
            for j in range(c, c + cs):
                text[i][j], span[i][j] = t, [c - j, r - i, c - j + cs, r - i + rs]
    return text, span


_SCORES = ["f", "precision", "recall", "upper"]


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs one by one to all tasks: a few rows may be hours of work, which would else be one small partition."""
    return pairs.select("pair_id", "truth", "found").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def grid_scores(pairs: DataFrame, kind: str = "con") -> DataFrame:
    """(pair_id, truth, found) -> (pair_id, f, precision, recall, upper). Grids are arrays of rows; cells are strings for con, and boxes or relative spans (arrays of four numbers) for loc and top."""
    reward = {"con": lcs_similarity, "top": box_reward, "loc": box_reward}[kind]

    def run(batches):
        for pdf in batches:
            rows = [(i, *(round(x, 6) for x in grid_similarity([list(r) for r in t], [list(r) for r in f], reward))) for i, t, f in zip(pdf["pair_id"], pdf["truth"], pdf["found"])]
            yield pd.DataFrame(rows, columns=["pair_id", *_SCORES])

    return _dealt(pairs).mapInPandas(run, "pair_id long, f double, precision double, recall double, upper double")


def table_scores(pairs: DataFrame) -> DataFrame:
    """(pair_id, truth, found) with tables as HTML -> (pair_id, top_f, top_precision, top_recall, top_upper, con_...): structure by relative spans, and text."""
    names = [f"{k}_{c}" for k in ("top", "con") for c in _SCORES]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t, f in zip(pdf["pair_id"], pdf["truth"], pdf["found"]):
                (tt, ts), (ft, fs) = span_grids(html_cells(t)), span_grids(html_cells(f))
                rows.append((i, *(round(x, 6) for x in (*grid_similarity(ts, fs, box_reward), *grid_similarity(tt, ft)))))
            yield pd.DataFrame(rows, columns=["pair_id", *names])

    return _dealt(pairs).mapInPandas(run, "pair_id long, " + ", ".join(f"{n} double" for n in names))


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.cells: list[tuple] = []
        self.row, self.taken, self.cell = -1, set(), None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            col = 0
            while (self.row, col) in self.taken:
                col += 1
            rs, cs = int(a.get("rowspan") or 1), int(a.get("colspan") or 1)
            self.taken.update((self.row + i, col + j) for i in range(rs) for j in range(cs))
            self.cell = [max(self.row, 0), rs, col, cs, "", tag == "th"]

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[4] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.cells.append((*self.cell[:4], self.cell[4].strip(), self.cell[5]))
            self.cell = None


def html_cells(html: str | None) -> list[tuple]:
    """(row, row_span, column, column_span, text, is_header) of the cells of a table."""
    p = _Table()
    p.feed(html or "")
    return p.cells


def table_cells(tables: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row for each cell of each HTML table; no markup gives no row."""
    def run(batches):
        for pdf in batches:
            rows = [(i, *c) for i, h in zip(pdf["id"], pdf["html"]) for c in html_cells(h)]
            yield pd.DataFrame(rows, columns=["id", "row_index", "row_span", "column_index", "column_span", "text", "is_header"])

    return tables.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(
        run, "id long, row_index long, row_span long, column_index long, column_span long, text string, is_header boolean")
