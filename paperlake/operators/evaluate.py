"""Evaluation of detections and answers: matching, confusion, reports, votes."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from paperlake.functions import bbox
from paperlake.sources.shared import text_batches

FULL, PARTIAL = 80.0, 70.0
#: Pairs of boxes that are compared at a time.
_PAIRS = 1 << 18


def _each_model(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows once for each model that has detections: the size of what a report on all models is."""
    models = found.where("model IS NOT NULL").agg(F.array_sort(F.collect_set("model")).alias("models")).withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(models), "one").withColumn("model", F.explode("models")).drop("one", "models")


def overlap_pairs(truth: DataFrame, found: DataFrame, decimals: int = 2) -> DataFrame:
    """(image, model, truth_id, det_id, overlap): every two boxes of an image that overlap, with intersection over union in percent.

    truth (image, truth_id, box), found (image, model, det_id, box).
    """
    t = truth.select("image", "truth_id", *[F.col(c).alias("t_" + c) for c in ("x1", "y1", "x2", "y2")])
    d = found.select(F.col("image").alias("d_image"), "model", "det_id", *[F.col(c).alias("d_" + c) for c in ("x1", "y1", "x2", "y2")])
    a, b = bbox.box("t_"), bbox.box("d_")
    return t.join(d, (F.col("image") == F.col("d_image")) & bbox.overlaps(a, b)).select("image", "model", "truth_id", "det_id", bbox.iou_pct(a, b, decimals).alias("overlap"))


def assign(pairs: DataFrame, group: list[str], left: str, right: str, rank: list[Column], carry: list[str] = ()) -> DataFrame:
    """(group, left, right, carry): in the order of `left`, each takes the first of its candidates by rank that none before it took.

    Sequential inside a group (an image and model, say), so a group is one row here; its size is that of a page.
    """
    c = pairs.groupBy(*group, left).agg(F.array_sort(F.collect_list(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(right).alias("to"), *carry))).alias("c"))
    g = c.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(left).alias("of"), "c"))).alias("rows"))
    kinds = dict(pairs.dtypes)
    out = "".join(f", {x}: {kinds[x]}" for x in carry)
    fold = (
        f"aggregate(rows, named_struct('used', CAST(array() AS array<{kinds[right]}>), 'out', CAST(array() AS array<struct<of: {kinds[left]}, to: {kinds[right]}{out}>>)), "
        "(s, r) -> transform(array(filter(r.c, x -> NOT array_contains(s.used, x.to))), f -> if(size(f) = 0, s, named_struct("
        f"'used', concat(s.used, array(f[0].to)), 'out', concat(s.out, array(named_struct('of', r.of, 'to', f[0].to{''.join(f", '{x}', f[0].{x}" for x in carry)}))))))[0], s -> s.out)"
    )
    return g.select(*group, F.explode(F.expr(fold)).alias("m")).select(*group, F.col("m.of").alias(left), F.col("m.to").alias(right), *[f"m.{x}" for x in carry])


def greedy_matches(truth: DataFrame, found: DataFrame, decimals: int = 2) -> DataFrame:
    """(image, model, truth_id, det_id, overlap): in truth order, each truth takes its best overlapping detection that is left; ties go to the first detection."""
    pairs = overlap_pairs(truth, found, decimals).where("overlap > 0")
    return assign(pairs, ["image", "model"], "truth_id", "det_id", [-F.col("overlap"), F.col("det_id")], ["overlap"])


def with_unmatched(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with status match-found; other truth takes the image's unmatched detections in order (best-guess), or is entity-not-extracted."""
    asked = _each_model(truth.select("image", "truth_id"), found)
    rest = asked.join(matches.select("image", "model", "truth_id"), ["image", "model", "truth_id"], "left_anti")
    free = found.select("image", "model", "det_id").join(matches.select("image", "model", "det_id"), ["image", "model", "det_id"], "left_anti")
    a = rest.withColumn("n", F.row_number().over(Window.partitionBy("image", "model").orderBy("truth_id")))
    b = free.withColumn("n", F.row_number().over(Window.partitionBy("image", "model").orderBy("det_id")))
    guessed = a.join(b, ["image", "model", "n"], "left").select(
        "image", "model", "truth_id", "det_id", F.lit(None).cast("double").alias("overlap"), F.when(F.col("det_id").isNull(), "entity-not-extracted").otherwise("match-not-found").alias("status"))
    return matches.withColumn("status", F.lit("match-found")).unionByName(guessed)


def outcome(truth: DataFrame, found: DataFrame, decimals: int = 2) -> DataFrame:
    """with_unmatched of greedy_matches, in one pass: an image's boxes, the size of a page, are one row and are matched where they are."""
    sides = ["x1", "y1", "x2", "y2"]

    def numbers(df: DataFrame) -> list[Column]:
        return [F.col(c).cast("long" if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") else "double").alias(c) for c in sides]

    t = truth.select("image", F.struct("truth_id", *numbers(truth)).alias("t"))
    d = found.where("image IS NOT NULL").select("image", F.struct("model", "det_id", *numbers(found)).alias("d"))
    pages = t.unionByName(d, allowMissingColumns=True).groupBy("image").agg(F.sort_array(F.collect_list("t")).alias("truths"), F.sort_array(F.collect_list("d")).alias("founds")).where("size(truths) > 0")
    kind = StructType.fromDDL("image int, truths int, founds int, got array<struct<t: int, d: int, m: int, overlap: double>>")
    schema = StructType([*pages.schema.fields, kind["got"]])
    text_batches(truth.sparkSession)  # a batch is what a task's Python holds
    met = pages.mapInArrow(lambda batches: (_match_pages(b, decimals) for b in batches), schema)
    models = found.where("model IS NOT NULL").agg(F.array_sort(F.collect_set("model")).alias("models")).withColumn("one", F.lit(1))
    met = met.withColumn("one", F.lit(1)).join(F.broadcast(models), "one")

    def row(model: Column, of: Column, to: Column, overlap: Column, status: Column) -> Column:
        return F.struct(model.alias("model"), of.alias("truth_id"), to.alias("det_id"), overlap.alias("overlap"), status.alias("status"))

    kinds, none = dict(found.dtypes), F.lit(None)
    mine = F.transform("got", lambda g: row(
        F.get("founds", g["m"])["model"], F.get("truths", g["t"])["truth_id"], F.get("founds", g["d"])["det_id"], g["overlap"],
        F.when(g["overlap"].isNotNull(), "match-found").when(g["d"].isNotNull(), "match-not-found").otherwise("entity-not-extracted")))
    absent = F.flatten(F.transform(F.array_except("models", F.transform("founds", lambda x: x["model"])), lambda m: F.transform("truths", lambda x: row(
        m, x["truth_id"], none.cast(kinds["det_id"]), none.cast("double"), F.lit("entity-not-extracted")))))
    return met.select("image", F.explode_outer(F.concat(mine, absent)).alias("r")).where("r IS NOT NULL").select("image", "r.model", "r.truth_id", "r.det_id", "r.overlap", "r.status")


def _codes(starts: np.ndarray, *ids: pa.Array) -> np.ndarray:
    """Numbers of runs of equal ids; each list's start begins a run."""
    new = np.zeros(len(ids[0]) if ids else 0, dtype=bool)
    for a in ids:
        x, y = a[1:], a[:-1]
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    new[starts[starts < len(new)]] = True
    return np.cumsum(new) - 1


def _half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    """Rounded as Spark does: the number's shortest decimals, half up. x is positive."""
    scaled = x * 10.0**decimals
    out = np.floor(scaled + 0.5) / 10.0**decimals
    for i in np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], first: np.ndarray, last: np.ndarray, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, overlap) of the boxes that overlap, where row i of a meets the rows first[i] to last[i] of b."""
    until, out, i = np.cumsum(last - first), [], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + _PAIRS, side="right")))
        n = (last - first)[i:j]
        r = np.repeat(np.arange(i, j), n)
        s = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + first[r]
        near = (a[0][r] < b[2][s]) & (b[0][s] < a[2][r]) & (a[1][r] < b[3][s]) & (b[1][s] < a[3][r])
        out.append((r[near], s[near]))
        i = j
    r, s = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in (0, 1))
    (l, u, w, h), (p, q, v, z) = [x[r] for x in a], [x[s] for x in b]
    inter = np.maximum(0, np.minimum(w, v) - np.maximum(l, p)) * np.maximum(0, np.minimum(h, z) - np.maximum(u, q))
    union = np.maximum(0, w - l) * np.maximum(0, h - u) + np.maximum(0, v - p) * np.maximum(0, z - q) - inter
    ok = union > 0
    overlap = _half_up(100.0 * inter[ok] / union[ok], decimals)
    some = overlap > 0
    return r[ok][some], s[ok][some], overlap[some]


def _match_pages(batch: pa.RecordBatch, decimals: int) -> pa.RecordBatch:
    """Rows (image, truths, founds) with `got`: of each truth and model of the image, the places of truth and detection (null: none), one place of the model, and the overlap of a match."""
    lists = [batch.column(n) for n in ("truths", "founds")]
    (t, t_at), (d, d_at) = [(x.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)) for x in lists]
    (ta, da) = [[x.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")] for x in (t, d)]
    image = np.repeat(np.arange(len(t_at) - 1), np.diff(t_at))
    tc, model, dc = _codes(t_at, t.field("truth_id")), _codes(d_at, d.field("model")), _codes(d_at, d.field("model"), d.field("det_id"))
    r, s, overlap = _overlaps(ta, da, d_at[image], d_at[image + 1], decimals)
    order = np.lexsort((dc[s], -overlap, tc[r], model[s]))
    r, s, overlap = r[order], s[order], overlap[order]
    matched, used = {}, set()
    for key, x, i, j, o in zip(zip(tc[r].tolist(), model[s].tolist()), dc[s].tolist(), r.tolist(), s.tolist(), overlap.tolist()):
        if key not in matched and x not in used:
            used.add(x)
            matched[key] = (i, j, o)
    begins = np.nonzero(np.diff(model, prepend=-1))[0]
    ends = np.append(begins[1:], len(model)) if len(begins) else begins
    named = d.field("model").is_valid().to_numpy(zero_copy_only=False)
    tl, dl, at, rows, sizes = tc.tolist(), dc.tolist(), 0, [], []
    for i in range(len(t_at) - 1):
        have = len(rows)
        t0, t1, d0 = int(t_at[i]), int(t_at[i + 1]), int(d_at[i])
        while at < len(begins) and begins[at] < d_at[i + 1]:
            a, b = int(begins[at]), int(ends[at])
            free = (j for j in range(a, b) if dl[j] not in used)
            last = None
            for k in range(t0, t1):
                got = matched.get((tl[k], at))
                if got is None:
                    if named[a]:
                        j = next(free, None)
                        rows.append((k - t0, None if j is None else j - d0, a - d0, None))
                elif last != tl[k]:
                    rows.append((got[0] - t0, got[1] - d0, a - d0, got[2]))
                last = tl[k]
            at += 1
        sizes.append(len(rows) - have)
    cells = list(zip(*rows)) or [(), (), (), ()]
    kinds = [("t", pa.int32()), ("d", pa.int32()), ("m", pa.int32()), ("overlap", pa.float64())]
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cells, kinds)], names=[n for n, _ in kinds])
    got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
    return pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "got"])


def confusion(outcome: DataFrame, by: list[str]) -> DataFrame:
    """Per group: tp, fp, fn, precision, recall and accuracy (0 without a denominator); a match counts from FULL percent."""
    hit = (F.col("status") == "match-found") & (F.col("overlap") >= FULL)
    miss = F.col("status") == "entity-not-extracted"
    g = outcome.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(~hit & ~miss).alias("fp"), F.count_if(miss).alias("fn"), F.countDistinct("image").alias("images"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*by, "images", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp + fn).alias("accuracy"))


def average_overlap(outcome: DataFrame, by: list[str]) -> DataFrame:
    """Mean overlap of full, partial and low matches in each group."""
    o = F.col("overlap")
    return outcome.where("overlap IS NOT NULL").groupBy(*by).agg(
        F.round(F.avg(F.when(o >= FULL, o)), 6).alias("full"), F.round(F.avg(F.when((o >= PARTIAL) & (o < FULL), o)), 6).alias("partial"), F.round(F.avg(F.when(o < PARTIAL, o)), 6).alias("low"))


def class_report(rows: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Per class: total, valid (neither null nor -1), hits, mean over all rows, precision (0 when nothing valid) and recall."""
    v = F.col(value)
    g = rows.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(v.isNotNull() & (v != -1)).alias("valid"), F.count_if(v >= threshold).alias("hits"),
        F.round(F.sum(F.when(v != -1, v)) / F.count("*"), 6).alias("mean"))
    return g.select("*", F.when(F.col("valid") > 0, F.round(F.col("hits") / F.col("valid"), 6)).otherwise(F.lit(0.0)).alias("precision"), F.round(F.col("hits") / F.col("total"), 6).alias("recall"))


def model_stats(truth: DataFrame, found: DataFrame, outcome: DataFrame) -> DataFrame:
    """Per model: extracted, truth, matched, unmatched, modified (best guesses), added (not extracted) and final counts."""
    d = found.groupBy("model").agg(F.count("*").alias("extracted"))
    o = outcome.groupBy("model").agg(
        F.count("*").alias("truth"), F.count_if(F.col("status") == "match-found").alias("matched"), F.count_if(F.col("status") != "match-found").alias("unmatched"),
        F.count_if(F.col("status") == "match-not-found").alias("modified"), F.count_if(F.col("status") == "entity-not-extracted").alias("added"))
    return d.join(o, "model", "left").select(
        "model", "extracted", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "matched", "unmatched", "modified", "added")], (F.col("extracted") + F.coalesce("added", F.lit(0))).alias("final"))


def combined_report(rows: DataFrame, key: str, overlap: str, row_accuracy: str, column_accuracy: str, full: float = FULL, exact: float = 90.0) -> DataFrame:
    """Per class: tables, and for detection, rows and columns: mean over all tables, recognised, hits, others, precision and recall; and tables without data."""
    parts = [("td", overlap, full), ("row", row_accuracy, exact), ("col", column_accuracy, exact)]
    g = rows.groupBy(key).agg(F.count("*").alias("tables"), *[x for p, c, t in parts for x in (
        F.round(F.sum(F.when(F.col(c) != -1, F.col(c))) / F.count("*"), 6).alias(f"{p}_mean"),
        F.count_if(F.col(c).isNotNull() & (F.col(c) != -1)).alias(f"{p}_found"), F.count_if(F.col(c) >= t).alias(f"{p}_hits"))])
    out = [F.col(key), F.col("tables")]
    for p, _, _ in parts:
        n, h = F.col(f"{p}_found"), F.col(f"{p}_hits")
        out += [F.col(f"{p}_mean"), n, h, (n - h).alias(f"{p}_others"), F.when(n > 0, F.round(h / n, 6)).otherwise(F.lit(0.0)).alias(f"{p}_precision"), F.round(h / F.col("tables"), 6).alias(f"{p}_recall")]
    return g.select(*out, (F.col("tables") - F.col("td_found")).alias("no_data"))


def mean_report(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per class: rows, and each value's sum over all rows, those without it included."""
    return rows.groupBy(key).agg(F.count("*").alias("tables"), *[F.round(F.coalesce(F.sum(v), F.lit(0.0)) / F.count("*"), 6).alias(v) for v in values])


def merge_results(left: DataFrame, right: DataFrame, band: int = 500) -> DataFrame:
    """Structure records joined with detection records of their image whose x1 and y1 lie within `band`: the first such, and of each column the left value if there is one.

    Both have (image, rec_id, box) and further columns; of records of one box the last counts, at the place of the first.
    """
    def one(df: DataFrame, prefix: str) -> DataFrame:
        keep = [c for c in df.columns if c not in ("image", "rec_id", "x1", "y1", "x2", "y2")]
        g = df.groupBy("image", "x1", "y1", "x2", "y2").agg(F.min("rec_id").alias("rec_id"), F.max_by(F.struct("rec_id", *keep), "rec_id").alias("last"))
        return g.select(F.col("image").alias(prefix + "image"), *[F.col(c).alias(prefix + c) for c in ("x1", "y1", "x2", "y2", "rec_id")], *[F.col(f"last.{c}").alias(prefix + c) for c in keep])

    def tile(c: str) -> Column:
        return F.floor(F.col(c) / band).cast("long")

    def around(c: str) -> Column:
        return F.explode(F.sequence(tile(c) - 1, tile(c) + 1))

    a, b = one(left, "a_"), one(right, "b_").withColumn("tx", around("b_x1")).withColumn("ty", around("b_y1"))
    near = (F.abs(F.col("a_x1") - F.col("b_x1")) <= band) & (F.abs(F.col("a_y1") - F.col("b_y1")) <= band)
    j = a.join(b, (F.col("a_image") == F.col("b_image")) & (tile("a_x1") == F.col("tx")) & (tile("a_y1") == F.col("ty")) & near).drop("tx", "ty")
    first = j.groupBy(*a.columns).agg(F.min_by(F.struct(*[c for c in j.columns if c.startswith("b_")]), "b_rec_id").alias("m"))
    have = {c[2:] for c in b.columns if c.startswith("b_")}
    mine = [c[2:] for c in a.columns]
    return first.select(*[F.coalesce(F.col("a_" + c), F.col("m.b_" + c)).alias(c) if c in have else F.col("a_" + c).alias(c) for c in mine], *[F.col("m.b_" + c).alias(c) for c in sorted(have) if c not in mine])


def report_rows(truth: DataFrame, metrics: DataFrame, band: int = 80) -> DataFrame:
    """(image, truth_id, met_id): in truth order, each truth takes its image's first metrics row that is left, has no box or a y1 within `band`, and is no match-not-found.

    A row without a box stays in its image. Truth without a row has a null one.
    """
    m = metrics.where("status IS NULL OR status <> 'match-not-found'").select(F.col("image").alias("m_image"), "met_id", F.col("y1").alias("m_y1"))
    pairs = truth.join(m, (F.col("image") == F.col("m_image")) & (F.col("m_y1").isNull() | (F.abs(F.col("y1") - F.col("m_y1")) <= band))).select("image", "truth_id", "met_id")
    got = assign(pairs, ["image"], "truth_id", "met_id", [F.col("met_id")])
    return truth.select("image", "truth_id").join(got, ["image", "truth_id"], "left")


def name_tables(truth: DataFrame) -> DataFrame:
    """Truth rows with table_name `table_A_x1_y1_x2_y2`: letters by order in the image."""
    n = F.row_number().over(Window.partitionBy("image").orderBy("truth_id"))
    return truth.withColumn("table_name", F.concat(F.lit("table_"), F.char(F.lit(64) + n), *[x for c in ("x1", "y1", "x2", "y2") for x in (F.lit("_"), F.col(c).cast("string"))]))


def class_filter(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows whose every named class column has one of its wanted values."""
    out = rows
    for c, values in wanted.items():
        out = out.where(F.col(c).isin(*values))
    return out


def band_match(truth: DataFrame, records: DataFrame, band: int = 500, corners: bool = True) -> DataFrame:
    """Each record's first truth (by id) of the same image whose coordinates lie within `band`; records (image, rec_id, box).

    Boxes are joined on tiles of `band` units, so only near ones meet.
    """
    def tile(c: Column) -> Column:
        return F.floor(c / band).cast("long")

    t = truth.select(F.col("image").alias("t_image"), "truth_id", *[F.col(c).alias("t_" + c) for c in ("x1", "y1", "x2", "y2")])
    t = t.withColumn("tx", F.explode(F.sequence(tile(F.col("t_x1")) - 1, tile(F.col("t_x1")) + 1))).withColumn("ty", F.explode(F.sequence(tile(F.col("t_y1")) - 1, tile(F.col("t_y1")) + 1)))
    r = records.select("image", "rec_id", "x1", "y1", "x2", "y2").withColumn("rx", tile(F.col("x1"))).withColumn("ry", tile(F.col("y1")))
    near = F.lit(True)
    for c in ("x1", "y1", "x2", "y2") if corners else ("x1", "y1"):
        near &= F.abs(F.col(c) - F.col("t_" + c)) <= band
    j = r.join(t, (F.col("image") == F.col("t_image")) & (F.col("rx") == F.col("tx")) & (F.col("ry") == F.col("ty")) & near)
    return j.groupBy("image", "rec_id").agg(F.min("truth_id").alias("truth_id"))


def accuracy_pct(extracted: Column, truth: Column) -> Column:
    """100 less the relative error in percent, at least 0; 0 where either is null or the truth is 0."""
    off = F.least(F.lit(1.0), F.abs(extracted - truth) / F.nullif(truth, F.lit(0)))
    return F.coalesce(F.round((1 - off) * 100, 2), F.lit(0.0))


def majority(votes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent value (ties: seen first), its count, and whether it is accepted: more than once and by half of all."""
    c = votes.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.max_by(F.struct(F.col(value).alias("v"), "n"), F.struct("n", -F.col("seen"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), F.col("b.n").alias("n"), "total", ((F.col("b.n") > 1) & (F.col("b.n") >= F.floor(F.col("total") / 2))).alias("accepted"))


def full_outer_report(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "file_") -> DataFrame:
    """Full outer join on keys; right columns that the left has (in any case) go, the left's others get a prefix."""
    have = {c.lower() for c in left.columns}
    a = left.select(*[F.col(c).alias("__l_" + c) for c in keys], *[F.col(c).alias(prefix + c) for c in left.columns if c not in keys])
    b = right.select(*keys, *[c for c in right.columns if c not in keys and c.lower() not in have])
    on = F.lit(True)
    for k in keys:
        on &= F.col("__l_" + k) == F.col(k)
    j = a.join(b, on, "full_outer")
    return j.select(*[F.coalesce(F.col("__l_" + k), F.col(k)).alias(k) for k in keys], *[c for c in a.columns if not c.startswith("__l_")], *[c for c in b.columns if c not in keys])


def prf(hits: Column, predicted: Column, true: Column) -> list[Column]:
    """Precision (1 without predictions), recall (1 without truth) and F."""
    p = F.when(predicted > 0, hits / predicted).otherwise(F.lit(1.0))
    r = F.when(true > 0, hits / true).otherwise(F.lit(1.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 6).alias("f")]
