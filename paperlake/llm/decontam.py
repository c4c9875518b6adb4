"""Benchmark decontamination with DataFrame operations only.

Every benchmark window (`window` words, or all words of a shorter item) is found in
every document, exactly. A window of n words holds, at one of any n - g + 1 consecutive
starts, a gram of g words; so documents give a gram hash at every (n - g + 1)-th word
only, and the benchmark gives all of them. Hashes meet in a broadcast table whose bytes
are measured first (beyond `broadcast_bytes` it is a shuffled join), and the words
themselves are compared before a hit counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paperlake.llm.common import checkpoint, repeat_rows, text_digest, words

WINDOW = 10
BROADCAST_BYTES = 96 << 20
_DOCUMENT = 0  # the key that brings one row for each document, where the lookup table is broadcast
#: Documents with a hit up to this many are broadcast; beyond, texts are shuffled to them.
BROADCAST_HITS = 1_000_000


@dataclass(frozen=True)
class Grams:
    """How windows of one length are looked up."""

    length: int

    @property
    def size(self) -> int:
        return max(1, self.length // 2)

    @property
    def stride(self) -> int:
        return self.length - self.size + 1

    def key(self, array: str, start: str) -> str:
        parts = ", ".join(f"{array}[{start} + {i}]" for i in range(self.size))
        return f"xxhash64({self.length}, {parts})"

    def count(self) -> str:
        return f"greatest(0, (size(w) - {self.size} + {self.stride}) div {self.stride})"


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Rows (item, win): the distinct windows of each item."""
    toks = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = f"sequence(1, greatest(size(w) - {window - 1}, 1))"
    return toks.select("item", F.explode(F.expr(f"transform({starts}, i -> slice(w, i, {window}))")).alias("win")).distinct()


def _lookup(windows: DataFrame, grams: list[Grams]) -> DataFrame:
    """Rows (key, length, back, win, items): a gram's key, how far behind it its window starts, and the items that have the window."""
    distinct = windows.groupBy("win").agg(F.collect_set(F.col("item").cast("string")).alias("items"))  # at most every item of the benchmark
    parts = None
    for g in grams:
        rows = distinct.where(F.size("win") == g.length).select(
            F.explode(F.sequence(F.lit(0), F.lit(g.stride - 1))).alias("back"), "win", "items"
        ).selectExpr(f"{g.key('win', 'back')} AS key", f"{g.length} AS length", "back", "win", "items")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def find_windows(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per distinct (id, text digest): n_words, copies (equal rows), spans (sorted start and length of hits), items (sorted strings).

    A gram's row carries the few words that its windows may cover, not the text, so the work is linear in a text's length. Null
    texts have no words; repeated rows are counted in copies; an empty table gives no rows; very long texts are one row each.
    """
    spark = docs.sparkSession
    sizes = windows.groupBy(F.size("win").alias("n")).agg(F.count("*").alias("c"), F.sum(F.octet_length(F.array_join("win", " "))).alias("b")).collect()
    grams = [Grams(r["n"]) for r in sorted(sizes, key=lambda r: r["n"])]  # at most `window` lengths
    small = sum((r["b"] + 96 * r["c"]) * Grams(r["n"]).stride for r in sizes) <= broadcast_bytes
    toks = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("w"))
    none = "CAST(array() AS array<struct<key:bigint,length:int,at:int,off:int,near:array<string>>>)"
    parts = []
    for g in grams:  # the words from `at` on: those of every window that holds the gram at i
        start = f"i * {g.stride}"
        at = f"greatest(0, {start} - {g.stride - 1})"
        gram = f"named_struct('key', {g.key('w', start)}, 'length', {g.length}, 'at', CAST({at} AS int), 'off', CAST({start} - {at} AS int), 'near', slice(w, {at} + 1, {start} - {at} + {g.length}))"
        parts.append(f"if({g.count()} > 0, transform(sequence(0, {g.count()} - 1), i -> {gram}), {none})")
    each = f"concat({', '.join(parts)})" if parts else none
    alone = f"named_struct('key', {_DOCUMENT}L, 'length', 0, 'at', size(w), 'off', 0, 'near', CAST(array() AS array<string>))"
    lookup = _lookup(windows, grams) if grams else None
    columns = ["id", "digest", "g.*"]
    if small:  # a document's own row, with its length in `at`, comes out of the same pass
        own = spark.range(1).selectExpr(f"{_DOCUMENT}L AS key", "0 AS length", "0 AS back", "CAST(array() AS array<string>) AS win", "CAST(array() AS array<string>) AS items")
        rows = toks.select("id", "digest", F.explode(F.expr(f"concat(array({alone}), {each})")).alias("g")).select(*columns)
        met = rows.join(F.broadcast(own.unionByName(lookup) if grams else own), ["key", "length"])
    else:  # only grams are shuffled, each by its own key
        met = toks.select("id", "digest", F.explode(F.expr(each)).alias("g")).select(*columns).join(lookup, ["key", "length"])
        met = met.unionByName(toks.selectExpr("id", "digest", f"{alone} AS g").select(*columns).selectExpr("*", "0 AS back", "CAST(array() AS array<string>) AS win", "CAST(array() AS array<string>) AS items"))
    hits = met.where("length = 0 OR (off >= back AND slice(near, off - back + 1, length) = win)").selectExpr(
        "id", "digest", "length", "if(length = 0, at, 0) AS n", "at + off - back AS start", "items")
    return hits.groupBy("id", "digest").agg(
        F.max("n").alias("n_words"),
        F.sum((F.col("length") == 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("length") > 0, F.struct("start", "length")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: str = "spans") -> Column:
    """How many words a sorted list of (start, length) covers."""
    return F.expr(
        f"aggregate({spans}, named_struct('upto', 0, 'n', 0), (a, s) -> named_struct("
        "'upto', greatest(a.upto, s.start + s.length), 'n', a.n + greatest(0, s.start + s.length - greatest(a.upto, s.start))), a -> a.n)"
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items (sorted strings), contaminated.

    Null and empty texts have no words and no hits; null ids are a key like any other; equal
    rows give equal results each; items without words match nothing; an empty benchmark leaves
    every document clean. Other columns of either table are not read.
    """
    found = find_windows(docs, id_col, text_col, benchmark_windows(items, item_col, item_text_col, window), broadcast_bytes)
    out = found.select(F.col("id").alias(id_col), "n_words", covered().alias("n_hit"), "items", "copies")
    return repeat_rows(out, "copies").select(
        id_col, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, remove: str = "documents",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without what the benchmark has; all columns stay.

    remove="documents" leaves out every document with a hit. remove="spans" cuts the hit words
    out of the text, with what stands before each of them, and leaves out documents that were
    all hit; the rest of the text stays as it is. Null texts and ids, texts without words and repeated rows
    stay as they are; an empty benchmark removes nothing, and an empty table gives none.
    """
    found = find_windows(docs, id_col, text_col, benchmark_windows(items, item_col, item_text_col, window), broadcast_bytes)
    hit = checkpoint(found.where(F.size("spans") > 0).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("spans").alias("__spans")))
    if hit.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit if remove == "spans" else hit.drop("__spans"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & text_digest(F.col(text_col)).eqNullSafe(F.col("__digest"))
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    gap, word = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*", r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).alias("__key"), F.col(text_col).alias("__text"), text_digest(F.col(text_col)).alias("__own"))
    marked = packed.join(hit, F.col("__key").eqNullSafe(F.col("__id")) & F.col("__own").eqNullSafe(F.col("__digest")), "left")
    marked = marked.withColumn("__parts", F.when(F.col("__spans").isNotNull(), F.expr(f"regexp_extract_all(__text, '{gap}{word}', 0)")))
    kept = F.expr("array_join(filter(__parts, (p, i) -> NOT exists(__spans, s -> i >= s.start AND i < s.start + s.length)), '')")
    marked = marked.withColumn("__kept", kept).where("__spans IS NULL OR __kept <> ''")
    text = F.when(F.col("__spans").isNotNull(), F.concat("__kept", F.expr(f"regexp_extract(__text, '{gap}$', 0)"))).otherwise(F.col("__text"))
    return marked.select(*[text.alias(c) if c == text_col else F.col("__doc").getField(c).alias(c) for c in docs.columns])
