"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over runs of five code points of any script, with marks for a text's start and end, so
its table grows with the trusted text and has no bound; its counts come from every trusted document.
Counts, continuation counts, discounts and probabilities are DataFrame joins by gram, which shards them
by key. Only grams that some document has get a probability. Documents find theirs in a broadcast copy
where that table is small enough by its row count, and meet it in a shuffled join beyond. Each language's
threshold is a quantile of its trusted documents' perplexities.

A gram is two numbers: `lo` has its last three code points, `hi` what is before them, 21 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paperlake.llm.common import checkpoint, join_counted, repeat_rows, text_batches

ORDER, BITS = 5, 21
QUANTILE = 0.999
#: One in so many trusted documents, by hash, is kept from the model and measured for the thresholds.
HELD_OUT = 4
#: Factor on the quantile; none, since room above it lets low quality pass.
SLACK = 1.0
#: Symbols of average trusted text that a document's mean is mixed with, since short texts vary.
PRIOR = 100
#: Trusted ids up to this many are broadcast; beyond, documents are joined by shuffling.
BROADCAST_IDS = 2_000_000
#: Probabilities up to this many are broadcast, 24 bytes each; beyond, documents' grams are joined by shuffling.
BROADCAST_GRAMS = 1_500_000
_PIECE = 1 << 19
_START, _END, _FIRST = 0, 1, 2  # code points follow behind the two marks


def grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hi, lo) of the runs of ORDER symbols that end at each code point of a text and at its end, in parts."""
    carry = np.full(ORDER - 1, _START, dtype=np.int64)
    for a in range(0, max(len(text), 1), _PIECE):
        cp = np.frombuffer(text[a : a + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + _FIRST
        s = np.concatenate([carry, cp, [_END]] if a + _PIECE >= len(text) else [carry, cp])
        yield s[:-4] << BITS | s[1:-3], s[2:-2] << 2 * BITS | s[3:-1] << BITS | s[4:]
        carry = s[-(ORDER - 1) :]


def _unique(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams once each, and how often each comes, or the sums of n. Should two grams have one mixed key, either may come more than once, which sums mend."""
    order = np.argsort(_mixed(hi, lo, 0xC2B2AE3D27D4EB4F))
    hi, lo = hi[order], lo[order]
    first = np.ones(len(hi), dtype=bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(hi))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, dtype=np.int64)
    return hi[at], lo[at], counts


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal size
        if fresh:
            held.append(_unique(np.concatenate([x[0] for x in fresh]), np.concatenate([x[1] for x in fresh])))
            held[:] = [_unique(*(np.concatenate([x[i] for x in held]) for i in range(3)))]
            fresh.clear()
            size = 0

    for pdf in batches:
        for text in pdf["text"]:
            for g in grams(text or ""):
                fresh.append(g)
                size += len(g[0])
                if size > 1 << 20:
                    fold()
        if held and len(held[0][0]) > 1 << 20:  # a task of much varied text gives what it has and starts anew
            yield pd.DataFrame(dict(zip(("hi", "lo", "n"), held.pop())))
    fold()
    if held:
        yield pd.DataFrame(dict(zip(("hi", "lo", "n"), held[0])))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(text) -> (hi, lo, n): how often each gram comes; null counts as empty, and an empty text has its end alone."""
    return texts.select("text").mapInPandas(_totals, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _last(k: int) -> list[Column]:
    """The last k symbols of a gram."""
    hi = F.col("hi").bitwiseAND((1 << BITS * max(0, k - 3)) - 1)
    return [hi.alias("hi"), F.col("lo").bitwiseAND((1 << BITS * min(3, k)) - 1).alias("lo")]


def _context() -> list[Column]:
    """A gram without its last symbol."""
    return [F.shiftright("hi", BITS).alias("chi"), F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND((1 << BITS) - 1), 2 * BITS)).alias("clo")]


def discounts(ones: tuple[int, int, int, int]) -> list[float]:
    """D1, D2 and D3+ from how many grams come once, twice, three and four times; where one is zero, the plain absolute discount, or a half."""
    n1, n2, n3, n4 = ones
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else y
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else max(d1, y)
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else max(d2, y)
    return [min(max(d, 0.05), k) for k, d in zip((1.0, 2.0, 3.0), (d1, d2, d3))]


def log_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hi, lo, n) of trusted text, and (hi, lo) -> (hi, lo, lp): the natural log of each wanted gram's interpolated probability.

    Code points that trusted text lacks share the probability of one more.
    """
    levels = [counts.select("hi", "lo", "n")]
    for order in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter gram
        levels.insert(0, levels[0].groupBy(*_last(order)).agg(F.count("*").alias("n")))
    levels = [checkpoint(x) if i < 3 else x for i, x in enumerate(levels)]
    asked = [wanted.select("hi", "lo")]
    for order in range(ORDER - 1, 0, -1):
        asked.insert(0, asked[0].select(*_last(order)).distinct())
    lower = None
    for order in range(1, ORDER + 1):
        have = levels[order - 1]
        r = have.agg(F.count("*").alias("v"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
        d1, d2, d3 = discounts(tuple(r[f"n{k}"] for k in range(1, 5)))
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = have.select("n", *_context()).groupBy("chi", "clo").agg(F.sum("n").alias("total"), F.sum(less).alias("free"))
        q = asked[order - 1].select("hi", "lo", *_context()).join(have, ["hi", "lo"], "left").join(context, ["chi", "clo"], "left")
        if lower is None:
            q = q.withColumn("below", F.lit(1.0 / (r["v"] + 1)))
        else:
            q = q.withColumns(dict(zip(("shi", "slo"), _last(order - 1)))).join(lower, ["shi", "slo"])
        own = F.coalesce((F.col("n") - less) / F.col("total"), F.lit(0.0))
        p = own + F.coalesce(F.col("free") / F.col("total"), F.lit(1.0)) * F.col("below")
        lower = q.select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), p.alias("below"))
    return lower.select(F.col("shi").alias("hi"), F.col("slo").alias("lo"), F.log("below").alias("lp"))


def text_sums(docs: DataFrame, table: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs (key, text) with distinct keys -> (key, symbols, lp): how many symbols a text has, its end with them, and the sum of their log probabilities. table has (hi, lo, lp) of every gram of the texts, and in n how often it comes."""
    spark = docs.sparkSession
    text_batches(spark)
    if table.count() <= broadcast_grams:
        t = table.select("hi", "lo", "lp").toArrow()  # its size is checked
        shared = spark.sparkContext.broadcast(Lookup(*(t.column(c).to_numpy() for c in ("hi", "lo", "lp"))))

        @F.pandas_udf("symbols long, lp double")
        def score(texts: pd.Series) -> pd.DataFrame:
            table = shared.value
            symbols, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            held: list[np.ndarray] = []
            owner: list[int] = []
            size = 0

            def look() -> None:
                nonlocal size
                if held:
                    lengths = np.array([len(x) for x in held])
                    found = table.values(np.concatenate(held))
                    np.add.at(total, owner, np.add.reduceat(found, np.cumsum(lengths) - lengths))
                    np.add.at(symbols, owner, lengths)
                held.clear()
                owner.clear()
                size = 0

            for i, text in enumerate(texts):
                for h, g in grams(text or ""):
                    held.append(_mixed(h, g, table.factor))
                    owner.append(i)
                    size += len(h)
                    if size > 1 << 17:
                        look()
            look()
            return pd.DataFrame({"symbols": symbols, "lp": total})

        return docs.select("key", score.asNondeterministic()("text").alias("s")).select("key", "s.*")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                for h, g in grams(text or ""):
                    h, g, n = _unique(h, g)
                    yield pd.DataFrame({"key": key, "hi": h, "lo": g, "n": n})

    kind = dict(docs.dtypes)["key"]
    rows = docs.select("key", "text").mapInPandas(each, f"key {kind}, hi long, lo long, n long").withColumnRenamed("n", "times")
    met = join_counted(rows, table.select("hi", "lo", "lp", F.col("n").alias("often")), ["hi", "lo"], "often")
    return met.groupBy("key").agg(F.sum("times").alias("symbols"), F.sum(F.col("times") * F.col("lp")).alias("lp"))


def _mixed(hi: np.ndarray, lo: np.ndarray, factor: int) -> np.ndarray:
    x = hi.astype(np.uint64) * np.uint64(factor) ^ lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(31)


class Lookup:
    """The values of grams under 64-bit keys, no two of them alike; every gram that is looked up must be in it, so it has its own key."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, lp: np.ndarray):
        for self.factor in range(0xC2B2AE3D27D4EB4F, 1 << 64, 2):
            keys = _mixed(hi, lo, self.factor)
            order = np.argsort(keys)
            keys = keys[order]
            if not (keys[1:] == keys[:-1]).any():
                break
        self.keys, self.lp = keys, lp[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        #: Where the keys of each leading bit pattern start; about one has each.
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def values(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[wanted >> self.shift]
        left = np.flatnonzero(self.keys[at] != wanted)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != wanted[left]]
        return self.lp[at]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quality_col: str = "quality", quantile: float = QUANTILE, slack: float = SLACK, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per document row: id, n_chars, perplexity, threshold, kept.

    Trusted are the documents whose id has a label of quality 1. The model learns from three in four of them; a
    language's threshold is the given quantile of the others' perplexities times slack. A language without any has
    that of all languages, and without trusted text every text is kept. Null and empty texts have 0 characters, and
    they and texts of white space are not kept. Null languages are one language; null ids are never trusted; equal
    rows get equal results each; other columns are not read; an empty table gives none. Very long texts go through in parts.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trusted = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("__t")).where("__t IS NOT NULL").distinct()
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sure = F.broadcast(trusted) if few else trusted
    mine = slim.join(sure, F.col("id") == F.col("__t"), "left_semi")
    measured = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(HELD_OUT)) == 0
    counts = checkpoint(gram_counts(mine.where(~measured)))
    every = checkpoint(gram_counts(slim))
    table = checkpoint(log_probabilities(counts, every).join(every, ["hi", "lo"]))
    mean = table.join(counts.withColumnRenamed("n", "m"), ["hi", "lo"]).agg((F.sum(F.col("m") * F.col("lp")) / F.sum("m")).alias("x")).first()["x"] or 0.0
    has_word = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    if table.count() <= broadcast_grams:  # every row is scored where it is
        rows = slim.select(F.struct("id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), has_word.alias("word"), F.lit(1).cast("long").alias("copies")).alias("key"), "text")
        each = text_sums(rows, table, broadcast_grams).select("key.*", "symbols", "lp")
    else:  # equal rows are one; a text stands for itself by two hashes
        two = [F.xxhash64(F.lit(k), F.isnull("text"), "text").alias(f"t{k}") for k in range(2)]
        once = slim.groupBy("id", "lang", *two).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        key = F.struct("id", "lang", "t0", "t1", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), has_word.alias("word"), "copies")
        keyed = once.select(key.alias("key"), "text")
        sums = text_sums(keyed.withColumn("key", F.to_json("key")), table, broadcast_grams)
        each = sums.withColumn("key", F.from_json("key", keyed.schema["key"].dataType)).select("key.*", "symbols", "lp")
    log = (F.col("lp") + PRIOR * mean) / (F.col("symbols") + PRIOR)
    scored = checkpoint(each.select("id", "lang", "copies", "n_chars", "word", F.round(F.exp(-log), 6).alias("perplexity")))
    known = scored.join(sure, F.col("id") == F.col("__t"), "left_semi").where(F.col("word") & measured)
    of_lang = known.groupBy(F.col("lang").alias("__lang")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("__own"))
    of_all = known.agg(F.percentile_approx("perplexity", quantile, 10000).alias("q")).first()["q"]
    out = scored.join(F.broadcast(of_lang), F.col("lang").eqNullSafe(F.col("__lang")), "left")  # a row for each language
    threshold = F.coalesce("__own", F.lit(float("inf") if of_all is None else of_all)) * slack
    out = out.select(F.col("id").alias(id_col), "n_chars", "perplexity", threshold.alias("threshold"), (F.col("word") & (F.col("perplexity") <= threshold)).alias("kept"), "copies")
    return repeat_rows(out, "copies")
