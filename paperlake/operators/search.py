"""Keyword, vector and hybrid retrieval for batches of questions.

Questions are a stated set that is small beside the index. They are taken in blocks, so that what
is broadcast has a fixed size, and a block meets every indexed row in one pass. Scores are products
of matrices, by batch in the executors, and a batch gives the k best rows of a question alone; so no
table of rows times questions is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import text as T
from paperlake.sources.shared import checkpoint, text_batches

K1, B = 1.5, 0.75
#: Questions of a block, and the numbers in a matrix of scores.
BLOCK = 5000
_CELLS = 1 << 21


def fetch_size(prefetch: int, top: int, total: int) -> int:
    """How many matches are fetched before filters: prefetch, or less where the index is smaller."""
    return prefetch if prefetch <= total else min(total, 2 * top if 2 * top < prefetch else prefetch - 1)


def postings(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): the index table of BM25; a chunk without tokens has no row."""
    toks = chunks.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("t")).select("id", F.size("t").alias("dl"), "t")
    each = toks.select("id", "dl", F.explode_outer("t").alias("term")).where("term IS NOT NULL")  # explode() would filter on the array's size, and so make the tokens twice
    return each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", F.col("dl").cast("long").alias("dl"))


def term_statistics(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, cf): how many ids have a term, and how often it occurs.

    A row is counted where it is and only sums by term are shuffled; rows whose id comes again are put together first.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")))
    repeats = not again.isEmpty()
    same = F.col("id").eqNullSafe(F.col("again"))
    once = rows.join(again, same, "left_anti") if repeats else rows
    toks = once.select(T.tokens(F.col("text")).alias("t")).select("t", F.array_distinct("t").alias("u")).select(F.size("u").alias("m"), F.concat("u", "t").alias("all"))
    each = toks.select("m", F.posexplode_outer("all").alias("at", "term")).where("term IS NOT NULL")
    out = each.groupBy("term").agg(F.count_if(F.col("at") < F.col("m")).alias("df"), F.count_if(F.col("at") >= F.col("m")).alias("cf"))
    if repeats:
        p = postings(rows.join(again, same, "left_semi"), "id").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
        out = out.unionByName(p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return out


def term_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with `dl`, the tokens of their text, and `terms` (term, tf), how often each occurs. A row is counted in place: runs of equal tokens are found in its sorted tokens, and nothing is moved."""
    s = rows.withColumn("__t", F.sort_array(T.tokens(F.col(text_col))))
    s = s.withColumn("__s", F.filter(F.transform("__t", lambda t, i: F.when((i == 0) | (t != F.get("__t", i - 1)), i)), lambda i: i.isNotNull()))
    runs = F.transform("__s", lambda a, i: F.struct(F.get("__t", a).alias("term"), (F.coalesce(F.get("__s", i + 1), F.size("__t")) - a).alias("tf")))
    return s.withColumns({"dl": F.size("__t").cast("long"), "terms": runs}).drop("__t", "__s")


def statistics(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n_docs, total_len): all that scoring needs besides postings."""
    return chunks.agg(F.count("*").alias("n_docs"), F.sum(F.size(T.tokens(F.col(text_col))).cast("long")).alias("total_len"))


def blocks(questions: DataFrame) -> list[DataFrame]:
    """Questions in blocks of about BLOCK rows by hash."""
    n = max(1, -(-questions.count() // BLOCK))
    return [questions.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) if n > 1 else questions for i in range(n)]


def question_terms(block: DataFrame) -> pd.DataFrame:
    """(qid, term, times) of one block of questions (qid, question)."""
    return block.select("qid", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times")).toPandas()


def _best(ids: np.ndarray, scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest positive scores of each column; rows are in the order of ids, so ties go to the smaller."""
    if k is None or k >= len(ids):
        return np.nonzero(scores > 0)
    order = np.argsort(-scores, axis=0, kind="stable")[:k]
    columns = np.broadcast_to(np.arange(scores.shape[1]), order.shape)
    live = scores[order, columns] > 0
    return order[live], columns[live]


def matched_terms(chunks: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each chunk: (id, dl, terms), its tokens and the numbers of those that are wanted (term, number), with repeats."""
    toks = chunks.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("t")).select("id", F.size("t").cast("long").alias("dl"), "t")
    each = toks.select("id", "dl", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term"))
    met = each.join(F.broadcast(wanted), "term", "left").where("term IS NULL OR number IS NOT NULL")
    return met.groupBy("id", "dl").agg(F.collect_list("number").alias("terms"))


def bm25(chunks: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, k: int | None = None) -> DataFrame:
    """(qid, id, score) of matching chunks, the k best of each batch of them or all: the sum over the question's tokens, rounded to six decimals.

    Texts are tokenised once in a block of questions. Chunks without tokens count for the statistics.
    """
    parts = []
    for block in blocks(questions):
        times = question_terms(block)
        terms = sorted(set(times["term"]))
        number = {t: i for i, t in enumerate(terms)}
        wanted = chunks.sparkSession.createDataFrame(pd.DataFrame({"term": terms, "number": range(len(terms))}, columns=["term", "number"]), "term string, number int")
        met = checkpoint(matched_terms(chunks, wanted, id_col, text_col))
        df = met.select(F.explode(F.array_distinct("terms")).alias("number")).groupBy("number").agg(F.count("*").alias("df")).toPandas()  # a row for each term of the block
        total = met.agg(F.count("*").alias("n"), F.sum("dl").alias("len")).first()
        parts.append(score_terms(met, times.assign(term=times["term"].map(number)), df, total["n"], (total["len"] or 0) / max(total["n"], 1), k1, b, k))
    return reduce(DataFrame.unionByName, parts)


def score_terms(met: DataFrame, times: pd.DataFrame, df: pd.DataFrame, n: int, mean: float, k1: float, b: float, k: int | None) -> DataFrame:
    """(id, dl, terms) -> (qid, id, score). times (qid, term, times) and df (number, df) are those of one block of questions."""
    size = int(max(times["term"].max() + 1 if len(times) else 0, 1))
    counts = np.zeros(size)
    counts[df["number"].to_numpy(dtype=np.int64)] = df["df"].to_numpy(dtype=np.float64)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    qids = np.array(sorted(set(times["qid"].tolist())), dtype=np.int64)
    t = times.sort_values("term")
    at, q = t["term"].to_numpy(dtype=np.int64), np.searchsorted(qids, t["qid"].to_numpy(dtype=np.int64))
    w = t["times"].to_numpy(dtype=np.float64) * idf[at] if len(t) else np.zeros(0)
    first = np.searchsorted(at, np.arange(size + 1))
    shared = met.sparkSession.sparkContext.broadcast((qids, q, w, first))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, w, first = shared.value
        for pdf in batches:
            pdf = pdf[pdf["terms"].map(len) > 0].sort_values("id")
            step = max(1, _CELLS // max(1, len(qids)))
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                lengths = part["terms"].map(len).to_numpy()
                rows, found = np.repeat(np.arange(len(part)), lengths), np.concatenate(part["terms"].to_numpy()).astype(np.int64)
                pair, tf = np.unique(rows << 32 | found, return_counts=True)
                rows, found = pair >> 32, pair & 0xFFFFFFFF
                norm = k1 * (1 - b + b * part["dl"].to_numpy(dtype=np.float64) / (mean or 1.0))
                share = tf / (tf + norm[rows])
                here, column = np.unique(found, return_inverse=True)
                scores = np.zeros((len(part), len(qids)))
                for c in range(0, len(here), 2048):  # some of the batch's terms at a time
                    some = here[c : c + 2048]
                    inside = (column >= c) & (column < c + 2048)
                    left = np.zeros((len(part), len(some)))
                    left[rows[inside], column[inside] - c] = share[inside]
                    right = np.zeros((len(some), len(qids)))
                    for i, term in enumerate(some):
                        span = slice(first[term], first[term + 1])
                        right[i, q[span]] = w[span]
                    scores += left @ right
                scores = np.round(scores, 6)
                ids = part["id"].to_numpy(dtype=np.int64)
                r, c = _best(ids, scores, k)
                yield pd.DataFrame({"qid": qids[c], "id": ids[r], "score": scores[r, c]})

    text_batches(met.sparkSession)  # a batch is what a task's Python holds, whatever the table's size
    return met.mapInPandas(run, "qid long, id long, score double")


def top(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best of each question with rank; ties go to the smaller id."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, F.col("id")))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def bm25_top(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(qid, id, score, rank): the k best chunks of every question."""
    return top(bm25(chunks, questions, id_col, text_col, k=k), k)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0)


def vector_top(index: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", normalize: bool = False, root: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest rows of every question (qid, qvec) by exact squared L2 distance (root: its square root), rounded to six decimals.

    Products of matrices find the rows that may be among the k, and their distances are then computed as differences. Null vectors are no rows.
    """
    parts = []
    text_batches(index.sparkSession)
    rows = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    for block in blocks(questions.where("qvec IS NOT NULL")):
        asked = block.select("qid", "qvec").toPandas()  # one block
        if not len(asked):
            continue
        qv = np.stack(asked["qvec"].to_numpy()).astype(np.float64)
        shared = index.sparkSession.sparkContext.broadcast((asked["qid"].to_numpy(dtype=np.int64), _unit(qv) if normalize else qv))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, qs = shared.value
            lengths = (qs * qs).sum(axis=1)
            step = max(1, _CELLS // len(qids))
            for pdf in batches:
                pdf = pdf.sort_values("id")
                for a in range(0, len(pdf), step):
                    ids = pdf["id"].to_numpy(dtype=np.int64)[a : a + step]
                    v = np.stack(pdf["v"].to_numpy()[a : a + step]).astype(np.float64)
                    v = _unit(v) if normalize else v
                    own = (v * v).sum(axis=1)
                    near = own[:, None] + lengths[None, :] - 2 * (v @ qs.T)
                    last = np.partition(near, min(k, len(ids)) - 1, axis=0)[min(k, len(ids)) - 1]
                    slack = 4e-6 * (1 + np.sqrt(np.maximum(last, 0))) + 1e-9 * (own.max() + lengths)
                    r, c = np.nonzero(near <= last + slack)
                    exact = np.concatenate([((qs[c[i : i + 65536]] - v[r[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(r), 65536)])
                    exact = np.round(np.sqrt(exact) if root else exact, 6)
                    order = np.lexsort((ids[r], exact, c))
                    place = np.arange(len(order)) - np.searchsorted(c[order], c[order])
                    keep = order[place < k]
                    yield pd.DataFrame({"qid": qids[c[keep]], "id": ids[r[keep]], "score": exact[keep]})

        parts.append(rows.mapInPandas(run, "qid long, id long, score double"))
    if not parts:
        return index.sparkSession.createDataFrame([], "qid long, id long, score double, rank long")
    return top(reduce(DataFrame.unionByName, parts), k, ascending=True)


def metadata_equals(wanted: dict[str, str]) -> Column:
    """All keys equal; `custom_metadata.k` looks into the map."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce((F.element_at("custom_metadata", F.lit(k.split(".", 1)[1])) if k.startswith("custom_metadata.") else F.col(k)) == v, F.lit(False))
    return out


def metadata_any_token(value: Column, wanted: list[str]) -> Column:
    """Some blank-separated token of the value is wanted."""
    return F.coalesce(F.arrays_overlap(F.split(value, r"\s+"), F.array(*map(F.lit, wanted))), F.lit(False))


def window_or_message(matches: DataFrame, questions: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Matches within the bounds, and for a question without any a row with a message."""
    kept = matches
    if least is not None:
        kept = kept.where(F.col("score") >= least)
    if most is not None:
        kept = kept.where(F.col("score") <= most)
    kept = kept.select(F.col("qid").alias("k_qid"), "id", "score", "rank")
    q = questions.select("qid")
    return q.join(kept, F.col("qid") == F.col("k_qid"), "left").select("qid", "id", "score", "rank", F.when(F.col("id").isNull(), "no match").alias("message"))


def round_robin(scores: DataFrame, values: list[str], k: int) -> DataFrame:
    """(qid, id, score, value) turn by turn: the best row of each value in the order of `values`, then the second best, until k; then by score."""
    order = F.array_position(F.array(*map(F.lit, values)), F.col("value"))
    s = scores.where(F.col("value").isin(*values)).withColumn("turn", F.row_number().over(Window.partitionBy("qid", "value").orderBy("score", "id"))).where(F.col("turn") <= k)
    s = s.withColumn("take", F.row_number().over(Window.partitionBy("qid").orderBy("turn", order))).where(F.col("take") <= k)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id", order)).cast("long")).select("qid", "id", "score", "value", "rank")


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Ranked lists (qid, id, rank) fused: the sum of 1 / (constant + rank), ties by first list and rank; the k best."""
    every = reduce(DataFrame.unionByName, [x.select("qid", "id", "rank", F.lit(i).alias("source")) for i, x in enumerate(lists)])
    fused = every.groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "first", "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def merge_results(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, sparse_ids, dense_ids) in rank order; a question that one side lacks has an empty list there."""
    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias(name))  # k rows a question

    none = F.array().cast("array<bigint>")
    return ids(sparse, "sparse_ids").join(ids(dense, "dense_ids"), "qid", "full_outer").select("qid", F.coalesce("sparse_ids", none).alias("sparse_ids"), F.coalesce("dense_ids", none).alias("dense_ids"))
