"""Language identification with a bidirectional gated recurrent network over bytes.

A GRU steps over every byte in either direction, and an output layer labels every position
from both states. Position probabilities are pooled over the whole document by their mean
logarithm. Texts run through in windows, states starting anew in each, with every byte in
one window. Training is backpropagation through time in numpy, on the driver, over short
windows of a bounded sample; prediction is numpy on batches in the executors. The sample is
bounded for each language, and every language is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.llm.common import text_batches

WINDOW = 256  # bytes that a prediction's states run over
TRAIN_WINDOW = 64
HIDDEN = 10
#: Labelled documents of each language that training may see, at most, and windows of each of them.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
UNKNOWN = "und"
_BATCH_BYTES = 1 << 17


@dataclass
class Model:
    """For each direction: what a byte adds to the gates and to the candidate (with their biases), and the recurrent weights."""

    langs: list[str]
    embed: np.ndarray  # 2 x 3 x 256 x H: update, reset, candidate
    rec: np.ndarray  # 2 x 3 x H x H
    out: np.ndarray  # 2 x H x L
    out_bias: np.ndarray  # L

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.rec, self.out, self.out_bias]


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of `width` (padded with zeros), each row's bytes, and each row's text."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    rows = -(-n // width)
    owner = np.repeat(np.arange(len(texts)), rows)
    first = np.cumsum(rows) - rows
    size = np.full(len(owner), width, dtype=np.int64)
    last = (first + rows - 1)[rows > 0]
    size[last] = (n - (rows - 1) * width)[rows > 0]
    flat = np.zeros((len(owner), width), dtype=np.uint8)
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    flat[np.arange(width) < size[:, None]] = joined
    return flat, size, owner


def _states(m: Model, x: np.ndarray, live: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
    """The states of one direction, T x B x H. x is T x B with the longest windows first; live[k] of them have a byte at k.

    Gates are halves of 1 + tanh, so a step is three lookups, three products and three tanh.
    """
    t, b = x.shape
    h = m.rec.shape[-1]
    half = m.embed.dtype.type(0.5)
    ez, er, ec = m.embed[d, 0] * half, m.embed[d, 1] * half, m.embed[d, 2]
    uz, ur, uc = m.rec[d, 0] * half, m.rec[d, 1] * half, m.rec[d, 2]
    out = np.zeros((t, b, h), dtype=m.embed.dtype)
    state = np.zeros((b, h), dtype=m.embed.dtype)
    for k in range(t) if d == 0 else range(t - 1, -1, -1):
        n = live[k]
        s, at = state[:n], x[k, :n]
        z = np.tanh(ez[at] + s @ uz)
        r = np.tanh(er[at] + s @ ur)
        z += 1
        z *= half
        r += 1
        r *= half
        u = s @ uc
        c = np.tanh(ec[at] + r * u)
        if trace is not None:
            trace.append((k, n, s.copy(), z, r, u, c))
        out[k, :n] = s + z * (c - s)
        state[:n] = out[k, :n]
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=0)
    return x - np.log(np.exp(x).sum(axis=0))


def _forward(m: Model, x: np.ndarray, live: np.ndarray, traces: list[list] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log probabilities of every position, L x T x B, and the states of both directions."""
    t, b = x.shape
    states = [_states(m, x, live, d, None if traces is None else traces[d]) for d in range(2)]
    logits = sum(m.out[d].T @ states[d].reshape(t * b, -1).T for d in range(2)) + m.out_bias[:, None]
    return _log_softmax(logits).reshape(len(m.langs), t, b), states


def _ordered(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns, the longest first, up to the longest one's end; how many have each place; and their order."""
    order = np.argsort(-size, kind="stable")
    t = int(size.max(initial=0))
    return np.ascontiguousarray(x[order, :t].T), np.searchsorted(-size[order], -np.arange(t), side="left"), order


def loss_and_gradients(m: Model, x: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean cross-entropy of all positions of windows (B x T bytes, sizes, languages, weights), and its gradients by backpropagation through time."""
    xt, live, order = _ordered(x, size)
    y, weight = y[order], weight[order]
    t, b = xt.shape
    h, kind = m.rec.shape[-1], m.embed.dtype
    traces: list[list] = [[], []]
    lp, states = _forward(m, xt, live, traces)
    w = np.where(np.arange(b) < live[:, None], weight, 0).astype(kind)
    w /= max(w.sum(), 1e-9)
    loss = -float((lp[y, :, np.arange(b)].T * w).sum())
    p = np.exp(lp)
    p[y, :, np.arange(b)] -= 1
    p *= w
    dl = p.reshape(len(m.langs), t * b)
    grads = [np.zeros_like(q) for q in m.params()]
    grads[3] += dl.sum(axis=1)
    for d in range(2):
        grads[2][d] = states[d].reshape(t * b, h).T @ dl.T
        ds_all = (dl.T @ m.out[d].T).reshape(t, b, h)
        into = np.zeros((3, t, b, h), dtype=kind)  # of what each byte adds
        carry = np.zeros((b, h), dtype=kind)
        for k, n, s, z, r, u, c in reversed(traces[d]):
            ds = ds_all[k, :n] + carry[:n]
            dc = ds * z * (1 - c * c)
            dz = ds * (c - s) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            du = dc * r
            into[0, k, :n], into[1, k, :n], into[2, k, :n] = dz, dr, dc
            grads[1][d, 0] += s.T @ dz
            grads[1][d, 1] += s.T @ dr
            grads[1][d, 2] += s.T @ du
            carry[:n] = ds * (1 - z) + dz @ m.rec[d, 0].T + dr @ m.rec[d, 1].T + du @ m.rec[d, 2].T
        for g in range(3):
            for j in range(h):
                grads[0][d, g, :, j] = np.bincount(xt.ravel(), weights=into[g, :, :, j].ravel(), minlength=256)
    return loss, grads


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7, kind: type = np.float32) -> Model:
    rng, n = np.random.default_rng(seed), len(langs)

    def rand(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.1).astype(kind)

    return Model(langs, rand(2, 3, 256, hidden), rand(2, 3, hidden, hidden), rand(2, hidden, n), np.zeros(n, kind))


def train(rows: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit to windows (bytes, language) with Adam; the loss gives equal weight to languages."""
    langs = sorted({lang for _, lang in rows})
    m, n = fresh(langs, hidden, seed), len(langs)
    if n < 2:
        return m
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), TRAIN_WINDOW), dtype=np.uint8)
    size = np.array([min(len(text), TRAIN_WINDOW) for text, _ in rows])
    for i, (text, _) in enumerate(rows):
        x[i, : size[i]] = np.frombuffer(text[:TRAIN_WINDOW], dtype=np.uint8)
    y = np.searchsorted(langs, [lang for _, lang in rows])
    weight = len(rows) / (n * np.bincount(y, minlength=n))[y]
    params = m.params()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            _, grads = loss_and_gradients(m, x[at], size[at], y[at], weight[at])
            step += 1
            now = rate * min(1, step / 20) / (1 + step / 400)
            for q, g, f, s2 in zip(params, grads, first, second):
                f += 0.1 * (g - f)
                s2 += 0.01 * (g * g - s2)
                q -= now * (f / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
    return m


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """Document probabilities: the softmax of position log probabilities, averaged over all bytes, times a fixed sharpness."""
    n_langs = len(m.langs)
    total, count = np.zeros((n_langs, len(texts))), np.array([len(t) for t in texts], dtype=np.float64)
    flat, size, owner = windows(texts)
    step = max(1, _BATCH_BYTES // WINDOW)
    order = np.argsort(-size, kind="stable")  # windows of like sizes go together
    for a in range(0, len(order), step):
        at = order[a : a + step]
        x, live, inner = _ordered(flat[at], size[at])
        lp, _ = _forward(m, x, live)
        sums = np.zeros((n_langs, len(at)))
        for k, n in enumerate(live):
            sums[:, :n] += lp[:, k, :n]
        for i in range(n_langs):
            total[i] += np.bincount(owner[at][inner], weights=sums[i], minlength=len(texts))
    mean = total / np.maximum(count, 1)
    return np.exp(_log_softmax(mean * np.minimum(count, 20))).T


def learnable(id_col: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2; never for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 != 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE_DOCS) -> list[tuple[bytes, str]]:
    """Windows of labelled learnable documents, at evenly spread places of each: those of the per_lang smallest hashes of ids in each language.

    A language's rows are first thinned by that hash to about twice per_lang, so that no task ranks all of a language.
    """
    named = docs.where(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    place = F.expr(f"array_distinct(transform(sequence(0, {SAMPLE_WINDOWS - 1}), i -> substr(text, 1 + CAST(i * greatest(length(text) - {TRAIN_WINDOW}, 0) / {SAMPLE_WINDOWS - 1} AS int), {TRAIN_WINDOW})))")
    counts = named.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * per_lang / F.count("*")).alias("share"))  # a row for each language
    h = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40))
    thin = named.withColumn("h", h).join(F.broadcast(counts), "lang").where(F.col("h") < F.col("share") * float(1 << 40))
    parts = thin.select("lang", "id", "h", place.alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "parts"))
    rows = parts.withColumn("n", rank).where(F.col("n") <= per_lang).select("lang", "n", "parts").collect()  # per_lang documents a language
    return [(p.encode("utf-8", "surrogatepass")[:TRAIN_WINDOW], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["n"])) for p in r["parts"]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS) -> Model:
    return train(sample(docs, id_col, text_col, lang_col, per_lang))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document row: id (or the columns of keep), held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no language was
    learned. A null id is not held out. Equal rows stay, and get equal labels; other columns are not read; an empty table
    gives none. A very long text goes through in windows, about a megabyte of texts, or one text, at a time.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        m, lang, score = shared.value, [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m.langs else []
        a = 0
        while a < len(at):  # batches of about a megabyte, or one text
            b, held = a, 0
            while b < len(at) and (b == a or held < 1 << 20):
                held += len(texts.iloc[at[b]])
                b += 1
            p = pooled(m, [texts.iloc[i].encode("utf-8", "surrogatepass") for i in at[a:b]])
            for i, k, s in zip(at[a:b], p.argmax(axis=1), p.max(axis=1)):
                lang[i], score[i] = m.langs[k], s
            a = b
        return pd.DataFrame({"lang_pred": lang, "score": score})

    label = label.asNondeterministic()  # so that a filter on the labels does not run the network once more
    cols = [id_col] if keep is None else keep
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return docs.select(*cols, held.alias("held_out"), label(F.col(text_col)).alias("__p")).select(*cols, "held_out", "__p.lang_pred", "__p.score")
