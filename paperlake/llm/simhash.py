"""Near-duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

Two fingerprints that differ in three bits or fewer agree in one of their four 16-bit
blocks; of the two halves of the other 48 bits, one has an error at most. The Golay code
turns 23 bits of such a half into the indices of near codewords: either fingerprint's
nearest one is among the other's six. So a key is (block, its 16 bits, half, codeword
index); each side of the join has all that it may meet, and whole fingerprints are
compared before a link counts. The 24th bit of a half needs no care: an error there is
none in the 23. Equal fingerprints are one before all this.

Many near copies of one text give fingerprints that lie close together, in most cases one bit
from the next. So each fingerprint first joins the smallest one that differs from it in one
block alone, and the keys above then bring one link for every two such groups that meet; a
group's head that went to a smaller one itself is linked to it like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from paperlake.llm.common import checkpoint, join_counted, text_batches, text_digest
from paperlake.llm.components import components
from paperlake.llm.golay import KEYS, near_codewords

SHINGLE = 3
MAX_BITS = 3
#: Fingerprints to a task where they become key rows.
FINGERPRINTS = 20_000
#: Rows to leave out, or to have once, up to this many are broadcast by their keys.
BROADCAST_ROWS = 500_000
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' XXH64 (seed 42) have it; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    k = min(shingle, len(w))
    n = len(w) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _PIECE):
        part = w[a : min(a + _PIECE, n) + k - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(k))))
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))


def block_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint: the eight keys of its nearest codewords, and the 48 of all near ones (with repeats)."""
    v = fps.view(np.uint64)
    near, every = [], []
    for block in range(4):
        exact = (v >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64)
        rest = np.zeros(len(v), dtype=np.uint64)
        for i, other in enumerate(b for b in range(4) if b != block):
            rest |= (v >> np.uint64(16 * other) & np.uint64(0xFFFF)) << np.uint64(16 * i)
        for half in range(2):
            words = near_codewords((rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.int32)).astype(np.int64)
            keys = (np.int64(2 * block + half) << 28) | (exact[:, None] << 12) | words
            near.append(keys[:, 0])
            every.append(keys)
    return np.stack(near, axis=1), np.concatenate(every, axis=1)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(fp, own) -> rows (key, fp, own, probe): where a fingerprint is kept, and where it looks."""
    for pdf in batches:
        fps, own = pdf["fp"].to_numpy(dtype=np.int64), pdf["own"].to_numpy(dtype=np.int64)
        for a in range(0, len(fps), 4096):
            part, mine = fps[a : a + 4096], own[a : a + 4096]
            near, every = block_keys(part)
            fresh = np.ones(every.shape, dtype=bool)
            for c in range(every.shape[1]):
                if c % KEYS:
                    fresh[:, c] = every[:, c] != every[:, c - c % KEYS]
            at, _ = np.nonzero(fresh)
            yield pd.DataFrame({"key": near.ravel(), "fp": np.repeat(part, near.shape[1]), "own": np.repeat(mine, near.shape[1]), "probe": False})
            yield pd.DataFrame({"key": every[fresh], "fp": part[at], "own": mine[at], "probe": True})


def _check(max_bits: int) -> None:
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits: {max_bits}")


def block_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v), u < v, for every two that differ in one 16-bit block alone, and there in max_bits or fewer."""
    _check(max_bits)
    rest = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.expr(f"fp & ~shiftleft(65535L, {16 * b})").alias("rest")) for b in range(4)]))
    rows = fps.select("fp", rest.alias("r")).select("fp", "r.block", "r.rest")
    other = rows.select(F.col("fp").alias("v"), "block", "rest")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return rows.withColumnRenamed("fp", "u").join(other, ["block", "rest"]).where(near).select("u", "v")


def group_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp, own) -> (u, v), u < v: the values of own between whose fingerprints there is a link of max_bits (3 at most) or fewer.

    With own = fp these are all links.
    """
    _check(max_bits)
    rows = fps.mapInPandas(_key_rows, "key long, fp long, own long, probe boolean")
    kept = rows.where("NOT probe").select("key", F.col("fp").alias("u"), F.col("own").alias("a"))
    asked = rows.where("probe").select("key", F.col("fp").alias("v"), F.col("own").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return kept.join(asked.hint("merge"), "key").where(near).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, component): the same value for all fingerprints that reach each other over links of max_bits or fewer."""
    head = block_links(fps, max_bits).groupBy(F.col("v").alias("__fp")).agg(F.min("u").alias("head"))
    grouped = checkpoint(fps.join(head, F.col("fp") == F.col("__fp"), "left").select("fp", F.coalesce("head", "fp").alias("own")))
    # a fingerprint becomes 56 key rows, so tasks get FINGERPRINTS of them and no more
    dealt = grouped.repartition(max(1, -(-grouped.count() // FINGERPRINTS)), "fp")
    found = components(group_links(dealt, max_bits))
    counts = grouped.groupBy("own").agg(F.count("*").alias("n"))
    named = counts.join(found, F.col("own") == F.col("node"), "left").select("own", F.coalesce("component", "own").alias("component"), "n")
    return join_counted(grouped, checkpoint(named), "own", "n").select("fp", "component")


def _classified(docs: DataFrame, id_col: str, text_col: str, max_bits: int, with_digest: bool = False) -> DataFrame:
    """Rows (id, fp, component_id), and each text's digest if asked for."""
    text_batches(docs.sparkSession)
    digest = [text_digest(F.col(text_col)).alias("digest")] if with_digest else []
    prints = checkpoint(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp"), *digest))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    named = checkpoint(classes.join(fingerprint_components(classes.select("fp"), max_bits), "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    of = checkpoint(join_counted(named, least, "component", "m").select("fp", "component_id", "n"))
    return join_counted(prints, of, "fp", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Null texts, and those without words, have fingerprint zero and are linked like any other; null ids take
    part and get the component of the others (null if all are null); equal rows stay; other columns are not read; an
    empty table gives none. A very long text is hashed in parts.
    """
    return _classified(docs, id_col, text_col, max_bits).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key(i: Column, digest: Column) -> Column:
    """An id and a text's digest as one string that is never null."""
    return F.concat(F.coalesce(digest, F.lit("-")), F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents of the smallest id in each group, with all columns; of a group's rows that share that id, one.

    Groups whose ids are all null are one to this: one of their rows stays. An id that comes with several texts
    stands for the group in which it is the smallest, with the text that is in it. Null texts are documents like any
    other; an empty table gives none. Texts stay where they are as long as the rows that go, or come twice, are at most
    BROADCAST_ROWS by their keys; beyond, they are shuffled once.
    """
    found = _classified(docs, id_col, text_col, max_bits, with_digest=True)
    mine = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").agg(F.min(F.struct(F.col("digest").isNull(), "digest")).alias("d"))
    keep = checkpoint(mine.select(_row_key(F.col("id"), F.col("d.digest")).alias("__keep")))
    every = found.groupBy(_row_key(F.col("id"), F.col("digest")).alias("__key")).agg(F.count("*").alias("n"))
    marked = every.join(keep, F.col("__key") == F.col("__keep"), "left").select("__key", F.col("__keep").isNull().alias("gone"), "n")
    special = checkpoint(marked.where("gone OR n > 1"))
    keyed = docs.withColumn("__row", _row_key(F.col(id_col), text_digest(F.col(text_col))))
    if special.count() > BROADCAST_ROWS:
        # rows meet and are told apart by one key, so the texts are shuffled once
        return keyed.join(keep, F.col("__row") == F.col("__keep"), "left_semi").dropDuplicates(["__row"]).drop("__row")
    alone = keyed.join(F.broadcast(special.select("__key")), F.col("__row") == F.col("__key"), "left_anti")
    twice = special.where("NOT gone").select("__key")
    if twice.limit(1).count():
        alone = alone.unionByName(keyed.join(F.broadcast(twice), F.col("__row") == F.col("__key"), "left_semi").dropDuplicates(["__row"]))
    return alone.drop("__row")
