"""Queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import numpy as np
import public_tokenizers
from paperlake.llm import bpe, queries
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen, stages = docs, []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, seen, DATA).write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        stages.append(seen)
    rules, lang, near, clean, ids = stages
    for s in stages[:4]:
        assert s.columns == docs.columns
    kept = {r.doc_id for r in queries.op5_quality_rules(spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    assert {r.doc_id for r in lang.collect()} <= kept and lang.count() >= 0.97 * len(kept)
    rows = sorted((r.doc_id, r.text) for r in lang.collect())
    group = brute.classes([brute.fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in near.collect()} == {rows[g][0] for g in set(group)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in near.collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i, _, hit, _ in brute.contamination(rows, items) if not hit}
    assert {r.doc_id for r in ids.collect()} == {r.doc_id for r in clean.collect()}
    assert ids.where(F.col("n_tokens") <= 0).count() == 0
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in ids.collect()[:20]:
        assert bpe.tokenizer(WORD).vocabulary.decode(np.frombuffer(r.ids, dtype="<u4").astype(np.int64)) and r.n_tokens == len(r.ids) // 4 and texts[r.doc_id]


def test_stages_bear_nulls_repeats_and_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (8, None, None, "s", None), (9, "word " * 90000, "en", None, 5)], docs.schema)
    more = odd.unionByName(odd).unionByName(docs.limit(40)).unionByName(docs.limit(40))
    for name, f in corpus_pipeline.STAGES:
        for i, rows in enumerate((more, docs.where("false"))):
            out = f(spark, rows, DATA)
            got = out.collect()
            assert (out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]) and (len(got) == 0 if i else len(got) <= more.count()), name
    kept = corpus_pipeline.near_duplicate_stage(spark, more, DATA).collect()
    assert len(kept) == len({(r.doc_id, r.text) for r in kept})


def test_run_leaves_the_last_stage_alone(spark, tmp_path):
    out = corpus_pipeline.run(spark, DATA)
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == [str(len(corpus_pipeline.STAGES) - 1)] and out.count() > 0


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls in every column, repeated rows, empty and long texts, and columns that clash with the operators' own; and the same without rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(25)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (8, None, None, "s", None), (9, "a b c d e f g h i j k " * 3000, "en", None, 5), (9, "\n \t", None, None, 1), (10, "no letters 12?!", "xx", "s", 3)], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd).withColumn("digest", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("shard", F.lit("s"))
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    turns = turns.unionByName(spark.createDataFrame([(None, 0, "user", "x"), (1, None, "user", None), (1, 5, None, "y"), (2, 1, "tool", None), (2, 1, "tool", None)], turns.schema)).withColumn("position", F.lit(1))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(None, None), (5, ""), (6, "g h i j")], bench.schema))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, None), (9, None, 0)], labels.schema))
    folders = []
    for kind in ("odd", "none"):
        d = str(tmp_path_factory.mktemp(kind))
        for name, df in (("documents", docs), ("conversations", turns), ("benchmark", bench), ("labels", labels)):
            (df if kind == "odd" else df.where("false")).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        folders.append((d, turns.count() if kind == "odd" else 0, docs.count() if kind == "odd" else 0))
    return folders


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_bears_odd_tables(spark, odd_tables, name):
    for folder, n_turns, n_docs in odd_tables:
        df = queries.queries()[name](spark, folder)
        cols = sorted(df.columns)
        rows = Counter(tuple(r[c] for c in cols) for r in df.collect())
        assert sum(rows.values()) == (n_turns if name.startswith("op10_") else n_docs)
        if name in queries.oracle_sql():
            con = duckdb.connect()
            for f in os.listdir(folder):
                con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
            rel = con.sql(queries.oracle_sql()[name])
            at = [rel.columns.index(c) for c in cols]
            assert rows == Counter(tuple(r[i] for i in at) for r in rel.fetchall()), folder
