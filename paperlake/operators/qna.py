"""Contexts, prompts, metadata keys and questions around a model provider; graph rows and batch reports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions import text as T


def contexts(matches: DataFrame, template: str, k: int) -> DataFrame:
    """(qid, context, chunk_ids): the k first matches of each question (qid, rank, id, content) in a template of {content} and {id}, joined in order."""
    if k <= 0:
        raise ValueError(f"k: {k}")
    rows = matches.where(F.col("rank") <= k).withColumn("part", T.fill(template, {"content": F.col("content"), "id": F.col("id")}))
    g = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "id"))).alias("l"))  # k rows each
    return g.select("qid", F.array_join(F.transform("l", lambda e: e["part"]), "").alias("context"), F.transform("l", lambda e: e["id"]).alias("chunk_ids"))


def context_list(parts: Column, k: int) -> Column:
    """The first k joined by a full stop, then the rest one by one."""
    if k <= 0:
        raise ValueError(f"k: {k}")
    return F.concat(F.array(F.array_join(F.slice(parts, 1, k), ".")), F.slice(parts, k + 1, F.greatest(F.lit(0), F.size(parts) - k)))


def first_contexts(parts: Column, n: int) -> Column:
    """The first n, all for -1."""
    return parts if n == -1 else F.slice(parts, 1, n)


def complete(prompts: DataFrame, provider: Callable[[list[str]], list[str]], cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """prompts (qid, prompt) with `answer` from a provider of lists; prompts whose SHA-1 is in cache (key, answer) are not asked, and equal ones are asked once."""
    keyed = prompts.withColumn("key", F.sha1("prompt"))
    asked = keyed.select("key", "prompt").dropDuplicates(["key"])
    if cache is not None:
        asked = asked.join(cache.select("key"), "key", "left_anti")

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"key": part["key"], "answer": provider(part["prompt"].tolist())})

    answers = asked.mapInPandas(run, "key string, answer string")
    if cache is not None:
        answers = answers.unionByName(cache.select("key", "answer"))
    return keyed.join(answers, "key", "left").drop("key")


def metadata_keys(rows: DataFrame, map_col: str) -> DataFrame:
    """(key, n) over all rows' maps."""
    return rows.select(F.explode(F.map_keys(map_col)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def unique_metadata_keys(matches: DataFrame, map_col: str, k: int) -> DataFrame:
    """(qid, key): keys that fewer than k of a question's matches have."""
    return matches.select("qid", F.explode(F.map_keys(map_col)).alias("key")).groupBy("qid", "key").agg(F.count("*").alias("n")).where(F.col("n") < k).select("qid", "key")


def number_questions(rows: DataFrame, key: str, order: str, prefix: str, last: int = 0, width: int = 3) -> DataFrame:
    """Rows with q_no: per key, prefix and a zero-padded number that goes on from `last`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) + last
    return rows.withColumn("q_no", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))


def graph_nodes(rows: DataFrame, label: str, name: Column, properties: dict[str, Column]) -> DataFrame:
    return rows.select(F.lit(label).alias("label"), name.cast("string").alias("name"), F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]).alias("properties")).where("name IS NOT NULL")


def graph_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One statement for each node (label, name, properties) and for each edge (type, source, target) whose ends are nodes."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    props = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit(": '"), esc(e["value"]), F.lit("'"))), ", ")
    made = nodes.select(F.concat(F.lit("MERGE (n:"), "label", F.lit(" {name: '"), esc(F.col("name")), F.lit("'}) SET n += {"), props, F.lit("}")).alias("statement"))
    a = nodes.select(F.col("name").alias("source"), F.col("label").alias("a_label"))
    b = nodes.select(F.col("name").alias("target"), F.col("label").alias("b_label"))
    linked = edges.join(a, "source").join(b, "target").select(
        F.concat(F.lit("MATCH (a:"), "a_label", F.lit(" {name: '"), esc(F.col("source")), F.lit("'}), (b:"), "b_label", F.lit(" {name: '"), esc(F.col("target")), F.lit("'}) MERGE (a)-[:"), "type", F.lit("]->(b)")).alias("statement"))
    return made.unionByName(linked)


def report_paths(rows: DataFrame, json_col: str, mapping: dict[str, str]) -> DataFrame:
    """One column for each JSON path of the mapping, null where a row lacks it."""
    return rows.select(*[c for c in rows.columns if c != json_col], *[F.get_json_object(json_col, p).alias(n) for n, p in mapping.items()])


def run_statements(statements: DataFrame, execute: Callable[[str], None]) -> DataFrame:
    """(key, statement) -> (key, error): each statement through an executor of the partition it is in; error is null where it went through."""
    def run(batches):
        for pdf in batches:
            errors = []
            for s in pdf["statement"]:
                try:
                    execute(s)
                    errors.append(None)
                except Exception as e:  # what fails is reported by key, and the rest goes on
                    errors.append(str(e))
            yield pd.DataFrame({"key": pdf["key"], "error": errors})

    return statements.select("key", "statement").mapInPandas(run, "key string, error string")


def update_paths(rows: DataFrame, json_col: str, values: dict[str, Column]) -> DataFrame:
    """Rows whose JSON has the values at top-level keys or `a.b` paths of objects; what is there else stays. Text that is no object becomes one."""
    tree: dict = {}
    for path, v in values.items():
        head, _, rest = path.partition(".")
        tree.setdefault(head, {})[rest] = v

    def merged(text: Column, level: dict) -> Column:
        have = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
        fresh = []
        for head, below in level.items():
            inner = F.get_json_object(text, f"$.{head}")
            value = F.to_json(F.struct(below[""].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(below[""].alias("v")))) - 6) if "" in below else merged(inner, {k: {"": v} for k, v in below.items()})
            fresh += [F.lit(head), value]
        kept = F.map_filter(have, lambda k, v: ~k.isin(*level))
        raw = F.transform(F.map_keys(kept), lambda k: F.struct(k.alias("k"), F.regexp_replace(F.to_json(F.create_map(k, F.element_at(kept, k))), r"^\{", "").alias("t")))
        old = F.transform(raw, lambda e: F.substring(e["t"], F.lit(1), F.length(e["t"]) - 1))
        new = F.array(*[F.concat(F.to_json(F.array(fresh[i])).substr(F.lit(2), F.length(F.to_json(F.array(fresh[i]))) - 2), F.lit(":"), fresh[i + 1]) for i in range(0, len(fresh), 2)])
        return F.concat(F.lit("{"), F.array_join(F.concat(old, new), ","), F.lit("}"))

    return rows.withColumn(json_col, merged(F.col(json_col), tree))


def with_chunk_meta(chunks: DataFrame, metas: DataFrame, prefix: bool = False) -> DataFrame:
    """Chunks (chunk_key, …) with the metadata rows of their key (seq_no); with prefix, of every key that theirs starts with, so `1_page_char_10` meets `1_page_char_1` as well."""
    if not prefix:
        return chunks.join(metas, F.col("chunk_key") == F.col("seq_no"))
    starts = F.transform(F.sequence(F.lit(1), F.length("chunk_key")), lambda i: F.substring("chunk_key", F.lit(1), i))
    return chunks.where("chunk_key <> ''").withColumn("__start", F.explode(starts)).join(metas, F.col("__start") == F.col("seq_no")).drop("__start")


def consolidate_questions(rows: DataFrame, mapping: dict[str, str], prefix: str = "Q", last: int = 0, width: int = 3, order: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """Generated questions of all documents under one numbering that goes on from `last` in each document: columns renamed by mapping, a list of pages as `1, 2` text."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) + last
    q = rows.withColumn("Q_No", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")
    return q.select("doc_id", "Q_No", pages.alias("pages"), *[F.col(a).alias(b) for a, b in mapping.items()])


def compare_runs(runs: dict[str, DataFrame], values: list[str]) -> DataFrame:
    """(run, values): the means of each run, side by side in rows."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(*[F.round(F.avg(v), 6).alias(v) for v in values]).select(F.lit(name).alias("run"), *values) for name, df in runs.items()])
