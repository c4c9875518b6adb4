"""Named queries over the driver tables and their DuckDB counterparts.

No driver table has boxes, so layout queries use a view of `documents`: paragraphs in two
columns of twenty lines a page, with integer boxes that both engines compute alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paperlake.functions import text as T
from paperlake.operators import anchors, chunks, dispatch, evaluate, index, layout, ocr, providers, qna, reader, regions, requests, search, segments
from paperlake.plans import oracles
from paperlake.sources.shared import shared_dir

TOP = 5


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.paragraphs(_t(spark, sf_dir, "documents"))
    return s.selectExpr(
        "doc_id", "CAST(ord AS bigint) AS ord", "CAST(1 + ord div 40 AS bigint) AS page", "content", "CASE WHEN ord % 10 = 0 THEN 'Title' WHEN ord % 10 = 7 THEN 'table' WHEN ord % 10 = 9 THEN 'image_text' ELSE 'text' END AS type",
        "CAST(50 + (ord % 2) * 600 AS bigint) AS x1", "CAST(40 * ((ord div 2) % 20) AS bigint) AS y1",
        "CAST(50 + (ord % 2) * 600 + least(500, 5 * length(content)) AS bigint) AS x2", "CAST(40 * ((ord div 2) % 20) + 30 AS bigint) AS y2")


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _layout(spark, sf_dir).withColumn("image", F.expr("doc_id * 1000 + page"))
    truth = s.select("image", F.col("ord").alias("truth_id"), "type", "x1", "y1", "x2", "y2")
    found = s.where("(doc_id + ord) % 11 <> 0").withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    j = "(((doc_id * 31 + ord * 17) % 41) - 20) div IF(model = 'm1', 2, 1)"
    return truth, found.selectExpr("image", "model", "ord AS det_id", f"x1 + {j} AS x1", f"y1 + {j} AS y1", f"x2 + {j} AS x2", f"y2 + {j} AS y2")


def _outcome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth, found = _boxes(spark, sf_dir)
    return truth, found, evaluate.outcome(truth, found)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def paragraph_segments(spark, d):
    return segments.paragraphs(_t(spark, d, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), "content")


def segment_chunks(spark, d):
    return chunks.segment_chunks(_layout(spark, d), 3, ("table",))


def page_chunks(spark, d):
    return chunks.page_chunks(_layout(spark, d))


def typed_chunks_together(spark, d):
    return chunks.typed_chunks(_layout(spark, d))


def typed_chunks_separate(spark, d):
    return chunks.typed_chunks(_layout(spark, d), together=False)


def clean_replace_delimit(spark, d):
    return segments.prepare(_layout(spark, d), [("the", "THE"), ("THEr", "ther")], " |").select("doc_id", "ord", "content")


def title_merge(spark, d):
    return segments.merge_titles(_layout(spark, d), ("text",))


def bm25_stats(spark, d):
    return search.term_statistics(_t(spark, d, "documents"))


def _bm25(spark, d, k: int):
    return search.bm25_top(_t(spark, d, "documents"), _questions(spark, d), k)


def bm25_topk(spark, d):
    return _bm25(spark, d, TOP)


def bm25_filtered_topk(spark, d):
    docs = _t(spark, d, "documents")
    fetched = _bm25(spark, d, search.fetch_size(50, TOP, docs.count()))
    meta = docs.select(F.col("doc_id").alias("id"), "lang", F.create_map(F.lit("source"), "source").alias("custom_metadata"))
    kept = fetched.drop("rank").join(meta, "id").where(search.metadata_equals({"lang": "en"})).select("qid", "id", "score")
    return search.window_or_message(search.top(kept, TOP), _questions(spark, d), least=0.0)


def _vectors(spark, d, k: int, **how):
    return search.vector_top(_t(spark, d, "embeddings"), _vector_questions(spark, d), k, **how)


def vector_l2_topk(spark, d):
    return _vectors(spark, d, TOP)


def vector_normalized_topk(spark, d):
    return search.window_or_message(_vectors(spark, d, TOP, normalize=True), _vector_questions(spark, d), 0.0, 1.0)


def vector_root_topk(spark, d):
    return search.vector_top(_t(spark, d, "embeddings").where("label = 1"), _vector_questions(spark, d), TOP, root=True)


def vector_prefilter_topk(spark, d):
    fetched = _vectors(spark, d, 100, normalize=True).drop("rank")
    label = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("l"), F.col("label").cast("string"), F.lit(" all")).alias("value"))
    return search.top(fetched.join(label, "id").where(search.metadata_any_token(F.col("value"), ["l1", "l2"])).select("qid", "id", "score"), TOP, ascending=True)


def vector_roundrobin(spark, d):
    fetched = _vectors(spark, d, 100, normalize=True).drop("rank")
    label = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("value"))
    return search.round_robin(fetched.join(label, "id"), ["2", "0", "1"], TOP)


def _hybrid(spark, d):
    questions = _questions(spark, d)
    vectors = _t(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.join(F.broadcast(questions.select("qid")), F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("qvec"))
    return _bm25(spark, d, 10), search.vector_top(vectors, asked, 10, normalize=True)


def hybrid_rrf(spark, d):
    return search.rrf(list(_hybrid(spark, d)), TOP)


def hybrid_merge(spark, d):
    m = search.merge_results(*_hybrid(spark, d))
    return m.select("qid", F.array_join(F.transform("sparse_ids", lambda x: x.cast("string")), ",").alias("sparse_ids"), F.array_join(F.transform("dense_ids", lambda x: x.cast("string")), ",").alias("dense_ids"))


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def _vector_index(spark, d) -> str:
    """An index of all embeddings, a collection for each label, made in two appends."""
    root = _root(spark)
    rows = _t(spark, d, "embeddings").select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("collection"), F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"),
        F.create_map(F.lit("parity"), (F.col("vec_id") % 2).cast("string")).alias("metadata"), F.col("embedding").alias("vector"))
    half = _t(spark, d, "embeddings").agg((F.max("vec_id") / 2).alias("m")).first()["m"] or 0
    for part in (rows.where(F.col("ord") <= half), rows.where(F.col("ord") > half)):
        index.save_vectors(spark, root, part, secrets={"label-1": "open"})
    return root


def vector_index_records(spark, d):
    rows = index.get_records(spark, _vector_index(spark, d), 5, 40, include_vector=True)
    return rows.select("collection", "pos", "id", "content", F.element_at("metadata", F.lit("parity")).alias("parity"), F.col("vector_size").cast("long").alias("vector_size"), F.round(F.element_at("vector", 1), 6).alias("first"))


def vector_index_search(spark, d):
    names = _t(spark, d, "embeddings").agg(F.collect_set(F.concat(F.lit("label-"), F.col("label").cast("string"))).alias("all")).withColumn("one", F.lit(1))
    asked = _vector_questions(spark, d).withColumn("one", F.lit(1)).join(F.broadcast(names), "one").select("qid", "qvec", F.explode("all").alias("collection"))
    return index.search_vectors(spark, _vector_index(spark, d), asked, TOP, 30, {"parity": "0"}, 0.0, 1.2, secrets={"label-1": "open"})


def chunk_index_search(spark, d):
    root = _root(spark)
    rows = _t(spark, d, "documents").select(F.concat(F.lit("lang-"), F.coalesce("lang", F.lit("none"))).alias("collection"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    half = _t(spark, d, "documents").agg((F.max("doc_id") / 2).alias("m")).first()["m"] or 0
    for part in (rows.where(F.col("id") <= half), rows.where(F.col("id") > half)):
        index.save_chunks(spark, root, part)
    asked = _questions(spark, d).withColumn("collection", F.explode(F.array(F.lit("lang-en"), F.lit("lang-de"))))
    return index.search_chunks(spark, root, asked, TOP)


def column_islands(spark, d):
    return segments.column_islands(_layout(spark, d))


def segment_columns(spark, d):
    s = _layout(spark, d)
    return segments.assign_columns(s, segments.column_islands(s))


def sequence_default(spark, d):
    return segments.sequence(_layout(spark, d)).select("doc_id", "page", "ord", "sequence")


def sequence_left_right(spark, d):
    return segments.sequence(_layout(spark, d), "left-right").select("doc_id", "page", "ord", "sequence")


def sequence_zigzag(spark, d):
    return segments.sequence(_layout(spark, d), "zig-zag").select("doc_id", "page", "ord", "sequence")


def _dims(s: DataFrame) -> DataFrame:
    return s.groupBy("doc_id", "page").agg((F.max("y2") + 20).alias("height"))


def header_footer_auto(spark, d):
    s = _layout(spark, d)
    return segments.header_footer_auto(s, _dims(s)).select("doc_id", "page", "ord", "role")


def header_footer_manual(spark, d):
    s = _layout(spark, d)
    return segments.header_footer_manual(s, _dims(s), 0.2, 0.15).select("doc_id", "page", "ord", "role")


def empty_line_marks(spark, d):
    s = _layout(spark, d)
    return segments.empty_line_marks(s.withColumn("column_seq", F.col("ord") % 2)).select("doc_id", "page", "ord", "content")


def iou_match(spark, d):
    return evaluate.overlap_pairs(*_boxes(spark, d), 6)


def unmatched_truth(spark, d):
    return _outcome(spark, d)[2]


def confusion_matrix(spark, d):
    return evaluate.confusion(_outcome(spark, d)[2], ["model"])


def avg_overlap(spark, d):
    return evaluate.average_overlap(_outcome(spark, d)[2], ["model"])


def class_combo_metrics(spark, d):
    truth, _, outcome = _outcome(spark, d)
    classes = truth.select("image", "truth_id", "type", F.when(F.col("x2") - F.col("x1") > 300, "wide").otherwise("narrow").alias("width"))
    return evaluate.confusion(outcome.join(classes, ["image", "truth_id"]), ["model", "type", "width"])


def detector_report(spark, d):
    truth, _, outcome = _outcome(spark, d)
    return evaluate.class_report(outcome.join(truth.select("image", "truth_id", "type"), ["image", "truth_id"]), "type", "overlap", evaluate.FULL)


def structure_report(spark, d):
    parts = _t(spark, d, "part").select("p_brand", evaluate.accuracy_pct(F.col("p_size").cast("double") + F.col("p_partkey") % 3, F.col("p_size").cast("double")).alias("row_accuracy"))
    return evaluate.class_report(parts, "p_brand", "row_accuracy", 90.0)


def model_stats(spark, d):
    return evaluate.model_stats(*_outcome(spark, d))


def band_match(spark, d):
    """Every record of every model against every truth of its image."""
    truth, found = _boxes(spark, d)
    out = evaluate.band_match(truth, found.withColumn("rec_id", F.struct("model", "det_id")), 60)
    return out.select("image", "rec_id.model", F.col("rec_id.det_id").alias("rec_id"), "truth_id")


def truth_names(spark, d):
    return evaluate.name_tables(_boxes(spark, d)[0]).select("image", "truth_id", "table_name")


def result_merge(spark, d):
    _, found = _boxes(spark, d)
    def of(m: str, **more):
        return found.where(F.col("model") == m).select("image", F.col("det_id").alias("rec_id"), "x1", "y1", "x2", "y2", *[v.alias(k) for k, v in more.items()])
    left = of("m1", rows=F.when(F.col("det_id") % 3 == 0, F.col("x1")), note=F.lit("a"))
    return evaluate.merge_results(left, of("m2", rows=F.col("x2"), confidence=F.col("y1")), 30)


def report_rows(spark, d):
    truth, found, outcome = _outcome(spark, d)
    m = outcome.where("model = 'm2'").join(found.select("image", "model", "det_id", "y1"), ["image", "model", "det_id"], "left")
    return evaluate.report_rows(truth, m.select("image", F.col("truth_id").alias("met_id"), "status", F.when(F.col("status") != "entity-not-extracted", F.col("y1")).alias("y1")))


def _accuracies(spark, d) -> DataFrame:
    truth, found, outcome = _outcome(spark, d)
    t = truth.select("image", "truth_id", "type", (F.col("x2") - F.col("x1")).alias("tw"), (F.col("y2") % 90).alias("th"))
    f = found.select("image", "model", "det_id", (F.col("x2") - F.col("x1") - F.col("det_id") % 4).alias("fw"), (F.col("y2") % 90).alias("fh"))
    j = outcome.join(t, ["image", "truth_id"]).join(f, ["image", "model", "det_id"], "left")
    hit = F.col("status") == "match-found"
    return j.select("type", "overlap", *[F.when(hit, evaluate.accuracy_pct(F.col(a).cast("double"), F.col(b).cast("double"))).otherwise(-1.0).alias(n) for n, a, b in (("rows_ok", "fw", "tw"), ("cols_ok", "fh", "th"))])


def combined_report(spark, d):
    return evaluate.combined_report(_accuracies(spark, d), "type", "overlap", "rows_ok", "cols_ok")


def filtered_metrics(spark, d):
    truth, _, outcome = _outcome(spark, d)
    rows = outcome.join(truth.select("image", "truth_id", F.col("type").alias("class_type")), ["image", "truth_id"])
    return evaluate.confusion(evaluate.class_filter(rows, {"class_type": ["text", "Title"], "model": ["m1"]}), ["model"])


def _supplier_tables(spark, d) -> DataFrame:
    """The suppliers of every nation as an HTML table, and a copy with other cells: names in capitals now and then, balances cut, a first row that spans."""
    s = _t(spark, d, "supplier").withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    truth = F.concat(F.lit("<tr>"), cell(F.col("s_name")), cell(F.col("s_acctbal").cast("string")), F.lit("</tr>"))
    other = F.when(F.col("r") == 1, F.concat(F.lit("<tr><td colspan='2'>"), F.col("s_name"), F.lit("</td></tr>"))).when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<tr>"), cell(F.upper("s_name")), cell(F.floor("s_acctbal").cast("string")), F.lit("</tr>")))
    def table(c, n):
        return F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c.alias("h")))), lambda e: e["h"]), ""), F.lit("</table>")).alias(n)
    return s.groupBy(F.col("s_nationkey").cast("long").alias("pair_id")).agg(table(truth, "truth"), table(other, "found"))


def grid_scores(spark, d):
    return layout.table_scores(_supplier_tables(spark, d))


def grid_report(spark, d):
    scores = layout.table_scores(_supplier_tables(spark, d)).join(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pair_id"), "n_regionkey"), "pair_id")
    return evaluate.mean_report(scores, "n_regionkey", [f"{k}_{c}" for k in ("top", "con") for c in ("f", "precision", "recall", "upper")])


def table_cells(spark, d):
    return layout.table_cells(_supplier_tables(spark, d), "pair_id", "found")


def report_left_join(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left")


def report_full_outer(spark, d):
    docs, labels = _t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("Quality")), _t(spark, d, "labels")
    return evaluate.full_outer_report(docs, labels.select("doc_id", "quality", "toxic"), ["doc_id"])


def mean_scores(spark, d):
    return _t(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))


def majority_vote(spark, d):
    v = _t(spark, d, "documents").select("source", "lang", "doc_id")
    return evaluate.majority(v, ["source"], "lang", "doc_id")


def _events(spark, d):
    return _t(spark, d, "events")


def metadata_schema(spark, d):
    docs = _t(spark, d, "documents").select(F.map_from_entries(F.array(F.struct(F.concat(F.lit("lang_"), "lang").alias("k"), F.lit("1").alias("v")), F.struct(F.concat(F.lit("src_"), "source").alias("k"), F.lit("1").alias("v")))).alias("m"))
    return qna.metadata_keys(docs, "m")


def unique_metadata_keys(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.map_from_entries(F.array(F.struct(F.concat(F.lit("lang_"), "lang").alias("k"), F.lit("1").alias("v")), F.struct(F.concat(F.lit("src_"), "source").alias("k"), F.lit("1").alias("v")))).alias("m"))
    return qna.unique_metadata_keys(_bm25(spark, d, TOP).join(docs, "id"), "m", 2)


def context_assembly(spark, d):
    conv = _t(spark, d, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), F.col("turn").alias("id"), F.col("text").alias("content"))
    c = qna.contexts(conv, "[{id}] {content}\n", 3)
    return c.select("qid", "context", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def context_lists(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    docs = _t(spark, d, "documents").select("doc_id", lines.alias("l"))
    return docs.select("doc_id", F.array_join(qna.context_list(F.col("l"), 2), "~").alias("joined"), F.array_join(qna.first_contexts(F.col("l"), 3), "~").alias("first"))


def prompt_fill(spark, d):
    return _questions(spark, d).select("qid", T.fill("Context: {context}\nQuestion: {question} ({question_count})", {"context": F.lower("question"), "question": F.col("question"), "question_count": F.length("question")}).alias("prompt"))


_ANSWERS = "CASE conv_id % 4 WHEN 0 THEN concat('{\"score\": ', turn, '}') WHEN 1 THEN concat('so: ```json\n{\"score\": ', turn, '.5}\n```') WHEN 2 THEN concat('Score: ', turn) ELSE concat('I say ', turn, ' of them') END"


def llm_scores(spark, d):
    a = _t(spark, d, "conversations").select("conv_id", "turn", F.expr(_ANSWERS).alias("answer"))
    return a.select("conv_id", "turn", T.json_score(F.col("answer")).alias("json_score"), T.free_score(F.col("answer")).alias("free_score"))


def qna_blocks(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    text = F.expr("array_join(transform(sequence(0L, n), i -> concat('Type: t', i % 2, '\nQuestion: q', i, '\nAnswer: a', i, if(i % 3 = 0, '\nSource: s', ''))), '\n\n')")
    return c.select("conv_id", F.posexplode(T.qna_blocks(text)).alias("pos", "b")).select("conv_id", F.col("pos").cast("long").alias("pos"), "b.*")


def qna_numbering(spark, d):
    return qna.number_questions(_t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn"), "conv_id", "turn", "Q-", 10)


def batch_report(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.array("o_custkey").alias("keys")).alias("meta"))).alias("j"))
    return qna.report_paths(rows, "j", {"status": "$.meta.status", "customer": "$.meta.keys[0]", "missing": "$.meta.none"})


def graph_nodes_edges(spark, d):
    nations, regions_ = _t(spark, d, "nation"), _t(spark, d, "region")
    nodes = qna.graph_nodes(nations, "Nation", F.col("n_name"), {"key": F.col("n_nationkey")}).unionByName(qna.graph_nodes(regions_, "Region", F.col("r_name"), {"key": F.col("r_regionkey")}))
    edges = nations.join(regions_, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("IN").alias("type"), F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return qna.graph_statements(nodes, edges)


def request_filter(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", F.md5("url").alias("claim")).where(~F.col("url").endswith(".zip"))
    return p.withColumn("n", F.row_number().over(Window.partitionBy("claim").orderBy("page_id"))).where("n = 1").select("page_id", "url", "claim")


def region_tokens(spark, d):
    s = _layout(spark, d)
    r = s.where("ord % 8 = 0").selectExpr("ord AS region_id", "doc_id", "page", "CAST(0 AS bigint) AS x1", "y1 - 10 AS y1", "CAST(900 AS bigint) AS x2", "y2 + 40 AS y2")
    return regions.tokens_within(s, r)


def outside_tokens(spark, d):
    s = _layout(spark, d)
    r = s.where("ord % 8 = 0").selectExpr("ord AS region_id", "doc_id", "page", "CAST(0 AS bigint) AS x1", "y1 - 10 AS y1", "CAST(900 AS bigint) AS x2", "y2 + 40 AS y2")
    return regions.tokens_outside(s, r).select("doc_id", "page", "ord")


def nearest_right(spark, d):
    return regions.nearest(_layout(spark, d), "right", 0.5)


def nearest_below(spark, d):
    return regions.nearest(_layout(spark, d), "bottom")


def anchor_regions(spark, d):
    s = _layout(spark, d)
    return regions.anchor_regions(s.where("type = 'Title'"), s.where("type = 'image_text'"))


def region_subtraction(spark, d):
    s = _layout(spark, d)
    r = s.groupBy("doc_id", "page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).withColumn("region_id", F.col("page"))
    return regions.subtract(r, s.where("type = 'table'").select("doc_id", "page", "y1", "y2"))


def _results(spark, d, content) -> DataFrame:
    """One result file for each page of the layout: what `content` makes of its lines, sorted by ord."""
    s = _layout(spark, d).withColumn("content", F.regexp_replace(F.trim("content"), r"\s+", " "))
    return s.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "content", "x1", "y1", "x2", "y2"))).alias("l")).select("doc_id", "page", content.alias("content"))


_NOTE = "named_struct('doc_page_num', CAST(page AS string), 'width', 2000, 'height', 1000)"


def ocr_azure_read(spark, d):
    word = "named_struct('boundingBox', array(x.x1, x.y1, x.x2, x.y1, x.x2, x.y2, x.x1, x.y2), 'text', w, 'confidence', 0.5D)"
    line = f"named_struct('boundingBox', array(x.x1, x.y1, x.x2, x.y1, x.x2, x.y2, x.x1, x.y2), 'text', x.content, 'words', transform(split(x.content, ' '), w -> {word}))"
    return ocr.azure_read(_results(spark, d, F.expr(f"to_json(named_struct('readResults', array(named_struct('page', page, 'unit', 'pixel', 'width', 2000, 'height', 1000, 'lines', transform(l, x -> {line})))))")))


def ocr_azure_regions(spark, d):
    box = "concat_ws(',', x.x1, x.y1, x.x2 - x.x1, x.y2 - x.y1)"
    line = f"named_struct('boundingBox', {box}, 'words', transform(split(x.content, ' '), w -> named_struct('boundingBox', {box}, 'text', w)))"
    return ocr.azure_regions(_results(spark, d, F.expr(f"to_json(named_struct('regions', array(named_struct('lines', transform(l, x -> {line})))))")))


def ocr_aws_blocks(spark, d):
    block = "named_struct('BlockType', k, 'Text', x.content, 'Confidence', 90.0D, 'Geometry', named_struct('BoundingBox', named_struct('Width', (x.x2 - x.x1) / 2000D, 'Height', 0.0305D, 'Left', (x.x1 + 0.5D) / 2000D, 'Top', (x.y1 + 0.5D) / 1000D)))"
    return ocr.aws_blocks(_results(spark, d, F.expr(f"to_json(named_struct('{ocr.NOTE}', {_NOTE}, 'Blocks', flatten(transform(array('LINE', 'WORD', 'PAGE'), k -> transform(l, x -> {block})))))")))


def ocr_pdf_tokens(spark, d):
    token = "named_struct('type', if(x.ord % 5 = 0, 'image', 'line'), 'text', x.content, 'bbox', array(x.x1, x.y1, x.x2, x.y2))"
    pages = _results(spark, d, F.expr(f"to_json(named_struct('page', page, 'width', 2000, 'height', 1000, 'tokens', transform(l, x -> {token})))"))
    tokens = ocr.pdf_tokens(pages)
    return ocr.to_segments(tokens.where("page <> 3"), pages).select("doc_id", "page", "content", "x1", "y2", "conf")


def ocr_hocr(spark, d):
    box = "concat_ws(' ', x.x1, x.y1, x.x2, x.y2)"
    safe = "replace(replace(replace(x.content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    word = f"""concat("<span class='ocrx_word' id='w' title='bbox ", {box}, "; x_wconf ", x.ord % 100, "'>", w, "</span>")"""
    line = f"""concat("<span class='", if(x.ord = 0, 'ocr_header', 'ocr_line'), "' id='l' title='bbox ", {box}, "; baseline 0 0'>", array_join(transform(split({safe}, ' '), w -> {word}), ' '), "</span>")"""
    page = f"""concat("<div class='ocr_page' id='p' title='image; bbox 0 0 2000 1000; ppageno ", page - 1, "'>", array_join(transform(l, x -> {line}), '\\n'), "</div>")"""
    return ocr.hocr(_results(spark, d, F.expr(page)))


def word_links(spark, d):
    s = _layout(spark, d)
    links = s.where("ord % 4 = 1").selectExpr("doc_id", "page", "ord AS link_id", "concat('u', ord) AS uri", "x1 - 10 AS x1", "y1 - 20 AS y1", "x1 + 150 AS x2", "y2 + 60 AS y2")
    return ocr.link_words(s, links)


def _cells(spark, d) -> DataFrame:
    """Lines as words of tables: one table for each eight lines."""
    return ocr.rows_to_cells(_layout(spark, d).selectExpr("doc_id", "page", "ord div 8 AS table_no", "if(ord % 8 = 4, ' ', substring_index(trim(content), ' ', 1)) AS text", "x1", "y1"))


def word_cells(spark, d):
    return _cells(spark, d)


def picked_cells(spark, d):
    return ocr.pick_cells(_cells(spark, d), rows=[(0, 1), (3, 9)], columns=[(0, 0), (1, 3)]).select("doc_id", "page", "table_no", "row_index", "column_index", "text")


def table_header_names(spark, d):
    return ocr.header_names(_cells(spark, d).withColumn("text", F.when(F.col("column_index") == 0, "").otherwise(F.lit("same"))))


def y_clusters(spark, d):
    return ocr.clusters(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 20000.0).select("o_orderkey", "cluster")


def word_lines(spark, d):
    return ocr.line_groups(_layout(spark, d))


def distinct_segments(spark, d):
    return ocr.distinct_text(_layout(spark, d)).select("doc_id", "page", "ord")


def sized_boxes(spark, d):
    return ocr.sized(_layout(spark, d), min_w=40, max_w=450, min_h=30, max_h=30, aspect=(2.0, 12.0)).select("doc_id", "page", "ord")


def _tokens(spark, d) -> DataFrame:
    return _layout(spark, d).select("doc_id", "page", "ord", F.trim("content").alias("text"), "x1", "y1", "x2", "y2")


def _sizes(spark, d) -> DataFrame:
    return _layout(spark, d).select("doc_id", "page").distinct().withColumn("width", F.lit(1200.0)).withColumn("height", F.lit(820.0))


def anchor_similarity(spark, d):
    return _tokens(spark, d).where(anchors.matches("the license", F.col("text"), "normal", 0.9)).select("doc_id", "page", "ord")


def anchor_pattern(spark, d):
    return anchors.find_anchors(_tokens(spark, d), ["^the .*[.]$", ["^[a-m]", "[aeiou][.]?$"]], "regex")


def one_anchor_boxes(spark, d):
    found = _layout(spark, d).where("type = 'Title'")
    return anchors.one_anchor_regions(found, _sizes(spark, d), {"left": "-10px", "bottom": "1t"}, {"right": "50%r", "bottom": "25%a"})


def two_anchor_boxes(spark, d):
    s = _layout(spark, d)
    out = anchors.two_anchor_regions(s.where("type = 'Title'"), s.where("type = 'image_text' AND ord % 20 = 19"), _sizes(spark, d))
    return out.select("doc_id", "page", "x1", "y1", "x2", "y2")


def attribute_values(spark, d):
    return anchors.extract_attributes(_tokens(spark, d), _sizes(spark, d), {
        "license": {"anchor": ["license"], "match": "regex", "first": {"left": 0, "top": "-60px"}, "second": {"right": "100%r", "bottom": "60px"}},
        "second the": {"anchor": ["^the "], "match": "regex", "occurrences": [2], "first": {"left": 0, "top": 0}, "second": {"right": 0, "bottom": "2t"}}})


def nearest_hops(spark, d):
    return anchors.nearest_chain(_layout(spark, d), "bottom", 3)


def nearest_fields(spark, d):
    s = _layout(spark, d)
    f = s.where("type = 'table'").select("doc_id", "page", F.col("ord").alias("field_id"), "x1", "y1", "x2", "y2")
    out = [anchors.nearest_field(s.where("type <> 'table'"), f, side).withColumn("side", F.lit(side)) for side in ("any", "right", "bottom")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _echo(prompts: list[str]) -> list[str]:
    """A provider without a model: the number of characters of the prompt as JSON, in a fence for odd ones, and its first question's source."""
    out = []
    for p in prompts:
        source = p.split("[", 1)[1].split("]", 1)[0] if "[" in p else ""
        body = '{"answer": "%d", "sources": [{"chunk_id": "%s"}]}' % (len(p), source)
        out.append("see\n```json\n" + body + "\n```" if len(p) % 2 else body)
    return out


def _turns(spark, d) -> DataFrame:
    """Turns as matches of their conversation: (qid, id, rank, score, content)."""
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), (F.col("turn") + 1).alias("rank"), (F.col("turn") / 10).alias("score"), F.col("text").alias("content"))


def reader_answers(spark, d):
    q = _t(spark, d, "conversations").select(F.col("conv_id").alias("qid")).distinct().select("qid", F.concat(F.lit("k"), "qid").alias("attribute_key"), F.concat(F.lit("what of "), "qid").alias("question"))
    return reader.read(q, _turns(spark, d), _echo, "{context}Q: {question}", "[{id}] {content}\n", 2, as_json=True, attempts=2).drop("prompt")


def picked_lists(spark, d):
    m = _turns(spark, d)
    lists = {"sparseindex": m, "vectordb": m.where("qid % 2 = 0 AND id < 3"), "rrf": m.where("qid % 3 = 0 AND id = 0")}
    return reader.pick_lists(lists).select("qid", "source", "id", "rank")


def moderated_answers(spark, d):
    prompts = _t(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("prompt"))
    return reader.answer(prompts, _echo, banned=["license", "reserved"]).select("qid", "answer", "status", "tries")


def hashed_embeddings(spark, d):
    e = _t(spark, d, "documents").select("doc_id", reader.hashed_embedding(F.col("text"), 8).alias("v"))
    return e.select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("slots"))


def rewritten_queries(spark, d):
    c = _t(spark, d, "conversations")
    q = c.where("role = 'user'").select(F.col("conv_id").alias("attribute_key"), F.concat(F.lit("turn "), "turn").alias("question"))
    r = c.where("role = 'assistant'").select(F.col("conv_id").alias("attribute_key"), F.col("turn").alias("ord"), F.when(F.col("conv_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("again "), "turn")).alias("question"))
    return reader.with_rewritten(q, r)


def reader_inputs(spark, d):
    docs = _t(spark, d, "documents").select(F.col("lang").alias("attribute_key"), "doc_id")
    return reader.with_inputs(docs, spark.createDataFrame([("en", "what"), ("de", "was"), ("xx", "?")], "attribute_key string, question string"))


def zipped_answers(spark, d):
    return reader.zip_rows(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def page_margins(spark, d):
    s = _layout(spark, d)
    with_roles = segments.header_footer_auto(s, _dims(s))
    return reader.with_margins(s.select("doc_id", "page").distinct(), with_roles)


def first_majorities(spark, d):
    v = _t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return reader.first_majority(v, ["o_custkey"], "o_orderpriority", "o_orderkey")


def _length_class(prompts: list[str]) -> list[str]:
    return [("" if len(p) % 7 == 0 else "odd" if len(p) % 2 else "even") + ("" if p.startswith("size") or len(p) % 7 == 0 else " too") for p in prompts]


def document_metadata(spark, d):
    pages = chunks.page_chunks(_layout(spark, d))
    out = reader.document_metadata(pages.select("doc_id", "page", "content"), {"size": "size?", "kind": "kind of text?"}, _length_class, pages.select("doc_id", "chunk_id"))
    return out.select("doc_id", "chunk_id", F.element_at("custom_metadata", F.lit("size")).alias("size"), F.element_at("custom_metadata", F.lit("kind")).alias("kind"))


def _asks(prompts: list[str]) -> list[str]:
    """Two questions about a prompt's length, or its number for the second stage."""
    return [str(len(p)) if p.startswith("answer") else f"Type: long\nQuestion: how long?\nAnswer: {len(p)}\nSource: s\n\nType: even\nQuestion: even?\nAnswer: {len(p) % 2 == 0}" for p in prompts]


def generated_questions(spark, d):
    docs = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return reader.generate_questions(docs, _asks, "{context} {question_count}", second="answer {question} of {context}", count=2)


def _grades(prompts: list[str]) -> list[str]:
    return ['{"score": %d, "reasons": "%s"}' % (len(p) % 5, p[:4]) if len(p) % 3 else "none" for p in prompts]


def generated_scores(spark, d):
    rows = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("yes").alias("answer"), F.lit(None).cast("string").alias("context"))
    return reader.prompt_scores(rows, {"relevance": "rel {question} {answer}", "coverage": "cov {question}{context}"}, _grades)


def overlap_scores(spark, d):
    c = _t(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("answer"))
    rows = u.join(a, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "question", "answer", F.array("question", F.lit("the license")).alias("contexts"), F.when(F.col("turn") > 0, F.col("question")).alias("ground_truth"))
    return reader.overlap_scores(rows)


def score_means(spark, d):
    rows = _t(spark, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("size"), F.lit(float("nan")).alias("none"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("price"))
    return reader.mean_of(rows, ["size", "none", "price"])


def numbered_answers(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    t = F.expr("array_join(transform(sequence(0L, n), i -> concat('Q', i, ': what is ', i, '?\nType: t', i % 2, '\nAnswer: a', i)), '\n\n')")
    return c.select("conv_id", F.posexplode(reader.numbered_blocks(t)).alias("pos", "b")).select("conv_id", F.col("pos").cast("long").alias("pos"), "b.*")


def context_answers(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    t = F.expr("array_join(transform(sequence(0L, n), i -> concat('Sub context: c', i, '\nType: t', i % 2, if(i % 4 = 3, '', concat('\nQuestion: q', i)), '\nAnswer: a', i)), '\n\n')")
    return c.select("conv_id", F.posexplode(reader.context_blocks(t)).alias("pos", "b")).select("conv_id", F.col("pos").cast("long").alias("pos"), "b.*")


def evaluation_dataset(spark, d):
    raw = _t(spark, d, "benchmark").select(F.to_json(F.struct(F.col("text").alias("question"), F.array("text", F.lit("x")).alias("contexts"), F.when(F.col("item_id") % 2 == 0, F.lit("t")).alias("ground_truth"), F.col("item_id").alias("extra"))).alias("value"))
    return reader.load_dataset(raw).select("question", F.array_join("contexts", "|").alias("contexts"), "ground_truth", "answer", "additional_data")


def piece_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", ocr.approximate_tokens(F.col("text")).cast("long").alias("pieces"))


def _generated(spark, d) -> DataFrame:
    """Documents as files of three kinds by id, through generators of lines, of tables and of text."""
    kinds = F.element_at(F.array(F.lit(".pdf"), F.lit(".TXT"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = _t(spark, d, "documents").select("doc_id", kinds.alias("extension"))
    s = _layout(spark, d)
    def of(where: str):
        return lambda x: s.where(where).join(x.select("doc_id"), "doc_id", "left_semi")
    steps = [{"enabled": True, "input_file_type": "pdf", "text_provider": "pdf_tokens"}, {"enabled": True, "input_file_type": "pdf", "text_provider": "table_contents"},
             {"enabled": True, "input_file_type": "image", "text_provider": "azure"}, {"enabled": False, "input_file_type": "json"}, {"enabled": True, "input_file_type": "txt"}]
    return dispatch.generate(docs, steps, {"native_pdf": of("ord % 2 = 0"), "pdf_table_extraction": of("type = 'table' OR ord % 4 = 0"), "ocr_based": of("true"), "text": of("true")})


def generated_segments(spark, d):
    return _generated(spark, d).select("doc_id", "page", "ord", "technique", "type")


def consolidated_segments(spark, d):
    return dispatch.consolidate(_generated(spark, d)).select("doc_id", "page", "type", "content", "x1", "y1")


def classified_segments(spark, d):
    s = _layout(spark, d)
    return dispatch.classify(s, _dims(s), {"header": {"manual": {"enabled": True, "share": 0.2}}, "footer": {"manual": {"enabled": True, "share": 0.15}}}).select("doc_id", "page", "ord", "role")


def sequence_zigzag_dynamic(spark, d):
    return dispatch.zigzag_dynamic(_layout(spark, d)).select("doc_id", "page", "ord", "sequence")


def sequence_by_layout(spark, d):
    s = _layout(spark, d)
    return dispatch.sequence_by_layout(s, segments.column_islands(s), {"single-column": {"left-right": {"enabled": True}}}).select("doc_id", "page", "ord", "layout", "sequence")


def configured_chunks(spark, d):
    config = {"exclude": ["image_text"], "replace": [{"find": "the", "replace": "THE"}], "delimiter": ";", "methods": {"page": {"enabled": True}, "segment": {"enabled": True}, "page_character": {"enabled": False}, "page_and_segment_type": {"enabled": True, "together": False}}}
    return dispatch.make_chunks(_layout(spark, d), config)


def updated_rows(spark, d):
    s = _layout(spark, d).select("doc_id", "page", "ord", F.struct("type", "content").alias("data"), "x1", "y1", "x2", "y2")
    out = dispatch.update_documents(s, [{"boxes": ""}, {"rename": "ord", "to": "number"}, {"set": "data.type", "value": "any"}, {"set": "source", "value": "layout"}])
    return out.select("doc_id", "page", "number", F.col("data.type").alias("type"), "x", "y", "w", "h", "source")


def scaled_boxes(spark, d):
    pages = _layout(spark, d).select("doc_id", "page").distinct().where("page < 3").selectExpr("doc_id", "page", "1200 AS width", "820 AS height", "2400 AS image_width", "1025 AS image_height")
    return dispatch.scale_to_image(_layout(spark, d), pages).select("doc_id", "page", "ord", "x1", "y1", "x2", "y2")


def planned_requests(spark, d):
    p = _t(spark, d, "pages")
    listed = p.unionByName(p).select(F.col("url").alias("path"), F.element_at(F.split("url", "/"), -1).alias("filename"), F.lit("html").alias("extension"), F.md5("url").alias("claim"))
    return requests.plan_requests(listed, "G-1", "/work", requests.mode({"inference": {"enabled": False}, "evaluation": {"enabled": True}, "report": {"enabled": True}}))


def request_rounds(spark, d):
    """Two rounds of requests over the same files, the first of which is closed: (round, state, requests)."""
    root = _root(spark)
    p = _t(spark, d, "pages")
    listed = p.select(F.col("url").alias("path"), F.element_at(F.split("url", "/"), -1).alias("filename"), F.lit("html").alias("extension"), F.md5("url").alias("claim"))
    counts = [requests.create_requests(spark, listed.where(part), root, g, "/work", {"inference": {"enabled": True}}).count() for g, part in (("G-1", "claim < '8'"), ("G-2", "true"), ("G-3", "true"))]
    taken = requests.take_group(spark, root)
    requests.close_group(spark, root, "G-1", taken.select("document_id", "path"), f"{root}/out")
    again = requests.create_requests(spark, listed, root, "G-4", "/work", {"inference": {"enabled": True}}).count()
    saved = spark.read.text(f"{root}/out/G-1").count()
    n = spark.createDataFrame([("G-1", counts[0]), ("G-2", counts[1]), ("G-4", again)], "group_id string, requests long")
    return requests.states(spark, root).join(n, "group_id").withColumn("saved", F.when(F.col("state") == "closed", F.lit(saved).cast("long")))


def filled_metadata(spark, d):
    docs = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 2 == 0, F.lit("given")).alias("title"))
    return requests.with_metadata(docs).select("page_id", "filename", "filetype", "title")


def recognised_tokens(spark, d):
    """Conversation turns typed as pages, through the stand-in engine and the parser of its format."""
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("image"))
    return providers.recognise(pages, "image")


def converted_pages(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\f").alias("content"))
    return providers.convert_pages(docs, "content").select("doc_id", "page", "text")


def _images(spark, d) -> DataFrame:
    """Embeddings as images of rows of eight grey values."""
    grey = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 600))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(grey, i * 8 + 1, 8))
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("image"), rows.alias("pixels"))


def mark_states(spark, d):
    boxes = _t(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id")).selectExpr(
        "image", "CAST(box_id AS bigint) AS box_id", "4 * (box_id % 2) AS x1", "4 * (box_id div 2) AS y1", "4 * (box_id % 2) + 4 AS x2", "4 * (box_id div 2) + 4 AS y2")
    return providers.box_states(_images(spark, d), boxes)


def detected_tables(spark, d):
    return providers.detect_tables(_images(spark, d).withColumn("pixels", F.transform("pixels", lambda r: F.transform(r, lambda v: v * 4))), "pixels")


def key_values(spark, d):
    t = _tokens(spark, d).withColumn("text", F.concat(F.lit("w"), (F.col("ord") % 7).cast("string")))
    return providers.field_values(t, {"three": "w3", "five": "w5"})


def ruled_table_cells(spark, d):
    s = _layout(spark, d)
    lines = s.select("doc_id", "page", F.lit(False).alias("upright"), F.col("y1").cast("double").alias("at")).unionByName(s.select("doc_id", "page", F.lit(True).alias("upright"), (F.col("x1") + F.col("ord") % 3).cast("double").alias("at")))
    return providers.ruled_cells(lines.distinct(), 5)


def unruled_table_cells(spark, d):
    return providers.unruled_cells(_layout(spark, d))


def aggregated_detections(spark, d):
    files_ = _t(spark, d, "part").select(F.to_json(F.struct(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("image"), F.lit("m").alias("model_name"), F.array(F.array(F.lit(0.0), F.lit(1.0), F.col("p_size").cast("double"), F.lit(9.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("bboxes"), F.array(F.lit(0.5), F.lit(0.25)).alias("confidences"))).alias("value"))
    return providers.aggregate_detections(files_)


def event_dates(spark, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return _events(spark, d).select("event_id", providers.file_date(millis).alias("stamp"), providers.file_date(millis, "yyyyMMdd").alias("day"))


def updated_json(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key"), F.lit("x").alias("note")).alias("meta"))).alias("j"))
    out = qna.update_paths(rows, "j", {"status": F.lit("new"), "meta.note": F.col("o_orderkey"), "added": F.lit(True)})
    return qna.report_paths(out, "j", {"status": "$.status", "key": "$.meta.key", "note": "$.meta.note", "added": "$.added"})


def prefix_meta(spark, d):
    keys = _layout(spark, d).select("doc_id", "ord").withColumn("chunk_key", F.concat_ws("_", F.lit("page_char"), F.col("ord").cast("string")))
    metas = _t(spark, d, "region").select(F.concat(F.lit("page_char_"), (F.col("r_regionkey") + 1).cast("string")).alias("seq_no"), "r_name")
    return qna.with_chunk_meta(keys, metas, prefix=True).select("doc_id", "ord", "seq_no", "r_name")


def consolidated_questions(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("question"), F.array("turn", F.col("turn") + 1).alias("pages"), F.lit(0).alias("id"))
    return qna.consolidate_questions(rows, {"question": "Question"}, "N", 5, 4)


def compared_runs(spark, d):
    labels, parts = _t(spark, d, "labels"), _t(spark, d, "part")
    return qna.compare_runs({"first": labels.select(F.col("quality").alias("a"), F.col("toxic").alias("b")), "second": parts.select(F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))}, ["a", "b"])


def searched_answers(spark, d):
    chunks_ = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("content"))
    q = _questions(spark, d)
    return reader.semantic_search(q, chunks_, *_hybrid(spark, d), _echo, "{context}Q: {question}", 2, as_json=True)


def overlap_dedup(spark, d):
    s = _layout(spark, d).withColumn("y2", F.col("y2") + (F.col("ord") % 3) * 10)
    return layout.drop_overlaps(s)


def overlap_dedup_in_order(spark, d):
    s = _layout(spark, d).withColumn("y2", F.col("y2") + (F.col("ord") % 3) * 10)
    return layout.drop_overlaps(s, by_type=False).select("doc_id", "page", "ord")


def larger_segments(spark, d):
    s = _layout(spark, d).withColumn("y2", F.col("y2") + (F.col("ord") % 3) * 10)
    return layout.prefer_larger(s).select("doc_id", "page", "ord")


def adjacent_merge(spark, d):
    return layout.merge_adjacent(_layout(spark, d), 12, 30)


def _words(spark, d) -> DataFrame:
    """Two rows of twenty words a page, some of them narrow, some a little lower."""
    return _layout(spark, d).selectExpr("doc_id", "page", "ord", "content", "60 * (ord % 20) AS x1", "50 * ((ord div 20) % 2) + ord % 3 * 6 AS y1", "60 * (ord % 20) + if(ord % 5 = 0, 5, 50) AS x2", "50 * ((ord div 20) % 2) + ord % 3 * 6 + 30 AS y2")


def phrase_build(spark, d):
    w = _words(spark, d)
    return layout.phrases(w)


def phrase_build_diagonal(spark, d):
    w = _words(spark, d)
    return layout.phrases(w, diagonal=True)


def character_chunks(spark, d):
    return chunks.character_chunks(chunks.page_chunks(_layout(spark, d)), 500)


def greedy_match(spark, d):
    return evaluate.greedy_matches(*_boxes(spark, d))


_ALL = [
    paragraph_segments, segment_chunks, page_chunks, typed_chunks_together, typed_chunks_separate, clean_replace_delimit, title_merge, bm25_stats, bm25_topk, bm25_filtered_topk,
    vector_l2_topk, vector_normalized_topk, vector_root_topk, vector_prefilter_topk, vector_roundrobin, hybrid_rrf, hybrid_merge, vector_index_records, vector_index_search, chunk_index_search, column_islands, segment_columns, sequence_default,
    sequence_left_right, sequence_zigzag, header_footer_auto, header_footer_manual, empty_line_marks, iou_match, unmatched_truth, confusion_matrix, avg_overlap, class_combo_metrics,
    detector_report, structure_report, model_stats, band_match, truth_names, result_merge, report_rows, combined_report, filtered_metrics, grid_report, table_cells, report_left_join, report_full_outer, mean_scores, majority_vote, metadata_schema, unique_metadata_keys, context_assembly,
    context_lists, prompt_fill, llm_scores, qna_blocks, qna_numbering, batch_report, graph_nodes_edges, request_filter, region_tokens, outside_tokens, nearest_right, nearest_below,
    anchor_regions, region_subtraction, ocr_azure_read, ocr_azure_regions, ocr_aws_blocks, ocr_pdf_tokens, ocr_hocr, word_links, word_cells, picked_cells, table_header_names, y_clusters, word_lines, distinct_segments, sized_boxes,
    reader_answers, picked_lists, moderated_answers, hashed_embeddings, rewritten_queries, reader_inputs, zipped_answers, page_margins, first_majorities, document_metadata, generated_questions, generated_scores, overlap_scores, score_means,
    numbered_answers, context_answers, evaluation_dataset, piece_counts, generated_segments, consolidated_segments, classified_segments, sequence_zigzag_dynamic, sequence_by_layout, configured_chunks, updated_rows, scaled_boxes, planned_requests, request_rounds, filled_metadata, prefix_meta, consolidated_questions, compared_runs, searched_answers, recognised_tokens, converted_pages, mark_states, detected_tables, key_values, ruled_table_cells, unruled_table_cells, aggregated_detections, event_dates, updated_json, anchor_similarity, anchor_pattern, one_anchor_boxes, two_anchor_boxes, attribute_values, nearest_hops, nearest_fields,
    overlap_dedup, overlap_dedup_in_order, larger_segments, adjacent_merge, phrase_build, phrase_build_diagonal, character_chunks, greedy_match, grid_scores,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and vector ranks of every benchmark question, fused."""
    return hybrid_rrf(spark, sf_dir)
