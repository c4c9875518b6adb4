"""Indexes, requests, readers, providers, configured steps and anchors: errors, empty tables, and what queries do not show."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperlake.operators import anchors, chunks, dispatch, index, layout, ocr, providers, qna, reader, requests, search
from paperlake.sources import files
from paperlake.streaming import ingest

SEG = "doc_id long, page long, ord long, type string, content string, x1 long, y1 long, x2 long, y2 long"


def _seg(spark, rows):
    return spark.createDataFrame(rows, SEG)


def test_numbered_is_gapless_per_key(spark):
    d = spark.range(5000).selectExpr("id % 3 AS k", "5000 - id AS o").repartition(7)
    rows = index.numbered(d, ["k"], ["o"]).collect()
    for k in range(3):
        mine = sorted((r.o, r.pos) for r in rows if r.k == k)
        assert [p for _, p in mine] == list(range(len(mine)))
    assert index.numbered(d.where("false"), ["k"], ["o"]).count() == 0


def test_index_life_cycle(spark, tmp_path):
    root = "file://" + str(tmp_path / "index")
    rows = spark.createDataFrame([("a", i, f"r{i}", f"text {i}", {"k": str(i % 2)}, [float(i), 1.0]) for i in range(6)] + [("b", 0, "x", "t", {}, [0.0, 0.0]), ("b", 1, "y", "t", {}, None)],
                                 "collection string, ord long, id string, content string, metadata map<string,string>, vector array<double>")
    index.save_vectors(spark, root, rows, secrets={"b": "s"})
    index.save_vectors(spark, root, rows.where("collection = 'a' AND ord < 2"))
    got = {(r.collection, r.pos): r.id for r in index.get_records(spark, root).collect()}
    assert [got["a", p] for p in range(8)] == ["r0", "r1", "r2", "r3", "r4", "r5", "r0", "r1"] and got["b", 0] == "x" and len(got) == 9
    assert {r.pos for r in index.get_records(spark, root, 2, 4, collection="a").collect()} == {2, 3}
    assert sorted(r.key for r in index.custom_metadata_keys(spark, root).collect()) == ["k"]
    q = spark.createDataFrame([(1, "a", [5.0, 1.0])], "qid long, collection string, qvec array<double>")
    best = index.search_vectors(spark, root, q, 2, metadata={"k": "1"}).orderBy("rank").collect()
    assert [r.id for r in best] == ["r5", "r3"]
    assert index.search_vectors(spark, root, q, 2, least=5.0).first().message == "no match"
    index.export(spark, root, str(tmp_path / "dump"), 0, 1)
    assert spark.read.json(str(tmp_path / "dump")).count() == 2
    for wrong in (None, "t"):
        with pytest.raises(ValueError):
            index.delete_collection(spark, root, "b", wrong)
    index.delete_collection(spark, root, "b", "s")
    assert index.get_records(spark, root).where("collection = 'b'").count() == 0
    assert index.index_id("docs", "G-12-ab") == "docs-ab"
    assert index.get_records(spark, root + "-none").count() == 0


def test_postings_grow_by_appending(spark, tmp_path):
    root = "file://" + str(tmp_path / "index")
    rows = spark.createDataFrame([("c", 1, "alpha beta"), ("c", 2, "alpha alpha"), ("c", 3, None), ("c", 4, "gamma")], "collection string, id long, content string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    index.save_chunks(spark, root, rows.where("id < 3"))
    index.save_chunks(spark, root, rows.where("id >= 3"))
    q = spark.createDataFrame([(7, "c", "alpha"), (8, "c", "none such")], "qid long, collection string, question string")
    got = index.search_chunks(spark, root, q, 5).orderBy("rank").collect()
    want = search.bm25_top(rows.withColumnRenamed("content", "text"), q.select("qid", "question"), 5, "id").orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(r.qid, r.id, r.score) for r in want] and [r.id for r in got] == [2, 1]


def test_an_id_that_is_appended_again_is_one_document(spark, tmp_path):
    import duckdb

    from paperlake.plans import oracles

    root, texts = "file://" + str(tmp_path / "index"), [(1, "alpha beta"), (2, "beta beta beta"), (3, "the alpha"), (1, "Alpha gamma")]
    rows = spark.createDataFrame(texts, "id long, content string").selectExpr("'lang-en' AS collection", "*", "CAST(map() AS map<string,string>) AS metadata")
    for part in (rows.where("content <> 'Alpha gamma'"), rows.where("content = 'Alpha gamma'")):
        index.save_chunks(spark, root, part)
    q = spark.createDataFrame([(7, "lang-en", "alpha"), (8, "lang-en", "beta gamma")], "qid long, collection string, question string")
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT doc_id, text, 'en' AS lang FROM (VALUES {', '.join(map(str, texts))}) AS v(doc_id, text)")
    con.sql("CREATE TABLE benchmark AS SELECT * FROM (VALUES (7, 'alpha'), (8, 'beta gamma')) AS v(item_id, text)")
    got = index.search_chunks(spark, root, q, 5).select("collection", "qid", "id", "score", "rank").collect()
    want = con.sql(oracles.SQL["chunk_index_search"])
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 4


def test_terms_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, "beta Alpha beta the BETA a"), (2, None), (3, "zz"), (4, "")], "id long, text string")
    got = search.term_counts(rows)
    assert {r.id: (r.dl, [tuple(t) for t in r.terms]) for r in got.collect()} == {1: (4, [("alpha", 1), ("beta", 3)]), 2: (0, []), 3: (1, [("zz", 1)]), 4: (0, [])}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_statistics_of_terms_by_id(spark):
    texts = [(1, "beta Alpha beta"), (2, "alpha the"), (1, "alpha gamma gamma delta"), (3, None), (None, "alpha beta"), (None, "beta"), (4, "")]
    for rows in (texts, [r for r in texts if r[0] in (2, 3, 4)], texts[:2], []):
        ids, times = {}, {}
        for i, text in rows:
            for term in (text or "").lower().replace("the", "").split():
                ids.setdefault(term, set()).add(i)
                times[term] = times.get(term, 0) + 1
        got = search.term_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.term: (r.df, r.cf) for r in got.collect()} == {t: (len(ids[t]), times[t]) for t in ids} and got.count() == len(ids)
    docs = spark.createDataFrame(texts[:2], "doc_id long, text string")
    wanted = spark.createDataFrame([("alpha", 0)], "term string, number int")
    for df in (search.term_statistics(docs), search.postings(docs), search.matched_terms(docs, wanted)):
        assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert "HashAggregate(keys=[id" not in search.term_statistics(docs)._jdf.queryExecution().executedPlan().toString()


def test_vectors_in_blocks_and_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, float(i)]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(77, None)], "qid long, qvec array<double>")
    block, search.BLOCK = search.BLOCK, 7
    got = search.vector_top(v, q, 3).collect()
    search.BLOCK = block
    assert {r.qid for r in got} == set(range(30)) and all([r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] == [0, 1, 3] or [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] == [1, 3, 5] for i in range(30))
    assert search.vector_top(v.where("false"), q, 3).count() == 0 and search.vector_top(v, q.where("false"), 3).count() == 0


def test_character_chunks(spark):
    text = "one two three.\n\nfour five six seven eight nine ten.\nlonglonglonglonglonglonglong x"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "doc_id long, page long, content string")
    rows = chunks.character_chunks(pages, 12).orderBy("part").collect()
    assert all(0 < len(r.content) <= 12 for r in rows) and {r.doc_id for r in rows} == {1}
    assert "".join("".join(r.content.split()) for r in rows) == "".join(text.split()) and [r.part for r in rows] == list(range(len(rows)))


def test_hocr_lines_words_and_page(spark):
    text = ("<div class='ocr_page' id='page_1' title='image \"x\"; bbox 0 0 600 800; ppageno 4'><span class='ocr_header' id='l1' title=\"bbox 5 6 50 20; baseline 0 0\">"
            "<span class='ocrx_word' id='w1' title='bbox 5 6 20 20; x_wconf 96'>A &amp;</span> <span class='ocrx_word' id='w2' title='bbox 22 6 50 20; x_wconf 90'><em>B</em></span></span></div>")
    got = ocr.hocr(spark.createDataFrame([(1, 1, text), (2, 7, "no markup"), (3, 1, None)], "doc_id long, page long, content string")).collect()
    assert sorted((r.kind, r.page, r.text, r.x, r.w, r.conf) for r in got) == [("line", 5, "A & B", 5, 45, -1), ("page", 5, "", 0, 600, -1), ("word", 5, "A &", 5, 15, 96), ("word", 5, "B", 22, 28, 90)]
    with pytest.raises(KeyError):
        ocr.parse(spark.createDataFrame([], "doc_id long, page long, content string"), "other")


def test_noted_page_counts(spark):
    body = json.dumps({ocr.NOTE: {"doc_page_num": "9", "width": 100, "height": 200}, "Blocks": [{"BlockType": "WORD", "Text": "w", "Confidence": 5.0, "Geometry": {"BoundingBox": {"Left": 0.105, "Top": 0.5, "Width": 0.201, "Height": 0.1}}}]})
    r = ocr.aws_blocks(spark.createDataFrame([(1, 2, body), (2, 2, "no json")], "doc_id long, page long, content string")).collect()
    assert [(x.page, x.x, x.y, x.w, x.h) for x in r] == [(9, 10, 100, 21, 20)]


def test_anchor_points_and_options(spark):
    assert anchors.options(["a", ["b", ["c", "d"]]]) == [["a"], ["b", "c"], ["b", "d"]]
    box = spark.createDataFrame([(10, 20, 30, 40, 100.0, 200.0)], "x1 long, y1 long, x2 long, y2 long, width double, height double")
    want = {("left", "5px"): 15, ("right", -5): 25, ("right", "50%r"): 65, ("right", "-50%r"): 15, ("top", "10%a"): 20, ("bottom", "2t"): 80, ("bottom", "50t"): 200, ("left", "-9t"): 0}
    got = box.select(*[anchors.point(k, v).alias(f"c{i}") for i, (k, v) in enumerate(want)]).first()
    assert list(got) == [float(v) for v in want.values()]
    with pytest.raises(ValueError):
        anchors.point("left", "5em")
    with pytest.raises(ValueError):
        anchors.pick_occurrences(box, [0])
    t = spark.createDataFrame([("Total Amount",), ("totl amount due",), (None,), ("",)], "t string")
    assert [r.m for r in t.select(anchors.matches("total amount", F.col("t"), "normal", 0.95).alias("m")).collect()] == [True, True, False, False]
    ends = anchors.document_ends(spark.createDataFrame([(1, 1, 5.0, 6.0), (1, 3, 7.0, 8.0)], "doc_id long, page long, width double, height double"), end=True).first()
    assert (ends.page, ends.x2, ends.y2) == (3, 7.0, 8.0)


def test_configured_steps(spark):
    assert dispatch.technique(".pdf", {"enabled": True, "input_file_type": "pdf", "model_provider": "m"}) == "ocr_based"
    assert dispatch.technique(".PNG", {"enabled": True, "input_file_type": "image", "text_provider": "detected_tables"}) == "detected_table_extraction"
    assert dispatch.technique(".json", {"enabled": True, "input_file_type": "json"}) == "json" and dispatch.technique(".pdf", {"enabled": True, "input_file_type": "json"}) is None
    docs = spark.createDataFrame([(1, ".txt")], "doc_id long, extension string")
    with pytest.raises(KeyError):
        dispatch.generate(docs, [{"enabled": True, "input_file_type": "txt"}], {})
    with pytest.raises(ValueError):
        dispatch.generate(docs, [{"enabled": False, "input_file_type": "txt"}], {})
    with pytest.raises(ValueError):
        dispatch.classifier_rule({"header": {"auto": {"enabled": True}}, "footer": {"manual": {"enabled": True}}})
    with pytest.raises(ValueError):
        dispatch.classifier_rule({})
    none = _seg(spark, []).withColumn("x1", F.lit(None).cast("long"))
    dims = spark.createDataFrame([(1, 1, 100)], "doc_id long, page long, height long")
    rule = {"header": {"auto": {"enabled": True}}}
    assert dispatch.classify(none, dims, rule).count() == 0
    with pytest.raises(ValueError):
        dispatch.classify(_seg(spark, [(1, 1, 0, "text", "a", None, 0, 1, 1)]), dims, rule)
    with pytest.raises(ValueError):
        dispatch.make_chunks(_seg(spark, []), {"methods": {}})
    with pytest.raises(KeyError):
        dispatch.update_documents(docs, [{"drop": "x"}])
    tall = _seg(spark, [(1, 1, 0, "text", "a", 0, 0, 9, 1500), (1, 1, 1, "table", "t", 50, 0, 60, 1600), (1, 1, 2, "text", "--", 90, 0, 99, 9)]).withColumn("technique", F.lit("native_pdf"))
    assert [r.content for r in dispatch.consolidate(tall).collect()] == ["t"]
    merged = dispatch.make_chunks(_seg(spark, [(1, 1, 0, "Title", "T", 0, 0, 1, 1), (1, 1, 1, "Text", "x", 0, 0, 1, 1)]), {"merge_titles": ["Text"], "methods": {"segment": {"enabled": True}}})
    assert [(r.content, r.char_count) for r in merged.collect()] == [("T:x", 3)]


def test_larger_segments_replace(spark):
    rows = [(1, 1, 0, "text", "small", 0, 0, 10, 10), (1, 1, 1, "text", "large", 0, 0, 20, 20), (1, 1, 2, "text", "inside", 1, 1, 3, 3), (1, 1, 3, "text", "far", 90, 90, 99, 99)]
    assert sorted(r.content for r in layout.prefer_larger(_seg(spark, rows)).collect()) == ["far", "large"]
    assert layout.prefer_larger(_seg(spark, [])).count() == 0 and layout.merge_adjacent(_seg(spark, [])).count() == 0


def test_requests_are_claimed_once(spark, tmp_path):
    root, src = "file://" + str(tmp_path / "m"), tmp_path / "in"
    src.mkdir()
    for n in ("a.txt", "b.txt", "c.pdf"):
        (src / n).write_text(n)
    listed = files.list_files(spark, str(src), exclude=("pdf",))
    on = {"inference": {"enabled": True}}
    first = requests.create_requests(spark, listed, root, "G-1", "/w", on, batch=1)
    assert [r.filename for r in first.collect()] == ["a.txt"] and first.first().work_path.endswith("/input/a.txt")
    assert [r.filename for r in requests.create_requests(spark, listed, root, "G-2", "/w", on).collect()] == ["b.txt"]
    assert requests.create_requests(spark, listed, root, "G-3", "/w", on).count() == 0
    taken = requests.take_group(spark, root)
    assert {r.group_id for r in taken.collect()} == {"G-1"}
    results = taken.select("document_id", "path")
    with pytest.raises(RuntimeError):
        requests.close_group(spark, root, "G-1", results, str(tmp_path / "out"), on_close=lambda g: False)
    requests.close_group(spark, root, "G-1", results, str(tmp_path / "out"), on_close=lambda g: g == "G-1")
    assert {r.group_id: r.state for r in requests.states(spark, root).collect()} == {"G-1": "closed", "G-2": "pending"}
    assert requests.take_group(spark, root).first().group_id == "G-2" and requests.take_group(spark, root) is None
    with pytest.raises(ValueError):
        requests.mode({"other": {"enabled": True}})
    assert requests.pseudo_request(spark, "D-5").first().document_id == "D-5"


def test_results_of_many_documents_are_few_files(spark, tmp_path):
    root, out = "file://" + str(tmp_path / "m"), tmp_path / "out"
    listed = spark.range(300).selectExpr("concat('/in/', id, '.txt') AS path", "concat(id, '.txt') AS filename", "'txt' AS extension", "concat('c', id) AS claim")
    requests.create_requests(spark, listed, root, "G-1", "/w", {"inference": {"enabled": True}})
    results = requests.take_group(spark, root).select("document_id", "path", F.lit("line\nline \u00e9").alias("answer"), F.lit(None).cast("string").alias("none"))
    requests.close_group(spark, root, "G-1", results.unionByName(results.limit(1).withColumn("document_id", F.lit("D-other"))), str(out))
    kept = requests.read_documents(spark, str(out / "G-1")).collect()
    want = {r.document_id: {"document_id": r.document_id, "path": r.path, "answer": r.answer} for r in results.collect()}
    assert len(want) == len(kept) == 300 and {r.document_id: json.loads(r.value) for r in kept} == want
    assert len(list(out.rglob("part-*"))) <= 20
    with pytest.raises(Exception, match="(?i)exists"):
        requests.save_documents(results, str(out / "G-1"))


def test_sheets_chunks_and_archives(spark, tmp_path):
    sheet = spark.createDataFrame([("1", "a", 0), ("2", "b", 1), ("1", "b", 2)], "Q_No string, doc_name string, pos long")
    assert requests.query_sheet(sheet, "b").count() == 2
    with pytest.raises(ValueError):
        requests.query_sheet(sheet)
    both = requests.results_of(sheet, spark.createDataFrame([(1, "yes")], "pos long, answer string")).orderBy("pos").collect()
    assert [r.answer for r in both] == [None, "yes", None]
    c = spark.createDataFrame([("1_a", "line\nline", {"k": "v"}), ("1_b", "", {})], "chunk_key string, content string, metadata map<string,string>")
    requests.save_chunks(c, str(tmp_path / "c"))
    assert {r.chunk_key: (r.content, r.metadata) for r in requests.read_chunks(spark, str(tmp_path / "c")).collect()} == {"1_a": ("line\nline", {"k": "v"}), "1_b": ("", {})}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/a.txt", "é")
        z.writestr("d/b.txt", "b")
        z.writestr("e.txt", "")
    rows = requests.unzip(spark.createDataFrame([("x.zip", bytearray(buffer.getvalue()))], "path string, content binary")).collect()
    assert sorted((r.member, r.text, r.folder_files) for r in rows) == [("d/a.txt", "é", 2), ("d/b.txt", "b", 2), ("e.txt", "", 1)]
    assert requests.resource_paths(spark.createDataFrame([("D-1", "/a/b.pdf")], "document_id string, path string"), "/r/").first().resources[0].path == "/r/D-1/b.pdf"


def test_file_verbs(spark, tmp_path):
    p = "file://" + str(tmp_path / "f.json")
    files.write_file(spark, p, b"a")
    files.write_file(spark, p, b"b", append=True)
    assert files.read_file(spark, p) == b"ab" and not files.write_if_different(spark, p, b"ab") and files.write_if_different(spark, p, b"c")
    files.copy(spark, p, p + ".copy")
    files.move(spark, p, "file://" + str(tmp_path / "g/h.json"))
    assert not files.exists(spark, p) and files.info(spark, p + ".copy")["size"] == 1 and files.info(spark, "file://" + str(tmp_path / "g"))["type"] == "directory"
    with pytest.raises(FileExistsError):
        files.move(spark, p + ".copy", "file://" + str(tmp_path / "g/h.json"))
    assert files.delete(spark, p + ".copy") and not files.delete(spark, p + ".copy")


def test_answers_retry_and_block(spark):
    p = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "a secret"), (4, None), (5, "good"), (6, "tell")], "qid long, prompt string")

    def provider(prompts):
        return ["{}" if x == "good" else "the SECRET" if x == "tell" else "no json" for x in prompts]

    rows = {r.qid: (r.answer, r.status, r.tries) for r in reader.answer(p, provider, attempts=3, as_json=True, banned=["secret"]).collect()}
    assert rows == {1: ("{}", "ok", 1), 2: ("no json", "invalid", 3), 3: (None, "blocked", 0), 4: (None, "invalid", 0), 5: ("{}", "ok", 1), 6: (None, "blocked", 3)}
    cache = spark.sql("SELECT sha1('bad') AS key, '[1]' AS answer")
    assert {r.qid: r.tries for r in reader.answer(p, provider, as_json=True, cache=cache).where("status = 'ok'").collect()} == {1: 1, 2: 0, 5: 1}
    assert reader.answer(p.where("false"), provider).count() == 0
    v = reader.embed(p, "prompt", lambda xs: [[float(len(x))] for x in xs]).collect()
    assert {r.qid: r.vector for r in v}[4] is None and {r.qid: r.vector for r in v}[2] == [3.0]


def test_query_filters_and_rules(spark):
    q = spark.createDataFrame([(1, "cheap shoes")], "qid long, question string")
    r = reader.query_filters(q, ["kind"], lambda xs: ['{"question": "shoes", "filters": {"kind": "cheap", "other": "x"}}' for _ in xs]).first()
    assert (r.rewritten, r.filters) == ("shoes", {"kind": "cheap"})
    reader.search_request(q, 3)
    for bad, k in ((q.where("false"), 3), (q, 0), (q.withColumn("question", F.lit(" ")), 3)):
        with pytest.raises(ValueError):
            reader.search_request(bad, k)
    with pytest.raises(ValueError):
        reader.load_dataset(spark.createDataFrame([('{"question": "q"}',)], "value string"))


def test_statements_report_errors(spark):
    def execute(s):
        if "bad" in s:
            raise RuntimeError("refused")

    rows = qna.run_statements(spark.createDataFrame([("a", "MERGE ok"), ("b", "MERGE bad")], "key string, statement string"), execute).collect()
    assert {r.key: r.error for r in rows} == {"a": None, "b": "refused"}


def test_providers(spark):
    with pytest.raises(KeyError):
        providers.get("ocr", "none")
    with pytest.raises(ValueError):
        providers.register("other", "x", providers.get("ocr", "typed"))
    with pytest.raises(ValueError):
        providers.register("ocr", "typed", providers.get("ocr", "typed"))
    images = spark.createDataFrame([(1, [[0, 255], [255, 255]]), (2, [[255]]), (3, None)], "image long, pixels array<array<int>>")
    assert [tuple(r) for r in providers.detect_tables(images, "pixels").collect()] == [(1, "dark", 0, 1.0, 0, 0, 1, 1)]
    boxes = spark.createDataFrame([(1, 1, 0, 0, 2, 1), (1, 2, 5, 5, 9, 9)], "image long, box_id long, x1 int, y1 int, x2 int, y2 int")
    assert {r.box_id: (r.dark, r.is_set) for r in providers.box_states(images, boxes).collect()} == {1: (0.5, True), 2: (0.0, False)}


def test_stream_takes_each_document_once(spark, tmp_path):
    src, ix, cp = tmp_path / "in", str(tmp_path / "ix"), str(tmp_path / "cp")
    for n, rows in enumerate(([(1, "alpha beta"), (1, "alpha beta")], [(1, "again"), (2, None)], [(3, "beta")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(src / f"p{n}"))
        ingest.index_stream(ingest.watch_documents(spark, str(src)), ix, cp).awaitTermination()
    postings, documents = ingest.read_index(spark, ix)
    assert sorted((r.doc_id, r.dl) for r in documents.collect()) == [(1, 2), (2, 0), (3, 1)]
    assert sorted((r.id, r.term) for r in postings.collect()) == [(1, "alpha"), (1, "beta"), (3, "beta")]


def test_both_indexes_and_detection_files(spark, tmp_path):
    c = spark.createDataFrame([("c", 1, "alpha", {"chunking_method": "page"}), ("c", 2, "beta", {"chunking_method": "segment"})], "collection string, id long, content string, metadata map<string,string>")
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<double>")
    where = index.index_documents(spark, "file://" + str(tmp_path / "ix"), c, v, method="page")
    assert [r.id for r in index.get_records(spark, where["vectors"]).collect()] == ["1"]
    record = {"image": "i", "confidence": 0.5, "bbox": [0, 0, 1, 1]}
    for n, meta in (("a", {"model_name": "m", "dataset_name": "x"}), ("b", {"model_name": "n", "dataset_name": "y"})):
        (tmp_path / f"{n}.json").write_text(json.dumps({"metadata": meta, "records": [record]}))
    assert {r.model for r in files.detections(spark, str(tmp_path / "*.json")).collect()} == {"m", "n"}
    with pytest.raises(ValueError):
        files.detections(spark, str(tmp_path / "*.json"), one_dataset=True)
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"model_name": "m"}, "records": [record | {"model_name": "z"}]}))
    with pytest.raises(ValueError):
        files.detections(spark, str(tmp_path / "c.json"))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_embedding_hashes_each_text_once(spark):
    from pyspark.sql import functions as F

    from paperlake.operators import reader

    rows = spark.createDataFrame([(1, "a bb ccc a"), (2, None), (3, "")], "id long, t string")
    got = rows.select("id", reader.hashed_embedding(F.col("t"), 8).alias("v"))
    assert _plan(got).count("md5(") == 1 and {r.id: sum(r.v) for r in got.collect()} == {1: 2.0, 2: 0.0, 3: 0.0}


def test_similar_runs_are_those_of_the_definition(spark):
    import math
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from paperlake.operators import anchors

    rng = random.Random(2)
    words = ["the", "license", "licence", "teh", "", "eeeeee", "THE", "License,", "é😀", "hence", "silence"]
    texts = [None, "", " ", "the", "the  license"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def cosine(a, b):
        x, y = Counter(a), Counter(b)
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return round(sum(x[c] * y[c] for c in x) / size, 3) if size else 0.0

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for anchor, least in (("the license", 0.9), ("the license", 1.0), ("Eee", 0.5)):
        n = len(anchor.split(" "))
        df = rows.where(anchors.similar(anchor, F.col("t"), least))
        want = set()
        for i, t in enumerate(texts):
            w = (t or "").lower().split(" ")
            if (t or "").strip(" ") and any(cosine(anchor.lower(), " ".join(w[k : k + n])) >= least for k in range(len(w) - n + 1)):
                want.add(i)
        assert {r.id for r in df.collect()} == want and want
        assert "array_distinct" not in _plan(df)  # which was one for each run of words


def test_results_are_parsed_in_one_pass(spark):
    from paperlake.operators import ocr

    j = spark.createDataFrame([(1, 1, '{"regions": [{"lines": [{"boundingBox": "1,2,3,4", "words": [{"boundingBox": "1,2,3,4", "text": "a"}, {"boundingBox": "2,2,1,4", "text": "b"}]}, {"boundingBox": "0,9,1,1", "words": []}]}]}'), (2, 1, None), (3, 1, "{}")],
                              "doc_id long, page long, content string")
    for parser in (ocr.azure_read, ocr.azure_regions, ocr.aws_blocks, ocr.pdf_tokens):
        assert _plan(parser(j)).count("from_json(") == 1
    got = ocr.azure_regions(j).collect()
    assert sorted((r.kind, r.ord, r.text) for r in got if r.text) == [('line', 0, 'a b'), ('word', 0, 'a'), ('word', 1, 'b')] and len(got) == 4
    h = spark.createDataFrame([(1, 7, "<div class='ocr_page' title='bbox 0 0 9 9; ppageno 2'><span class='x' class='ocr_line' title='bbox 1 2 3 4'>"
                                      "<span id='c' class='ocrx_word' title='bbox 1 1 1 1; x_wconf 1' title='bbox 1 2 3 5; x_wconf 90'><b>a &amp;</b> $1  c</span></span>"), (2, 7, "none"), (3, 7, None)], "doc_id long, page long, content string")
    df = ocr.hocr(h)
    assert "Union" not in _plan(df)
    assert sorted((r.doc_id, r.page, r.kind, r.text, r.x, r.h, r.conf) for r in df.collect()) == [
        (1, 3, "line", "a & $1 c", 1.0, 2.0, -1.0), (1, 3, "page", "", 0.0, 9.0, -1.0), (1, 3, "word", "a & $1 c", 1.0, 3.0, 90.0)]


def test_nearest_meets_once_a_pair(spark):
    import random

    from pyspark.sql import functions as F

    from paperlake.operators import regions

    rng = random.Random(4)
    rows = []
    for i in range(60):
        x, y = rng.randint(-700, 1900), rng.randint(-200, 700)
        rows.append((1, 1, i, "t", x, y, x + rng.choice([5, 300, 1300]), y + rng.choice([10, 250])))
    t = spark.createDataFrame(rows, "doc_id long, page long, ord long, content string, x1 long, y1 long, x2 long, y2 long")
    for side, low, high, a, b in (("bottom", 4, 6, 7, 5), ("right", 5, 7, 6, 4)):
        want = {}
        for r in rows:
            near = [(o[b] - r[a], o[2]) for o in rows if o[2] != r[2] and o[b] >= r[a] and min(r[high], o[high]) > max(r[low], o[low])]
            if near:
                want[r[2]] = min(near)
        assert {r.ord: (r.distance, r.near_ord) for r in regions.nearest(t, side).collect()} == want
    column = spark.createDataFrame([(50, 550)], "a long, b long")
    assert column.select(regions._bands(F.col("a"), F.col("b"), regions.WIDE)).count() == 1  # six of the bands before


def test_character_chunks_leave_in_bounded_batches(spark, monkeypatch):
    from paperlake.operators import chunks

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    monkeypatch.setattr(chunks, "_OUT_CHARS", 10)
    texts = {1: "aa bb\ncc dd", 2: None, 3: "x" * 25, 4: " "}
    pages = spark.createDataFrame([(d, 1, c) for d, c in texts.items()], "doc_id long, page long, content string")
    got = chunks.character_chunks(pages, 6).collect()
    assert spark.conf.get(key) == "512"
    assert sorted(map(tuple, got)) == sorted((d, 1, i, t) for d, c in texts.items() for i, t in enumerate(chunks.split_text(c or "", 6)))


def test_searches_take_batches_of_fewer_rows(spark):
    from paperlake.operators import search

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}", [float(i), 1.0]) for i in range(1200)], "doc_id long, text string, v array<double>")
    spark.conf.set(key, "10000")
    words = search.bm25_top(docs, spark.createDataFrame([(1, "word3 other1")], "qid long, question string"), 3).collect()
    assert spark.conf.get(key) == "512" and sorted(r.id for r in words) == [10, 31, 52]
    spark.conf.set(key, "10000")
    near = search.vector_top(docs, spark.createDataFrame([(1, [600.2, 1.0])], "qid long, qvec array<double>"), 3, "doc_id", "v").collect()
    assert spark.conf.get(key) == "512" and sorted(r.id for r in near) == [599, 600, 601]
