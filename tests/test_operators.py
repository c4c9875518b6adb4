import pytest
from pyspark.sql import functions as F

from paperlake.functions import bbox, pages, text as T
from paperlake.operators import chunks, evaluate, layout, qna, regions, search, segments
from paperlake.plans import pipeline
from paperlake.sources import files
from paperlake.streaming import ingest


def test_chunk_pages():
    assert pages.chunk_pages([], [3, 1]) == [1, 3]
    assert pages.chunk_pages([1, "3:"], [1, 2, 3, 4]) == [1, 3, 4]
    assert pages.chunk_pages([":2"], [1, 2, 3]) == [1, 2]
    with pytest.raises(ValueError):
        pages.chunk_pages(["1-2"], [1])


def test_region_pages():
    assert pages.region_pages([], 3) == [1, 2, 3]
    assert pages.region_pages(["-1"], 5) == [5]
    assert pages.region_pages(["2:-2", 1], 5) == [1, 2, 3, 4]
    assert pages.region_pages([":2"], 5) == [1, 2]
    with pytest.raises(ValueError):
        pages.region_pages(["x"], 5)


def test_split_text():
    parts = chunks.split_text("aa bb cc dd", 5)
    assert parts == ["aa bb", "cc dd"]
    assert chunks.split_text("abcdefgh", 3) == ["abc", "def", "gh"]
    assert chunks.split_text("", 3) == []
    assert all(len(p) <= 7 for p in chunks.split_text("one two\n\nthree four five\nsix", 7))


def test_scores_and_json(spark):
    df = spark.createDataFrame([('{"score": 9}',), ("x ```json\n{\"score\": 2}\n```",), ("none",), (None,), ("7",), ("rating: 3.5 of 5",)], "a string")
    rows = df.select(T.json_score(F.col("a")).alias("j"), T.free_score(F.col("a")).alias("f")).collect()
    assert [r.j for r in rows] == [3.0, 2.0, -1.0, -1.0, -1.0, -1.0]
    assert [r.f for r in rows] == [9.0, 2.0, None, None, 7.0, 3.5]


def test_boxes(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15), (0, 0, 0, 0, 0, 0, 0, 0)], "a1 int, a2 int, a3 int, a4 int, b1 int, b2 int, b3 int, b4 int")
    a, b = tuple(F.col(f"a{i}") for i in range(1, 5)), tuple(F.col(f"b{i}") for i in range(1, 5))
    rows = df.select(bbox.iou_pct(a, b).alias("i"), bbox.enclosing_iou(a, b).alias("e")).collect()
    assert rows[0].i == 14.29 and abs(rows[0].e - 25 / 225) < 1e-9 and rows[1].i == 0


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b\n\n c")], "doc_id long, text string")
    assert [r.content for r in segments.paragraphs(docs).collect()] == ["a b", " c"]
    none = docs.where("false")
    assert segments.paragraphs(none).count() == 0
    q = spark.createDataFrame([(1, "alpha beta")], "qid long, question string")
    assert search.bm25(none, q).count() == 0
    assert search.top(search.bm25(spark.createDataFrame([(1, "alpha"), (2, "alpha alpha beta"), (3, None)], "doc_id long, text string"), q), 1).first().id == 2


def test_fetch_size():
    assert search.fetch_size(5, 2, 10) == 5
    assert search.fetch_size(50, 2, 10) == 4
    assert search.fetch_size(50, 40, 10) == 10


def test_round_robin_turns(spark):
    s = spark.createDataFrame([(1, 1, 0.1, "a"), (1, 2, 0.2, "a"), (1, 3, 0.9, "b")], "qid long, id long, score double, value string")
    assert [r.id for r in search.round_robin(s, ["a", "b"], 2).orderBy("rank").collect()] == [1, 3]


def test_greedy_consumes(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 0, 0, 10, 10)], "image long, truth_id long, x1 long, y1 long, x2 long, y2 long")
    d = spark.createDataFrame([(1, "m", 1, 0, 0, 10, 10)], "image long, model string, det_id long, x1 long, y1 long, x2 long, y2 long")
    rows = evaluate.greedy_matches(t, d).collect()
    assert [(r.truth_id, r.det_id, r.overlap) for r in rows] == [(1, 1, 100.0)]
    out = evaluate.with_unmatched(t, d, evaluate.greedy_matches(t, d)).collect()
    assert sorted(r.status for r in out) == ["entity-not-extracted", "match-found"]


def test_greedy_takes_the_next_best(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 0, 0, 10, 9), (1, 3, 50, 50, 60, 60)], "image long, truth_id long, x1 long, y1 long, x2 long, y2 long")
    d = spark.createDataFrame([(1, "m", 1, 0, 0, 10, 9), (1, "m", 2, 0, 0, 10, 10), (1, "m", 3, 80, 80, 90, 90), (1, None, 4, 0, 0, 10, 10)], "image long, model string, det_id long, x1 long, y1 long, x2 long, y2 long")
    rows = evaluate.greedy_matches(t, d.where("model = 'm'"))
    assert sorted((r.truth_id, r.det_id, r.overlap) for r in rows.collect()) == [(1, 2, 100.0), (2, 1, 100.0)]
    only = d.where("det_id = 2")  # both truths want it; the second gets nothing
    assert [(r.truth_id, r.overlap) for r in evaluate.greedy_matches(t, only).collect()] == [(1, 100.0)]
    assert evaluate.greedy_matches(t, d.where("false")).count() == 0 and evaluate.greedy_matches(t.where("false"), d).count() == 0


def test_outcome_in_one_pass(spark, monkeypatch):
    import random

    rng, box = random.Random(5), "x1 long, y1 long, x2 long, y2 long"

    def boxes(n):
        return [(x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(1, 25), y + rng.randrange(1, 25)) for _ in range(n)]

    t = [(image, k, *b) for image in (1, 2, 3, 4, None) for k, b in enumerate(boxes(12))] + [(1, 3, 0, 0, 9, 9), (2, 20, 5, 5, 5, 5)]
    d = [(image, m, k, *b) for image in (1, 2, 3, 9, None) for m in ("a", "b", None) if (image, m) != (3, "b") for k, b in enumerate(boxes(9))] + [(1, "a", 2, 0, 0, 8, 8), (2, "b", 30, 5, 5, 5, 5)]
    d += [(4, "c", 1, None, 0, 9, 9)]
    truth, found = spark.createDataFrame(t, f"image long, truth_id long, {box}"), spark.createDataFrame(d, f"image long, model string, det_id long, {box}")
    for a, b in ((truth, found), (truth, found.where("image = 1")), (truth, found.where("false")), (truth.where("false"), found), (truth.selectExpr("string(image) AS image", "string(truth_id) AS truth_id", "x1 / 7.3D AS x1", "y1 / 7.3D AS y1", "x2 / 7.3D AS x2", "y2 / 7.3D AS y2"), found.selectExpr(
            "string(image) AS image", "model", "string(det_id) AS det_id", "x1 / 7.3D AS x1", "y1 / 7.3D AS y1", "x2 / 7.3D AS x2", "y2 / 7.3D AS y2"))):
        want, got = evaluate.with_unmatched(a, b, evaluate.greedy_matches(a, b)), evaluate.outcome(a, b)
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = evaluate.outcome(truth, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    x = [i / 8000 for i in range(1, 4000)] + [1.005, 2.675, 33.335]
    want = spark.createDataFrame([(v,) for v in x], "v double").selectExpr("v", "round(v, 2) AS r").collect()
    assert {r.v: r.r for r in want} == dict(zip(x, evaluate._half_up(evaluate.np.array(x), 2).tolist()))
    monkeypatch.setattr(evaluate, "_PAIRS", 7)
    a, b = ([evaluate.np.array(c) for c in zip(*boxes(20))] for _ in range(2))
    first, last = evaluate.np.repeat([0, 5], 10), evaluate.np.repeat([5, 20], 10)
    few = evaluate._overlaps(a, b, first, last, 2)
    monkeypatch.undo()
    assert all((p == q).all() for p, q in zip(few, evaluate._overlaps(a, b, first, last, 2))) and len(few[0])


def test_more_than_a_thousand_models(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10)], "image long, truth_id long, x1 long, y1 long, x2 long, y2 long")
    d = spark.range(1001).selectExpr("1L AS image", "concat('m', id) AS model", "id AS det_id", "0L AS x1", "0L AS y1", "10L AS x2", "10L AS y2")
    out = evaluate.with_unmatched(t, d, evaluate.greedy_matches(t, d))
    assert out.where("status = 'match-found'").count() == out.count() == 1001
    stats = evaluate.model_stats(t, d, out)
    assert stats.count() == 1001 and {tuple(r[c] for c in ("extracted", "truth", "matched", "unmatched", "modified", "added", "final")) for r in stats.collect()} == {(1, 1, 1, 0, 0, 0, 1)}


def test_grid_similarity_is_a_substructure(spark):
    import itertools
    import random

    rng = random.Random(3)

    def best(a, b):
        top = 0.0
        for k in range(1, min(len(a), len(b)) + 1):
            for q in range(1, min(len(a[0]), len(b[0])) + 1):
                for rows, other in itertools.product(itertools.combinations(range(len(a)), k), itertools.combinations(range(len(b)), k)):
                    for cols, theirs in itertools.product(itertools.combinations(range(len(a[0])), q), itertools.combinations(range(len(b[0])), q)):
                        top = max(top, sum(a[i][j] == b[x][y] for i, x in zip(rows, other) for j, y in zip(cols, theirs)))
        return top

    for _ in range(150):
        a, b = ([[rng.choice("abcd") for _ in range(2)] for _ in range(rng.choice([1, 2]))] for _ in range(2))
        f, p, r, upper = layout.grid_similarity(a, b, lambda x, y: float(x == y))
        exact = best(a, b)
        assert p * sum(map(len, b)) <= exact + 1e-9 and f <= upper + 1e-9
        assert layout.grid_similarity(a, a)[0] == 1.0
    assert layout.grid_similarity([["d", "d"], ["a", "d"]], [["b", "d"], ["d", "b"]], lambda x, y: float(x == y))[0] <= 0.25
    text, span = layout.span_grids(layout.html_cells("<table><tr><td colspan=2>H</td></tr><tr><td>x</td><td>y</td></tr></table>"))
    assert text == [["H", "H"], ["x", "y"]] and span[0] == [[0, 0, 2, 1], [-1, 0, 1, 1]] and span[1] == [[0, 0, 1, 1]] * 2
    boxes = spark.createDataFrame([(1, [[[0.0, 0.0, 2.0, 2.0]]], [[[0.0, 0.0, 2.0, 1.0]]])], "pair_id long, truth array<array<array<double>>>, found array<array<array<double>>>")
    assert layout.grid_scores(boxes, "loc").first().f == 0.5


def test_drop_overlaps(spark):
    s = spark.createDataFrame([(1, 1, 0, "text", "a", 0, 0, 10, 10), (1, 1, 1, "table", "b", 5, 5, 15, 15), (1, 1, 2, "table", "c", 5, 5, 15, 15)],
                              "doc_id long, page long, ord long, type string, content string, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r.ord for r in layout.drop_overlaps(s).collect()) == [1, 2]


def test_phrases(spark):
    w = spark.createDataFrame([(1, 1, 0, "a", 0, 0, 10, 10), (1, 1, 1, "b", 14, 0, 20, 10), (1, 1, 2, "c", 60, 0, 70, 10)],
                              "doc_id long, page long, ord long, content string, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r.content for r in layout.phrases(w).collect()) == ["a b", "c"]


def test_grids_and_tables():
    assert layout.grid_similarity([["a"]], [["a"]])[:3] == (1.0, 1.0, 1.0)
    assert layout.grid_similarity([], [])[:3] == (1.0, 1.0, 1.0)
    assert layout.grid_similarity([["a", "b"]], [["a"]])[1:3] == (1.0, 0.5)
    assert layout.lcs_similarity("", "") == 1.0 and layout.lcs_similarity(None, "a") == 0.0
    cells = layout.html_cells("<table><tr><th colspan=2>H</th></tr><tr><td rowspan='2'>x</td><td>y</td></tr><tr><td>z</td></tr></table>")
    assert cells == [(0, 1, 0, 2, "H", True), (1, 2, 0, 1, "x", False), (1, 1, 1, 1, "y", False), (2, 1, 1, 1, "z", False)]


def test_hocr(spark):
    page = "<span class='ocrx_word' id='w1' title='bbox 10 20 40 32; x_wconf 91'>Hello</span>"
    r = regions.hocr_tokens(spark.createDataFrame([(1, page)], "doc_id long, text string")).first()
    assert (r.text, r.x, r.y, r.w, r.h, r.conf) == ("Hello", 10, 20, 30, 12, 91)


def test_subtract_inside(spark):
    r = spark.createDataFrame([(1, 1, 1, 0, 0, 9, 100)], "region_id long, doc_id long, page long, x1 long, y1 long, x2 long, y2 long")
    c = spark.createDataFrame([(1, 1, 40, 60)], "doc_id long, page long, y1 long, y2 long")
    assert sorted((x.y1, x.y2) for x in regions.subtract(r, c).collect()) == [(0, 40), (60, 100)]


def test_provider_cache(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "qid long, prompt string")
    cache = spark.sql("SELECT sha1('b') AS key, 'stored' AS answer")
    rows = {r.qid: r.answer for r in qna.complete(p, lambda xs: [x.upper() for x in xs], cache).collect()}
    assert rows == {1: "A", 2: "A", 3: "stored"}


def test_majority(spark):
    v = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "a", 3), ("l", "x", 1)], "k string, v string, o long")
    rows = {r.k: (r.v, r.n, r.accepted) for r in evaluate.majority(v, ["k"], "v", "o").collect()}
    assert rows == {"k": ("a", 2, True), "l": ("x", 1, False)}


def test_pipeline_configuration(spark):
    @pipeline.processor("double")
    def _double(rows, cfg):
        return rows.withColumn("v", F.col("v") * cfg.get("by", 2))

    @pipeline.processor("tag")
    def _tag(rows, cfg):
        return rows.withColumn("t", F.lit(cfg["text"]))

    cfg = {"variables": {"a": "x", "b": "${a}y"}, "processor_list": [{"name": "double"}, {"processor_list": [{"name": "tag"}, {"name": "double"}]}, {"name": "off", "enabled": False}],
           "processor_input_config": {"tag": {"text": "${b}-${ENV:NOPE}"}}}
    r = pipeline.build(spark.createDataFrame([(1, 3)], "doc_id long, v long"), cfg).first()
    assert (r.v, r.t) == (12, "xy-${ENV:NOPE}")
    assert pipeline.invalid_keys({"a": {"b": 1, "z": 1}, "q": 1}, {"a": {"b": 0}}) == ["a.z", "q"]
    with pytest.raises(ValueError):
        pipeline.selected([], ["a"], ["b"])


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ntwo")
    (tmp_path / "d/b.zip").write_text("x")
    (tmp_path / "d/empty.fsh").write_text("")
    assert [r.filename for r in files.list_files(spark, str(tmp_path / "d"), exclude=("zip",)).collect()] == ["a.txt"]
    assert files.text_documents(spark, str(tmp_path / "d/a.txt")).first().text == "one\ntwo"
    (tmp_path / "t.csv").write_text("﻿image_path,x1,y1,x2,y2\np,1,2,3,4\n", encoding="utf-8")
    assert files.truth_tables(spark, str(tmp_path / "t.csv")).first().asDict() == {"image_path": "p", "x1": 1, "y1": 2, "x2": 3, "y2": 4}
    (tmp_path / "j.json").write_text('{"metadata": {"model_name": "m"}, "records": [{"image": "i", "confidence": 0.5, "bbox": [1, 2, 3, 4]}]}')
    assert files.detections(spark, str(tmp_path / "j.json")).first().model == "m"
    t = files.fill_json_template(spark.createDataFrame([('{"a": "x", "b": ["p", "q"]}',)], "j string"), "j", "{$.a}: {$.b,delimiter=;} {$.c}")
    assert t.first().content == "x: p;q "
    assert spark.range(1).select(files.human_size(F.lit(1536)).alias("s")).first().s == "1.50 KB"
    with pytest.raises(ValueError):
        files.save_snapshots(spark.createDataFrame([("a",), ("a",)], "document_id string"), str(tmp_path / "s"))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma alpha"), (3, None)], "doc_id long, text string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in/a"))
    docs.unionByName(docs.where("doc_id = 1")).write.parquet(str(tmp_path / "in/b"))
    stream = ingest.watch_documents(spark, str(tmp_path / "in"), files_per_batch=1)
    ingest.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    postings, lengths = ingest.read_index(spark, str(tmp_path / "index"))
    want = {tuple(r) for r in search.postings(docs).select("id", "term", "tf", "dl").collect()}
    assert {tuple(r) for r in postings.select("id", "term", "tf", "dl").collect()} == want
    assert lengths.count() == 3


def test_grid_similarity_compares_blocks_of_cells(spark, monkeypatch):
    """All cells meet, but not one call at a time; the numbers are difflib's."""
    import difflib
    import random

    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abcA1.é") for _ in range(rng.choice([1, 3, 8, 9, 20, 40, 300]))) for _ in range(60)} | {""})
    strings = layout._Strings(texts)
    for a in texts:
        assert strings.matching(a).tolist() == [sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for b in texts]
    made = []
    matcher = difflib.SequenceMatcher
    monkeypatch.setattr(layout.difflib, "SequenceMatcher", lambda *a, **k: made.append(1) or matcher(*a, **k))
    truth = [[f"name {i}", f"{i}.5"] for i in range(100)]
    assert layout.grid_similarity(truth, [[a.upper(), b[:-2]] for a, b in truth])[1] > 0.5
    assert len(made) <= 400  # those of the aligned cells
    pairs = spark.createDataFrame([(i, "<table></table>", "") for i in range(3)], "pair_id long, truth string, found string")
    assert layout._dealt(pairs.coalesce(1)).rdd.getNumPartitions() > 1
