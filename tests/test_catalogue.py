"""Every named query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from paperlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())


def test_band_match_of_all_records(spark):
    truth, found = (f.collect() for f in catalogue._boxes(spark, DATA))
    sides, of = ("x1", "y1", "x2", "y2"), {}
    for t in truth:
        of.setdefault(t.image, []).append(t)
    want = Counter()
    for r in found:
        near = [t.truth_id for t in of.get(r.image, []) if all(abs(r[c] - t[c]) <= 60 for c in sides)]
        if near:
            want[(r.image, r.model, r.det_id, min(near))] += 1
    got = catalogue.queries()["band_match"](spark, DATA)
    assert got.columns == ["image", "model", "rec_id", "truth_id"] and Counter(map(tuple, got.collect())) == want
    assert {k[1] for k in want} == {"m1", "m2"} and any(k[2] % 5 for k in want) and any(k[3] % 4 for k in want)


def test_full_outer_report_of_all_labels(spark, tmp_path):
    spark.createDataFrame([(1, "en", 10), (3, "de", 30), (5, "fr", 50)], "doc_id long, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (5, 0, 1), (6, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalogue.queries()["report_full_outer"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "file_lang", "file_Quality", "toxic"]
    assert sorted(map(tuple, got.collect())) == [(1, "en", 10, None), (3, "de", 30, 0), (5, "fr", 50, 1), (6, None, None, 1), (7, None, None, 0)]


def test_the_llm_subpackage_is_optional(tmp_path):
    import pathlib
    import re
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(catalogue.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"paperlake\.llm|corpus_pipeline", f.read_text()), f
    copy = tmp_path / "copy"
    shutil.copytree(root, copy / "paperlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root.parent / "__spark_entry__.py", copy)
    script = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", script], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    (copy / "paperlake" / "llm").mkdir()  # there, but not to be imported
    (copy / "paperlake" / "llm" / "__init__.py").write_text("")
    (copy / "paperlake" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", script], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
