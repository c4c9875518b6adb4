import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlake.llm import bpe, common, decontam, golay, hilbert, kn_quality, langid, license_scan, quality_rules, queries, simhash, token_count, toolcalls
from paperlake.llm.components import components
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _random_texts(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "é", "ÉTÉ", "a1", "x", "zz", "cc", "by", "general", "public", "license", "All", "rights", "reserved", "#", "...", "ß"]
    seps = [" ", "  ", "\n", "\t", ", ", "-", "\n\n"]
    out = ["".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.choice([0, 1, 2, 5, 30, 120]))) for _ in range(n)]
    return out + [None, "", "   \n ", "cc by", "x " * 3000, out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 17 else None, t, ["en", "de", None][i % 3], f"s{i % 2}", 1, "clash", "n") for i, t in enumerate(_random_texts())]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, w int, digest string, spans string").repartition(3).cache()


def _pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_contamination(spark, docs):
    items = [(1, "the of é the of é zz the x the of zz"), (2, "cc by"), (3, None), (4, ""), (5, "The, of x x x x x x x x x x"), (6, "cc by"), (None, "zz zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    mine = _pairs(docs, "doc_id", "text")
    want = Counter((i, n, h, tuple(x for x in f if x != "None")) for i, n, h, f in brute.contamination(mine, items))
    for size in (decontam.BROADCAST_BYTES, 0):
        got = decontam.contamination(docs, bench, broadcast_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(docs.where("false"), bench).count() == 0


def test_decontaminate(spark):
    d = spark.createDataFrame([(1, "Keep this. One two three four! End", "a"), (2, "one two three four", "b"), (3, "fine", "c"), (None, None, "d")], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(1, "One, two; three four")], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(d, b, window=4).collect()) == [0, 3]
    for most in (decontam.BROADCAST_HITS, -1):
        decontam.BROADCAST_HITS, before = most, decontam.BROADCAST_HITS
        kept = decontam.decontaminate(d, b, window=4, remove="spans")
        assert kept.columns == d.columns and {r.doc_id: r.text for r in kept.collect()} == {1: "Keep this! End", 3: "fine", None: None}
        decontam.BROADCAST_HITS = before
    twice = d.unionByName(d)
    for remove in ("documents", "spans"):
        assert decontam.decontaminate(twice, b.where("false"), remove=remove).count() == 8
        assert decontam.decontaminate(d.where("false"), b, remove=remove).count() == 0
    assert decontam.decontaminate(twice, b, window=4).count() == 4


def test_contamination_of_a_long_text(spark):
    w = [f"w{i}" for i in range(60000)]
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w[i * 30 : i * 30 + 12])) for i in range(2000)], "item_id long, text string")
    for size in (decontam.BROADCAST_BYTES, 0):
        r = decontam.contamination(d, b, broadcast_bytes=size).first()
        assert (r.n_words, r.n_hit, r.n_items) == (60000, 24000, 2000)


def test_golay_keys_meet():
    low, high, patterns = golay.tables()
    assert len({*golay.near_codewords(np.arange(1 << 23, dtype=np.int32)[:: 1 << 11])[:, 0]}) <= 1 << 12
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 4000, dtype=np.int32)
    near = golay.near_codewords(v)
    for bit in range(23):
        other = golay.near_codewords(v ^ (1 << bit))
        assert (other == near[:, :1]).any(axis=1).all() and (near == other[:, :1]).any(axis=1).all()


def test_fingerprint_links(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for k in (1, 2, 3, 3, 4):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(r) for r in simhash.group_links(spark.createDataFrame([(x, x) for x in signed], "fp long, own long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want
    one = spark.createDataFrame([(x,) for x in signed], "fp long")
    def blocks(x):
        return sum((x >> 16 * b & 0xFFFF) != 0 for b in range(4))
    assert {tuple(r) for r in simhash.block_links(one).collect()} == {(a, b) for a, b in want if blocks((a ^ b) & (1 << 64) - 1) == 1}
    group = brute.classes(fps)
    least = {g: min(signed[i] for i in range(len(fps)) if group[i] == g) for g in set(group)}
    named = {r.fp: r.component for r in simhash.fingerprint_components(one).collect()}
    assert set(named) == set(signed) and len(set(named.values())) == len(least)
    assert len({(named[x], least[g]) for x, g in zip(signed, group)}) == len(least)
    assert simhash.fingerprint_components(one.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect())
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for u, v in links:
        if u is not None and u != v:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in list(up)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    mine = _pairs(docs, "doc_id", "text")
    prints = [brute.fingerprint(t) for _, t in mine]
    group = brute.classes(prints)
    least = {}
    for g, (i, _) in zip(group, mine):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(mine, prints, group))
    twice = spark.createDataFrame([(1, "one two three four"), (5, "one two three four"), (5, "quite another text it is"), (5, "quite another text it is")], "doc_id long, text string")
    assert sorted(simhash.keep_one(twice).collect()) == [(1, "one two three four"), (5, "quite another text it is")]
    for most in (simhash.BROADCAST_ROWS, -1):
        simhash.BROADCAST_ROWS, before = most, simhash.BROADCAST_ROWS
        kept = simhash.keep_one(docs.where("doc_id IS NOT NULL"))
        assert kept.columns == docs.columns and kept.count() == len(set(group[k] for k, (i, _) in enumerate(mine) if i is not None))
        assert simhash.keep_one(docs).where("doc_id IS NULL").count() <= 1 and simhash.keep_one(docs.where("false")).count() == 0
        assert sorted(simhash.keep_one(twice).collect()) == [(1, "one two three four"), (5, "quite another text it is")]
        simhash.BROADCAST_ROWS = before
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    hot = spark.range(common.HOT_LEAST + 5).selectExpr("id AS doc_id", "'same old text here' AS text").unionByName(spark.createDataFrame([(9999, "word " * 200000)], "doc_id long, text string"))
    assert Counter(r.component_id for r in simhash.near_duplicates(hot).collect()) == {0: common.HOT_LEAST + 5, 9999: 1}


def test_license_scan(spark, docs):
    rows = license_scan.scan(docs).collect()
    want = Counter()
    for i, t in _pairs(docs, "doc_id", "text"):
        n, places = brute.phrase_places(t, license_scan.PHRASES)
        starts = [a for a, _ in places]
        want[(i, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert license_scan.scan(docs.where("false")).count() == 0


def test_license_templates_with_edits(spark):
    text = license_scan.TEMPLATES[3][2].replace("free of charge", "entirely free of any charge").replace("merge,", "")
    d = spark.createDataFrame([(1, "intro words " + text + " tail"), (2, "permission is hereby given to nobody at all")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert got[1].labels == "mit" and 0.6 <= got[1].score < 1 and got[1].spans[0].start == 2
    assert got[2].labels == "" and got[2].score == 0


def test_license_spans_are_where_templates_were_put(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        tpl = rng.randrange(len(license_scan.TEMPLATES))
        label, _, text = license_scan.TEMPLATES[tpl]
        before, after = [f"p{rng.randrange(99)}" for _ in range(rng.randrange(40))], [f"q{rng.randrange(99)}" for _ in range(5)]
        rows.append((i, " ".join(before) + "\n" + text + " " + " ".join(after), "x", "y"))
        want[i] = (len(before), len(before) + len(brute.words(text)), label)
    d = spark.createDataFrame(rows, "doc_id long, text string, labels string, votes string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert all(want[i] in {(s.start, s.end, s.label) for s in got[i].spans if s.cover == 1} and want[i][2] in got[i].labels.split(",") for i in want)
    assert all(s.start >= want[i][0] and s.end <= want[i][1] for i in want for s in got[i].spans)


def test_license_needs_its_name(spark):
    texts = ["The band licensed under the old rule a song", "licensed under the apache license version 2 0", "released under the old license", "gnu lesser general public license as published by", "license mit the under released"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(d).collect()} == {0: "", 1: "apache-2.0", 2: "", 3: "gpl", 4: ""}  # of the third only the base phrase
    with pytest.raises(ValueError):
        license_scan.scan(d, templates=[("short", "", "two words")])
    with pytest.raises(ValueError):
        license_scan.scan(d, templates=[("odd", "name", "three other words")])


def test_license_scan_of_a_long_text(spark):
    d = spark.createDataFrame([(1, "licensed under the " * 50000 + "MIT License. cc by")], "doc_id long, text string")
    r = license_scan.scan(d).first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (150004, 1, 150002, "cc-by") and "mit" in r.labels


def test_license_phrase_back_to_back(spark):
    d = spark.createDataFrame([(n, "intro " + "under the MIT License " * n + "tail") for n in (1, 2, 3, 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert {n: r.labels for n, r in got.items()} == {1: "mit", 2: "mit", 3: "mit", 9: "mit"}
    assert {x.start for x in got[9].spans} == {1 + 4 * k for k in range(9)}


def test_quality_rules(spark, docs):
    rows = quality_rules.rule_counts(docs).collect()
    want = Counter((i, *brute.rule_base(t)) for i, t in _pairs(docs, "doc_id", "text"))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert quality_rules.rule_counts(docs.where("false")).count() == 0


def test_host_lines_deplete(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{body} {i}\nShared  LINE here", "h") for i in range(30)] + [(100 + i, "shared line here\n" + " ".join(f"a{k}" for k in range(70)), "h") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.rule_counts(d, share=0.4, least=5).collect()}
    assert got[0].kept and got[0].lost_words == 3 and not got[100].kept
    for most in (quality_rules.BROADCAST_LINES, -1):
        clean = {r.doc_id: r.text for r in quality_rules.clean(d, share=0.4, least=5, broadcast_lines=most).collect()}
        assert set(clean) == set(range(30)) and clean[3] == f"{body} 3"
        assert {r.doc_id: r for r in quality_rules.rule_counts(d, share=0.4, least=5, broadcast_lines=most).collect()} == got


def test_clean_edges(spark, docs):
    want = Counter((i, t) for i, t in _pairs(docs, "doc_id", "text") if not brute.rule_base(t)[5])
    for once in (True, False):
        left = quality_rules.clean(docs, copies_once=once)
        assert left.columns == docs.columns and Counter(_pairs(left, "doc_id", "text")) == want
        assert quality_rules.clean(docs.where("false"), copies_once=once).count() == 0
    clash = quality_rules.base_counts(docs.withColumn("n_words", F.lit("mine")))
    assert clash.columns.count("n_words") == 1 and dict(clash.dtypes)["n_words"] == "bigint"


def test_repeats_of_a_long_text(spark):
    w = [f"w{i}" for i in range(100000)]
    d = spark.createDataFrame([(1, " ".join(w + w[10:14]), "h")], "doc_id long, text string, source string")
    assert quality_rules.rule_counts(d).first().n_repeat_words == 8


def test_copies_of_a_text_are_no_boilerplate(spark, tmp_path):
    clean = "\n".join(" ".join(f"c{k}w{i}" for i in range(30)) for k in range(3))
    near = "\n".join(" ".join(f"n{k}w{i}" for i in range(30)) for k in range(3))
    rows = [(i, clean, "h") for i in range(100)] + [(100 + i, " ".join(f"d{i}w{k}" for k in range(60)) + "\nShared footer", "h") for i in range(170)]
    rows += [(300 + i, f"{near}\nnumber {i}", "h") for i in range(30)] + [(400, None, "h"), (401, None, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, str(tmp_path)).collect()}
    assert all(got[i].kept and got[i].lost_words == 0 for i in range(100)) and got[100].lost_words == 2
    assert not any(got[300 + i].kept for i in range(30))  # near copies beyond the limit count each
    left = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, d, "").collect()}
    assert set(left) == set(range(270)) and left[5] == clean


def test_token_counts(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    texts = docs.unionByName(spark.createDataFrame([(900, "a<|endoftext|>b  c's 12", None, None, 1, "", "")], docs.schema))
    cache = "file://" + str(tmp_path / "cache")
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in _pairs(texts, "doc_id", "text"))
    for _ in range(2):  # the second run has no misses
        assert Counter(map(tuple, token_count.count_tokens(texts, BYTE, cache).collect())) == want
    stored = token_count.read_cache(spark, cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in _pairs(texts, "doc_id", "text")})
    long = " ".join(random.Random(0).choices(["alpha", "béta", "x9", "don't"], k=4000))
    assert len(list(token_count.cut(long, 500))) > 20
    assert sum(len(lib.encode(p, add_special_tokens=False).ids) for p in token_count.cut(long, 500)) == len(lib.encode(long, add_special_tokens=False).ids)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(5)
    mine = bpe.WordTokenizer(WORD, cache_words=50)
    alphabet = "abcdefghint'é ΣİßÀ12#<>|\n中"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(800)] + ["a<|startoftext|>B<|endoftext|>", "aaaaaaaaaaaaaaaa", "Ᲊ՘"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        parts = list(mine.encode(t))
        assert np.frombuffer(b"".join(parts), dtype="<u4").tolist() == ids, t
        assert b"".join(mine.decode(iter(parts))).decode() == lib.decode(ids, skip_special_tokens=False)
    want = Counter()
    for i, t in _pairs(docs, "doc_id", "text"):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs, WORD).collect())) == want
    both = bpe.digests(docs, WORD, with_ids=True).collect()
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in both) and len(both) == docs.count()
    back = bpe.decode_ids(bpe.encode_texts(docs, WORD), WORD).where("doc_id = 5").first().text
    t = docs.where("doc_id = 5").first().text
    assert back == lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 3), (3, 4)):
        index = hilbert.curve(dims, bits)
        assert sorted(index) == list(range(1 << dims * bits))
        cells = {h: [c >> (bits * (dims - 1 - d)) & ((1 << bits) - 1) for d in range(dims)] for c, h in enumerate(index)}
        assert all(sum(abs(a - b) for a, b in zip(cells[h], cells[h + 1])) == 1 for h in range(len(index) - 1))
    with pytest.raises(ValueError):
        hilbert.curve(5, 4)


def test_shards(spark, docs):
    slim = docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    axes = [hilbert.category(F.col("source"), 4), hilbert.magnitude(F.col("size"), 4)]
    rows = hilbert.shard_rows(slim, axes, F.md5(F.concat_ws(":", "doc_id", "digest")), bucket_rows=3).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    ordered = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    assert hilbert.shard_rows(slim.where("false"), axes, F.col("digest")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_shard_query(spark):
    rows = queries.op9_hilbert_sharding(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op4_language_id(spark, sf).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    model = langid.fit(docs)
    rows = langid.predict(docs, model).collect()
    letters = [bool(t) and any(map(str.isalpha, t)) for _, t in _pairs(docs, "doc_id", "text")]
    assert sum(r.lang_pred == "und" for r in rows) == letters.count(False)
    none = langid.fit(docs.where("false"))
    assert none.langs == [] and langid.predict(docs, none).where("lang_pred <> 'und'").count() == 0


def test_backpropagation():
    rows = [(b"ab" * 20, "p"), (b"ba c" * 9, "q")]
    m = langid.train(rows, hidden=2, epochs=60, rate=0.05)
    assert [m.langs[i] for i in langid.pooled(m, [r[0] for r in rows]).argmax(axis=1)] == ["p", "q"]


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    m = langid.fresh(["a", "b", "c"], hidden=3, kind=np.float64)
    x, size = rng.integers(97, 101, (4, 9), dtype=np.uint8), np.array([9, 1, 6, 9])
    y, weight = np.array([0, 2, 1, 1]), np.array([1.0, 2.0, 0.5, 1.5])
    _, grads = langid.loss_and_gradients(m, x, size, y, weight)
    for q, g in zip(m.params(), grads):
        flat, gf = q.reshape(-1), g.reshape(-1)
        live = np.flatnonzero(gf)
        for i in [*rng.choice(live, min(25, len(live)), replace=False), *rng.integers(0, len(flat), 5)]:
            before = flat[i]
            flat[i] = before + 1e-5
            up = langid.loss_and_gradients(m, x, size, y, weight)[0]
            flat[i] = before - 1e-5
            down = langid.loss_and_gradients(m, x, size, y, weight)[0]
            flat[i] = before
            assert math.isclose((up - down) / 2e-5, gf[i], rel_tol=1e-4, abs_tol=1e-8)


def test_padding_and_order_do_not_matter():
    m = langid.fresh(["a", "b"], hidden=4)
    texts = [b"abc", b"x" * 1500, b"", b"de" * 300, b"q"]
    alone = np.concatenate([langid.pooled(m, [t]) for t in texts])
    assert np.allclose(langid.pooled(m, texts), alone, atol=1e-5) and np.allclose(alone[2], 0.5)


def test_many_languages_are_all_learned(spark):
    rows = [(i, chr(97 + (i % 70) // 26) + chr(97 + (i % 70) % 26) * 30, f"l{i % 70:02d}", "x", 1.0) for i in range(1400)]
    d = spark.createDataFrame(rows + rows[:70], "doc_id long, text string, lang string, lang_pred string, score double")
    picked = langid.sample(d, "doc_id", "text", "lang", per_lang=5)
    assert {lang for _, lang in picked} == {f"l{i:02d}" for i in range(70)}
    assert Counter(lang for _, lang in picked) == {f"l{i:02d}": 5 for i in range(70)} and picked == langid.sample(d.repartition(3), "doc_id", "text", "lang", per_lang=5)
    m = langid.train(picked, epochs=1)
    got = langid.predict(spark.createDataFrame([(1, "word " * 200000), (2, None), (2, None), (None, "12 34")], "doc_id long, text string"), m).collect()
    assert len(got) == 4 and Counter(r.lang_pred for r in got)["und"] == 3 and [r.held_out for r in got if r.doc_id is None] == [False]


def _symbols(t):
    return [0, 0, 0, 0, *(ord(c) + 2 for c in t), 1]


def _brute_log_probability(trusted):
    """Interpolated modified Kneser-Ney by its definition, on tuples."""
    levels = {5: Counter()}
    for t in trusted:
        s = _symbols(t)
        levels[5].update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    for k in range(4, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {k: kn_quality.discounts(tuple(sum(n == j for n in levels[k].values()) for j in range(1, 5))) for k in levels}

    def less(k, n):
        return d[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(levels[1]) + 1)
        mates = [n for h, n in levels[k].items() if h[:-1] == g[:-1]]
        if not mates:
            return below
        own = levels[k][g] - less(k, levels[k][g]) if g in levels[k] else 0
        return own / sum(mates) + sum(less(k, n) for n in mates) / sum(mates) * below

    return lambda g: math.log(p(g))


def _packed(g):
    return g[0] << 21 | g[1], g[2] << 42 | g[3] << 21 | g[4]


def test_kneser_ney_equals_its_definition(spark):
    trusted = ["abab acab", "ab ba", "", "日本 aé𝔘", "abab"]
    counts = kn_quality.gram_counts(spark.createDataFrame([(t,) for t in trusted], "text string"))
    want = Counter(_packed(tuple(s[i - 4 : i + 1])) for s in map(_symbols, trusted) for i in range(4, len(s)))
    assert {(r.hi, r.lo): r.n for r in counts.collect()} == dict(want)
    log_p = _brute_log_probability(trusted)
    others = ["abba", "日a", "xyz", "a"]
    asked = {tuple(s[i - 4 : i + 1]) for s in map(_symbols, trusted + others) for i in range(4, len(s))}
    got = {(r.hi, r.lo): r.lp for r in kn_quality.log_probabilities(counts, spark.createDataFrame([_packed(g) for g in asked], "hi long, lo long")).collect()}
    assert len(got) == len(asked) and all(math.isclose(got[_packed(g)], log_p(g), rel_tol=1e-9) for g in asked)
    every = sorted({c for t in trusted for c in _symbols(t)[4:]}) + [999]
    for context in ((0, 0, ord("a") + 2, ord("b") + 2), (7, 7, 7, 7)):
        assert math.isclose(sum(math.exp(log_p((*context, c))) for c in every), 1.0, rel_tol=1e-9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(trusted + others)] + [(99, None)], "key long, text string")
    table = spark.createDataFrame([(*_packed(g), log_p(g), 1) for g in asked], "hi long, lo long, lp double, n long")
    for most in (kn_quality.BROADCAST_GRAMS, -1):
        rows = {r.key: r for r in kn_quality.text_sums(docs, table, most).collect()}
        for i, t in [*enumerate(trusted + others), (99, "")]:
            s = _symbols(t)
            assert rows[i].symbols == len(t) + 1 and math.isclose(rows[i].lp, sum(log_p(tuple(s[j - 4 : j + 1])) for j in range(4, len(s))), rel_tol=1e-9)


def test_grams_of_a_long_text_in_parts(spark):
    piece, kn_quality._PIECE = kn_quality._PIECE, 7
    t = "some längere text 𝔘 end" * 3
    parts = list(kn_quality.grams(t))
    kn_quality._PIECE = piece
    whole = list(kn_quality.grams(t))
    assert len(parts) > 5 and all((np.concatenate([p[i] for p in parts]) == whole[0][i]).all() for i in (0, 1))


def test_quality_classifier(spark, docs):
    rng = random.Random(0)
    good = [(1000 + i, " ".join(rng.choices(["these", "are", "plain", "words", "of", "prose"], k=40)), "en", "s", 1, "", "") for i in range(40)]
    bad = [(2000, "#$%&" * 60, "en", "s", 1, "", ""), (2001, None, "en", "s", 1, "", "")]
    d = spark.createDataFrame(good + bad, docs.schema)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(2000, 0), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in kn_quality.classify(d, labels).collect()}
    assert len(rows) == 42 and sum(rows[i].kept for i, *_ in good) >= 36 and not rows[2000].kept and not rows[2001].kept
    assert rows[1000].n_chars == len(good[0][1])
    many = d.unionByName(d.where("doc_id IN (2000, 1003)"))
    few, shuffled = (kn_quality.classify(many, labels, broadcast_grams=n).collect() for n in (kn_quality.BROADCAST_GRAMS, -1))
    assert Counter(map(tuple, few)) == Counter(map(tuple, shuffled)) and len(few) == 44
    assert kn_quality.classify(d, labels.where("false")).where("kept").count() == 41
    assert kn_quality.classify(d.where("false"), labels).count() == 0


def test_quality_sees_strange_runs(spark):
    rng, text = random.Random(4), []
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ada", "ilo", "une")]
    for _ in range(60):
        text.append(" ".join(rng.choices(vocab, k=60)))
    backwards = text[0][::-1]
    rows = [(i, t, "en") for i, t in enumerate(text)] + [(100, backwards, "en"), (101, "b d f g k l " * 30, "en"), (102, " \n ", "en"), (103, "中文字符" * 30, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kn_quality.classify(d, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert sum(got[i].kept for i in range(60)) >= 58 and not any(got[i].kept for i in (100, 101, 102, 103))


def test_quality_threshold_has_no_slack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["some", "plain", "words", "of", "prose"], k=50)), "en") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(kn_quality.HELD_OUT)) == 0
    got = kn_quality.classify(d, d.selectExpr("doc_id", "1 AS quality")).withColumn("measured", measured).collect()
    assert {r.threshold for r in got} == {max(r.perplexity for r in got if r.measured)}


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, "a", None, "ask", '{"b": 1, "a": "x"}'), (1, "b", "a", "ask", '{"a": 1}'), (1, "c", "b", "go", "{}"), (1, "d", "e", "ask", '{"a": "x"}'), (1, "e", "d", "ask", '{"a": "x"}'),
                                   (1, None, None, "ask", "no json"), (2, "z", None, "ask", '{"a": "x", "q": 2}'), (2, "z", None, "ask", '{"a": "x"}')], "conv long, call_id string, parent string, name string, arguments string")
    results = spark.createDataFrame([(1, "a", "r"), (1, "x", None), (1, "d", "r"), (1, "e", "r"), (1, "b", "r"), (1, "b", "s")], "conv long, call_id string, content string")
    schemas = {"ask": {"a": toolcalls.Param("string"), "b": toolcalls.Param("integer", required=False)}}
    rows = toolcalls.link_calls(calls, results, schemas).collect()
    got = {(r.kind, r.conv, r.call_id, r.errors): (r.status, r.position) for r in rows}
    assert got[("call", 1, "a", "")] == ("ok", 0) and got[("result", 1, "a", "")] == ("ok", 1)
    assert got[("call", 1, "b", "type:a")] == ("invalid", 2) and got[("result", 1, "b", "")] == ("duplicate", 3)
    assert got[("call", 1, "c", "unknown_tool")] == ("invalid", 4)
    assert got[("call", 1, "d", "")] == ("cycle", None) and got[("call", 1, "e", "")] == ("cycle", None)
    assert got[("call", 1, None, "bad_json")][0] == "invalid" and got[("result", 1, "x", "")] == ("orphan", None)
    assert got[("call", 2, "z", "unknown:q")][0] == "invalid" and got[("call", 2, "z", "")][0] == "duplicate"
    assert next(r.message for r in rows if r.kind == "call" and r.call_id == "a") == '{"arguments":{"a":"x","b":1},"id":"a","name":"ask","type":"call"}'
    assert len(rows) == 14


def test_long_chain(spark):
    n = 150
    calls = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}", "ask", "{}") for i in range(n)], "conv long, call_id string, parent string, name string, arguments string")
    got = {r.call_id: r.depth for r in toolcalls.depths(calls.select("conv", "call_id", "parent")).collect()}
    assert got == {f"c{i}": i for i in range(n)}


def test_many_equal_rows(spark, tmp_path):
    n = 3 * hilbert.COPIES + 7
    d = spark.range(n).selectExpr("1L AS doc_id", "'h' AS source", "'x' AS digest").unionByName(spark.createDataFrame([(None, None, None), (2, "g", "y")], "doc_id long, source string, digest string"))
    sharded = hilbert.shard_rows(d, [hilbert.category(F.col("source"), 4)], F.md5(F.concat_ws(":", "doc_id", "digest")))
    rows = sharded.collect()
    assert Counter(r.doc_id for r in rows) == {1: n, None: 1, 2: 1}
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s, c in Counter(r.shard for r in rows).items() for k in range(c))
    hilbert.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n + 2
    hilbert.write_shards(hilbert.shard_rows(d.where("false"), [hilbert.category(F.col("source"), 4)], F.col("digest")), str(tmp_path / "none"))
    assert common.repeat_rows(spark.createDataFrame([(1, n), (2, 1)], "k int, times long"), "times").groupBy("k").count().orderBy("k").collect() == [(1, n), (2, 1)]


def test_every_turn_has_a_row(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (1, None, "user", "v"), (1, 3, None, "n"), (None, 0, "user", "long " * 20000), (None, 1, "tool", None), (1, 0, "system", "s")]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, call_id string, message string")
    def linked(t):
        return toolcalls.link_calls(*toolcalls.chat_calls(t), toolcalls.CHAT_SCHEMAS).unionByName(toolcalls.other_messages(t)).collect()
    got = linked(d)
    assert Counter(r.kind for r in got) == {"message": 4, "call": 3, "result": 1} and linked(d.where("false")) == []
    assert sorted(r.message for r in got if r.kind == "message") == ['{"content":"n","turn":3,"type":"message"}'] + ['{"content":"s","role":"system","turn":0,"type":"message"}'] * 2 + ['{"role":"tool","turn":1,"type":"message"}']
    assert next(r for r in got if r.call_id is None and r.kind == "call").errors == "missing:turn"


def test_bpe_equals_the_library_on_every_code_point():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    lib.no_truncation()
    lib.no_padding()
    mine = bpe.WordTokenizer(WORD)

    def same(t):
        return np.frombuffer(b"".join(mine.encode(t)), dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids

    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    assert [hex(c) for c in points[::3] if not same("é" + chr(c) + "̧b")] == []
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 128), rng.choice(points)])) for _ in range(rng.randrange(1, 25))) for _ in range(10000)]
    assert [t for t in texts if not same(t)] == []
    assert same("".join(rng.choices("abcdefgh", k=3 * bpe._LONG_WORD))) and same("word\n" * 60000 + "x" * 70000)


def test_bpe_of_no_rows(spark, docs):
    assert bpe.digests(docs.where("false"), WORD).count() == 0 and bpe.encode_texts(docs.where("false"), WORD).count() == 0
    assert bpe.decode_ids(bpe.encode_texts(docs, WORD).where("false"), WORD).count() == 0


def test_token_counts_of_copies_and_no_rows(spark, docs, tmp_path):
    d = spark.range(common.HOT_LEAST + 50).selectExpr("id AS doc_id", "'one two' AS text", "'c' AS digest", "1 AS n_tokens").unionByName(
        spark.createDataFrame([(None, None, "d", 2), (None, None, "d", 2), (-1, "three, words here", "e", 3)], "doc_id long, text string, digest string, n_tokens int"))
    cache = "file://" + str(tmp_path / "cache")
    want = Counter((t, token_count.count([t or ""], BYTE)[0]) for t in ("one two", None, "three, words here"))
    got = token_count.count_tokens(d, BYTE, cache)
    counts = {t: n for t, n in want}
    assert Counter((r.n_bytes, r.n_tokens) for r in got.collect()) == Counter({(7, counts["one two"]): common.HOT_LEAST + 50, (0, 0): 2, (17, counts["three, words here"]): 1})
    assert token_count.count_tokens(docs.where("false"), BYTE, cache).count() == 0 and token_count.read_cache(spark, cache).count() == 3
