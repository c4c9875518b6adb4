"""DuckDB counterparts of the named queries."""

from __future__ import annotations

from paperlake.functions.text import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: Paragraphs and their boxes.
_LAY = r"""para AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
seg AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS content FROM para),
lay AS (SELECT doc_id, ord, CAST(1 + ord // 40 AS BIGINT) AS page, content,
 CASE WHEN ord % 10 = 0 THEN 'Title' WHEN ord % 10 = 7 THEN 'table' WHEN ord % 10 = 9 THEN 'image_text' ELSE 'text' END AS type,
 CAST(50 + (ord % 2) * 600 AS BIGINT) AS x1, CAST(40 * ((ord // 2) % 20) AS BIGINT) AS y1,
 CAST(50 + (ord % 2) * 600 + least(500, 5 * length(content)) AS BIGINT) AS x2, CAST(40 * ((ord // 2) % 20) + 30 AS BIGINT) AS y2 FROM seg)"""

_ID = "'C-' || substr(sha1(CAST(doc_id AS VARCHAR) || '|' || {}), 1, 10)"

_JIT = "CAST(trunc((((doc_id * 31 + ord * 17) % 41) - 20) / (CASE model WHEN 'm1' THEN 2 ELSE 1 END)) AS BIGINT)"
_BOX = _LAY + f""",
truth AS (SELECT doc_id * 1000 + page AS image, ord AS truth_id, type, x1, y1, x2, y2 FROM lay),
found AS (SELECT doc_id * 1000 + page AS image, model, ord AS det_id, x1 + {_JIT} AS x1, y1 + {_JIT} AS y1, x2 + {_JIT} AS x2, y2 + {_JIT} AS y2
 FROM lay, (VALUES ('m1'), ('m2')) AS m(model) WHERE (doc_id + ord) % 11 <> 0)"""
_MATCH = "RECURSIVE " + _BOX + """,
pair0 AS (SELECT t.image, f.model, truth_id, det_id, (least(t.x2, f.x2) - greatest(t.x1, f.x1)) * (least(t.y2, f.y2) - greatest(t.y1, f.y1)) AS inter,
 (t.x2 - t.x1) * (t.y2 - t.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) AS areas
 FROM truth t JOIN found f ON t.image = f.image AND t.x1 < f.x2 AND f.x1 < t.x2 AND t.y1 < f.y2 AND f.y1 < t.y2),
pairs6 AS (SELECT image, model, truth_id, det_id, round(100.0::DOUBLE * inter / (areas - inter), 6) AS overlap FROM pair0),
pairs AS (SELECT image, model, truth_id, det_id, round(100.0::DOUBLE * inter / (areas - inter), 2) AS overlap FROM pair0),
cands AS MATERIALIZED (SELECT image, model, truth_id, list({'det_id': det_id, 'overlap': overlap} ORDER BY overlap DESC, det_id) AS c, row_number() OVER (PARTITION BY image, model ORDER BY truth_id) AS k FROM pairs WHERE overlap > 0 GROUP BY image, model, truth_id),
g AS (SELECT image, model, truth_id, k, c[1] AS m, [c[1].det_id] AS used FROM cands WHERE k = 1
 UNION ALL SELECT image, model, truth_id, k, list_extract(f, 1), CASE WHEN len(f) > 0 THEN list_append(used, f[1].det_id) ELSE used END FROM (
 SELECT c.image, c.model, c.truth_id, c.k, list_filter(c.c, lambda x: NOT list_contains(g.used, x.det_id)) AS f, g.used FROM g JOIN cands c ON c.image = g.image AND c.model = g.model AND c.k = g.k + 1)),
matches AS (SELECT image, model, truth_id, m.det_id AS det_id, m.overlap AS overlap FROM g WHERE m IS NOT NULL)"""
_OUT = _MATCH + """,
models AS (SELECT DISTINCT model FROM found),
rest AS (SELECT image, model, truth_id, row_number() OVER (PARTITION BY image, model ORDER BY truth_id) AS n FROM (SELECT image, model, truth_id FROM truth, models) a ANTI JOIN matches USING (image, model, truth_id)),
free AS (SELECT image, model, det_id, row_number() OVER (PARTITION BY image, model ORDER BY det_id) AS n FROM found ANTI JOIN matches USING (image, model, det_id)),
outcome AS (SELECT image, model, truth_id, det_id, overlap, 'match-found' AS status FROM matches
 UNION ALL SELECT image, model, truth_id, det_id, CAST(NULL AS DOUBLE), CASE WHEN det_id IS NULL THEN 'entity-not-extracted' ELSE 'match-not-found' END FROM rest LEFT JOIN free USING (image, model, n))"""


def _confusion(by: str, source: str = "outcome") -> str:
    share = "CASE WHEN {b} > 0 THEN round(tp / ({b}), 6) ELSE 0.0::DOUBLE END"
    return f"""SELECT {by}, images, tp, fp, fn, {share.format(b='tp + fp')} AS precision, {share.format(b='tp + fn')} AS recall, {share.format(b='tp + fp + fn')} AS accuracy FROM (
 SELECT {by}, count(DISTINCT image) AS images, count_if(status = 'match-found' AND overlap >= 80)::BIGINT AS tp, count_if(status <> 'entity-not-extracted' AND NOT coalesce(status = 'match-found' AND overlap >= 80, false))::BIGINT AS fp,
 count_if(status = 'entity-not-extracted')::BIGINT AS fn FROM {source} GROUP BY {by})"""


def _report(rows: str, key: str, value: str, threshold: float) -> str:
    return f"""SELECT {key}, total, valid, hits, mean, CASE WHEN valid > 0 THEN round(hits / valid, 6) ELSE 0.0::DOUBLE END AS precision, round(hits / total, 6) AS recall FROM (
 SELECT {key}, count(*) AS total, count_if({value} IS NOT NULL AND {value} <> -1)::BIGINT AS valid, count_if({value} >= {threshold})::BIGINT AS hits,
 round(sum(CASE WHEN {value} <> -1 THEN {value} END) / count(*), 6) AS mean FROM {rows} GROUP BY {key})"""


_TOK = f"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda t: t NOT IN ({_STOPS}))"


def _tokens(col: str) -> str:
    return _TOK.format(col)


_BM25 = f"""dt AS (SELECT doc_id AS id, {_tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS mean FROM dt),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT qid, id, round(sum(times * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
 FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY qid, id)"""


def _top(source: str, k: int, order: str = "score DESC") -> str:
    return f"SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM {source} QUALIFY rank <= {k}"


_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _vec(where: str, normal: bool, fn: str = "{}") -> str:
    if normal:
        plain = "list_transform(embedding, lambda x: x::DOUBLE / nrm)"
        src = f"(SELECT vec_id, label, CASE WHEN nrm > 0 THEN {plain} ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings))"
    else:
        src = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
    return f"""vx AS MATERIALIZED {src},
vs AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.label, round({fn.format(_DIST.format(a='q.v', b='e.v'))}, 6) AS score FROM vx q, vx e WHERE {where})"""


_QSET = "q.vec_id % 100 = 0"
_HYB = _BM25 + ", " + _vec("q.vec_id IN (SELECT item_id FROM benchmark)", True) + f", sp AS ({_top('bm', 10)}), de AS ({_top('vs', 10, 'score')})"
_DIMS = "dims AS (SELECT doc_id, page, max(y2) + 20 AS height FROM lay GROUP BY ALL)"
_REG = "reg AS (SELECT ord AS region_id, doc_id, page, 0 AS rx1, y1 - 10 AS ry1, 900 AS rx2, y2 + 40 AS ry2 FROM lay WHERE ord % 8 = 0)"
_JOIN = "string_agg(content, chr(10) ORDER BY ord)"


def _near(gap: str, shared: str, whole: str) -> str:
    return f"""WITH {_LAY}, j AS (SELECT a.doc_id, a.page, a.ord, {gap} AS distance, b.ord AS near_ord FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord
 WHERE {gap} >= 0 AND {shared} > 0 AND {shared} >= {whole})
SELECT doc_id, page, ord, near_ord, distance FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY distance, near_ord) = 1"""


_ONE = r"regexp_replace(trim(content), '\s+', ' ', 'g')"


def _words(conf: str, pick: str = "text") -> str:
    """Lines and their words as tokens; words are numbered over the page."""
    return f"""c AS (SELECT doc_id, page, ord, {_ONE} AS content, x1, y1, x2, y2 FROM lay), w AS (SELECT doc_id, page, ord, x1, y1, x2, y2, unnest(string_split(content, ' ')) AS text, generate_subscripts(string_split(content, ' '), 1) AS i FROM c)
SELECT doc_id, page, 'line' AS kind, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS ord, content AS text, x1::DOUBLE AS x, y1::DOUBLE AS y, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h, -1.0::DOUBLE AS conf FROM c
UNION ALL SELECT doc_id, page, 'word', row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, i) - 1, text, x1, y1, x2 - x1, y2 - y1, {conf} FROM w"""


_CELLS = _LAY + """, k AS (SELECT doc_id, page, ord // 8 AS table_no, CASE WHEN ord % 8 = 4 THEN ' ' ELSE split_part(trim(content), ' ', 1) END AS text, x1, y1 FROM lay),
cells AS (SELECT doc_id, page, table_no, 'p' || page || '_tb' || table_no AS cell_id, dense_rank() OVER (PARTITION BY doc_id, page, table_no ORDER BY y1) - 1 AS row_index, dense_rank() OVER (PARTITION BY doc_id, page, table_no ORDER BY x1) - 1 AS column_index, text FROM k)"""

#: Each token's nearest one below.
_BELOW = """below AS (SELECT a.doc_id, a.page, a.ord, b.ord AS near_ord FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord AND b.y1 >= a.y2 AND least(a.x2, b.x2) > greatest(a.x1, b.x1)
 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY b.y1 - a.y2, b.ord) = 1)"""


def _two_anchors(p: str, first: str, second: str) -> str:
    """Regions from anchors of the first kind, the lowest first, to the nearest one of the second kind that is left."""
    return f"""{p}_a AS (SELECT doc_id, page, ord, x1, y1, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC, y1 DESC, ord) AS rk FROM lay WHERE {first}),
{p}_c AS MATERIALIZED (SELECT a.doc_id, a.page, a.x1, a.y1, list({{'page': b.page, 'ord': b.ord, 'x': b.x1, 'y': b.y1}} ORDER BY b.page, b.y1, b.ord) AS c, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.rk) AS k
 FROM {p}_a a JOIN lay b ON a.doc_id = b.doc_id AND ((a.page = b.page AND a.y1 < b.y1) OR a.page < b.page) WHERE {second.replace("type", "b.type").replace("ord %", "b.ord %")} GROUP BY a.doc_id, a.page, a.ord, a.x1, a.y1, a.rk),
{p}_g AS (SELECT doc_id, page, x1, y1, k, c[1] AS m, [c[1]] AS used FROM {p}_c WHERE k = 1
 UNION ALL SELECT doc_id, page, x1, y1, k, list_extract(f, 1), CASE WHEN len(f) > 0 THEN list_append(used, f[1]) ELSE used END FROM (
 SELECT c.doc_id, c.page, c.x1, c.y1, c.k, list_filter(c.c, lambda x: NOT list_contains(g.used, x)) AS f, g.used FROM {p}_g g JOIN {p}_c c ON c.doc_id = g.doc_id AND c.k = g.k + 1)),
{p}_r AS (SELECT *, unnest(range(page, m.page + 1)) AS pg FROM {p}_g WHERE m IS NOT NULL),
{p}_out AS (SELECT doc_id, pg AS page, (CASE WHEN page = m.page THEN least(x1, m.x) ELSE 0 END)::DOUBLE AS x1, (CASE WHEN page = m.page THEN least(y1, m.y) WHEN pg = page THEN y1 ELSE 0 END)::DOUBLE AS y1,
 (CASE WHEN page = m.page THEN greatest(x1, m.x) ELSE 1200 END)::DOUBLE AS x2, (CASE WHEN page = m.page THEN greatest(y1, m.y) WHEN pg = m.page THEN m.y ELSE 820 END)::DOUBLE AS y2 FROM {p}_r)"""


_TALL = _LAY + ", tall AS (SELECT doc_id, page, ord, type, content, x1, y1, x2, y2 + (ord % 3) * 10 AS y2 FROM lay)"
_WORDS = _LAY + ", wide AS (SELECT doc_id, page, ord, type, content, 60 * (ord % 20) AS x1, 50 * ((ord // 20) % 2) + ord % 3 * 6 AS y1, 60 * (ord % 20) + CASE WHEN ord % 5 = 0 THEN 5 ELSE 50 END AS x2, 50 * ((ord // 20) % 2) + ord % 3 * 6 + 30 AS y2 FROM lay)"
_OVER = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"


def _fold(source: str, table: str, order: str, linked: str, start: str, step: str, more: str = "") -> str:
    """Rows of a page in order, folded by recursion: state s, row k with adj, those before it that are linked."""
    return f"""WITH RECURSIVE {source}, it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) AS k FROM {table}),
ad AS MATERIALIZED (SELECT a.doc_id, a.page, a.k, any_value((a.x2 - a.x1) * (a.y2 - a.y1)) AS area, coalesce(list({{'j': b.k, 'area': (b.x2 - b.x1) * (b.y2 - b.y1)}} ORDER BY b.k) FILTER (b.k IS NOT NULL), []) AS adj
 FROM it a LEFT JOIN it b ON a.doc_id = b.doc_id AND a.page = b.page AND b.k < a.k AND {linked} GROUP BY a.doc_id, a.page, a.k),
f AS (SELECT doc_id, page, 0::BIGINT AS k, {start} AS s FROM (SELECT DISTINCT doc_id, page FROM it) UNION ALL SELECT f.doc_id, f.page, ad.k, {step} FROM f JOIN ad ON ad.doc_id = f.doc_id AND ad.page = f.page AND ad.k = f.k + 1),
z AS (SELECT doc_id, page, arg_max(s, k) AS s FROM f GROUP BY doc_id, page){more}"""


_NONE = "CAST([] AS BIGINT[])"
_ACCEPT = "CASE WHEN list_has_any(list_transform(ad.adj, lambda x: x.j), f.s) THEN f.s ELSE list_append(f.s, ad.k) END"
_ALIVE = "list_filter(ad.adj, lambda x: list_contains(f.s, x.j))"
_LARGER = f"CASE WHEN len({_ALIVE}) = 0 THEN list_append(f.s, ad.k) WHEN ad.area > list_max(list_transform({_ALIVE}, lambda x: x.area)) THEN list_append(list_filter(f.s, lambda y: NOT list_contains(list_transform({_ALIVE}, lambda x: x.j), y)), ad.k) ELSE f.s END"
_KEPT = "SELECT {c} FROM it JOIN z USING (doc_id, page) WHERE list_contains(z.s, it.k)"
_JOINS = "list_append(f.s, coalesce(list_min(list_transform(ad.adj, lambda x: f.s[x.j])), list_max(f.s) + 1, 0))"
_NEXT = """a.type NOT IN ('table', 'image_text') AND (a.type = b.type OR a.x2 - a.x1 <= 1.7::DOUBLE * (b.x2 - b.x1)) AND ((abs(b.y2 - a.y1) <= 12 AND (greatest(a.x1, b.x1) <= least(a.x2, b.x2)
 OR abs((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2) <= 0.5::DOUBLE * (b.x2 - b.x1))) OR (abs(b.x2 - a.x1) <= 30 AND greatest(a.y1, b.y1) <= least(a.y2, b.y2)) OR (""" + _OVER + "))"
_CHAIN = "a.x1 - b.x2 > 0 AND a.x1 - b.x2 <= 1.5::DOUBLE * (a.y2 - a.y1) AND b.y1 <= (a.y1 + a.y2) / 2 AND (a.y1 + a.y2) / 2 <= b.y2"
_PLACE = "coalesce(list_min(list_filter(list_transform(range(1, len(f.s.ends) + 1), lambda i: CASE WHEN list_contains(list_transform(ad.adj, lambda x: x.j), f.s.ends[i]) THEN i END), lambda i: i IS NOT NULL)), len(f.s.ends) + 1)"
_LINK = f"{{'ends': CASE WHEN {_PLACE} > len(f.s.ends) THEN list_append(f.s.ends, ad.k) ELSE list_transform(range(1, len(f.s.ends) + 1), lambda i: CASE WHEN i = {_PLACE} THEN ad.k ELSE f.s.ends[i] END) END, 'chain': list_append(f.s.chain, {_PLACE} - 1)}}"
_PHRASES = " SELECT doc_id, page, z.s.chain[it.k] AS phrase, string_agg(content, ' ' ORDER BY it.k) AS content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM it JOIN z USING (doc_id, page) GROUP BY ALL"


_GEN = _LAY + """, gen AS (SELECT *, 'native_pdf' AS technique FROM lay WHERE doc_id % 3 = 0 AND ord % 2 = 0 UNION ALL SELECT *, 'pdf_table_extraction' FROM lay WHERE doc_id % 3 = 0 AND (type = 'table' OR ord % 4 = 0)
 UNION ALL SELECT *, 'text' FROM lay WHERE doc_id % 3 = 1 UNION ALL SELECT *, 'ocr_based' FROM lay WHERE doc_id % 3 = 2)"""
_REST = _GEN + ", rest AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, page ORDER BY technique, ord) AS ord) FROM gen WHERE technique <> 'text')"


#: Embeddings as eight rows of eight grey values.
_PIX = """pix AS (SELECT vec_id AS image, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 600)) AS g FROM embeddings),
px AS (SELECT image, i // 8 AS y, i % 8 AS x, g[i + 1] AS v FROM (SELECT image, g, unnest(range(64)) AS i FROM pix))"""


def _share(x: str, y: str) -> str:
    return f"CASE WHEN len({y}) > 0 THEN round(len(list_intersect({x}, {y})) / len({y}), 6) ELSE 0 END"


_META = "(SELECT doc_id AS id, unnest(['lang_' || lang, 'src_' || source]) AS key FROM documents)"

SQL: dict[str, str] = {
    "paragraph_segments": f"WITH {_LAY} SELECT doc_id, ord, content FROM seg",
    "segment_chunks": f"WITH {_LAY}, k AS (SELECT *, page || '_segment_' || ord AS chunk_key FROM lay WHERE length(content) > 3 AND type <> 'table') SELECT doc_id, {_ID.format('chunk_key')} AS chunk_id, chunk_key, page, content, length(content)::BIGINT AS char_count FROM k",
    "page_chunks": f"WITH {_LAY}, g AS (SELECT doc_id, page, {_JOIN} AS content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lay GROUP BY doc_id, page) SELECT doc_id, {_ID.format('page')} AS chunk_id, page, content, length(content)::BIGINT AS char_count, x1, y1, x2, y2 FROM g",
    "typed_chunks_together": f"WITH {_LAY} SELECT doc_id, page || '_text_table_image_text' AS chunk_key, page, {_JOIN} AS content FROM lay WHERE type IN ('text', 'table', 'image_text') GROUP BY doc_id, page",
    "typed_chunks_separate": f"""WITH {_LAY} SELECT doc_id, page || '_text' AS chunk_key, page, {_JOIN} AS content FROM lay WHERE type = 'text' GROUP BY doc_id, page
 UNION ALL SELECT doc_id, page || '_' || type || '_' || row_number() OVER (PARTITION BY doc_id, page, type ORDER BY ord), page, content FROM lay WHERE type IN ('table', 'image_text')""",
    "clean_replace_delimit": rf"WITH {_LAY} SELECT doc_id, ord, replace(replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), 'the', 'THE'), 'THEr', 'ther') || ' |' AS content FROM lay",
    "title_merge": f"""WITH {_LAY}, g AS (SELECT *, sum(CASE WHEN type = 'Title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM lay)
SELECT doc_id, min(ord) AS ord, 'Title' AS type, string_agg(content, ':' ORDER BY ord) AS content FROM g WHERE type IN ('Title', 'text') AND grp > 0 GROUP BY doc_id, grp
UNION ALL SELECT doc_id, ord, type, content FROM g WHERE type NOT IN ('Title', 'text') OR grp = 0""",
    "bm25_stats": f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT row_number() OVER () AS r, doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY doc_id, term) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "bm25_topk": f"WITH {_BM25} {_top('bm', 5)}",
    "bm25_filtered_topk": f"""WITH {_BM25}, f AS ({_top('bm', 50)}), k AS (SELECT qid, id, score FROM f JOIN documents d ON d.doc_id = f.id WHERE lang = 'en'), t AS ({_top('k', 5)})
SELECT b.item_id AS qid, id, score, rank, CASE WHEN id IS NULL THEN 'no match' END AS message FROM benchmark b LEFT JOIN t ON t.qid = b.item_id""",
    "vector_l2_topk": f"WITH {_vec(_QSET, False)} {_top('vs', 5, 'score')}",
    "vector_normalized_topk": f"WITH {_vec(_QSET, True)}, t AS ({_top('vs', 5, 'score')}) SELECT q.vec_id AS qid, id, score, rank, CASE WHEN id IS NULL THEN 'no match' END AS message FROM (SELECT vec_id FROM embeddings q WHERE {_QSET}) q LEFT JOIN (SELECT * FROM t WHERE score BETWEEN 0 AND 1) t ON t.qid = q.vec_id",
    "vector_root_topk": f"WITH {_vec(_QSET + ' AND e.label = 1', False, 'sqrt({})')} {_top('vs', 5, 'score')}",
    "vector_prefilter_topk": f"WITH {_vec(_QSET, True)}, f AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= 100), k AS (SELECT * FROM f WHERE label IN (1, 2)) {_top('k', 5, 'score')}",
    "vector_roundrobin": f"""WITH {_vec(_QSET, True)}, f AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, id) <= 100),
w AS (SELECT *, CAST(label AS VARCHAR) AS value, list_position(['2', '0', '1'], CAST(label AS VARCHAR)) AS pos FROM f WHERE label IN (0, 1, 2)),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, value ORDER BY score, id) AS turn FROM w QUALIFY turn <= 5),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid ORDER BY turn, pos) <= 5)
SELECT qid, id, score, value, row_number() OVER (PARTITION BY qid ORDER BY score, id, pos) AS rank FROM k""",
    "hybrid_rrf": f"""WITH {_HYB}, e AS (SELECT qid, id, rank, 0 AS source FROM sp UNION ALL SELECT qid, id, rank, 1 FROM de),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(source * 1000 + rank) AS first FROM e GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM f QUALIFY rank <= 5""",
    "hybrid_merge": f"""WITH {_HYB}, a AS (SELECT qid, string_agg(id, ',' ORDER BY rank) AS s FROM sp GROUP BY qid), b AS (SELECT qid, string_agg(id, ',' ORDER BY rank) AS d FROM de GROUP BY qid)
SELECT qid, coalesce(s, '') AS sparse_ids, coalesce(d, '') AS dense_ids FROM a FULL JOIN b USING (qid)""",
    "vector_index_records": """WITH r AS (SELECT 'label-' || label AS collection, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, embedding FROM embeddings)
SELECT collection, pos, vec_id::VARCHAR AS id, 'vector ' || vec_id AS content, (vec_id % 2)::VARCHAR AS parity, len(embedding)::BIGINT AS vector_size,
 round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM r WHERE pos >= 5 AND pos < 40""",
    "vector_index_search": f"""WITH {_vec(_QSET, True)}, f AS (SELECT *, 'label-' || label AS collection FROM vs QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY score, id) <= 30),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score, id) AS rank FROM f WHERE id % 2 = 0 QUALIFY rank <= 5), w AS (SELECT * FROM k WHERE score BETWEEN 0 AND 1.2)
SELECT c.collection, q.vec_id AS qid, w.id::VARCHAR AS id, score, rank, CASE WHEN w.id IS NULL THEN 'no match' END AS message
FROM (SELECT vec_id FROM embeddings q WHERE {_QSET}) q, (SELECT DISTINCT 'label-' || label AS collection FROM embeddings) c LEFT JOIN w ON w.qid = q.vec_id AND w.collection = c.collection""",
    "chunk_index_search": " UNION ALL ".join(f"SELECT 'lang-{x}' AS collection, * FROM (WITH " + _BM25.replace("FROM documents)", f"FROM documents WHERE lang = '{x}')") + " " + _top('bm', 5) + ")" for x in ("en", "de")),
    "column_islands": f"""WITH {_LAY}, s AS (SELECT *, CASE WHEN coalesce(x1 > max(x2) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS new FROM lay),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS UNBOUNDED PRECEDING) AS island FROM s),
g AS (SELECT doc_id, page, island, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_segments FROM i GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, island) AS column_seq, page, x1, y1, x2, y2, n_segments FROM g""",
    "sequence_default": f"WITH {_LAY} SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS sequence FROM lay",
    "sequence_left_right": f"WITH {_LAY} SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x1, ord) AS sequence FROM lay",
    "sequence_zigzag": f"""WITH {_LAY}, j AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord) > 50 THEN 1 ELSE 0 END AS jump FROM lay),
s AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS UNBOUNDED PRECEDING) AS sub FROM j)
SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY sub, y1, x1, ord) AS sequence FROM s""",
    "header_footer_auto": f"""WITH {_LAY}, {_DIMS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page ORDER BY y1 RANGE BETWEEN 1 FOLLOWING AND 75 FOLLOWING) AS below,
 count(*) OVER (PARTITION BY doc_id, page ORDER BY y1 RANGE BETWEEN 75 PRECEDING AND 1 PRECEDING) AS above FROM lay),
l AS (SELECT *, (below <= 2 AND above = 0) OR (above <= 2 AND below = 0) AS lone FROM n)
SELECT doc_id, page, ord, CASE WHEN y1 <= height * 0.1::DOUBLE AND lone THEN 'header' WHEN y2 >= height * 0.9::DOUBLE AND lone THEN 'footer' ELSE 'body' END AS role FROM l JOIN dims USING (doc_id, page)""",
    "header_footer_manual": f"WITH {_LAY}, {_DIMS} SELECT doc_id, page, ord, CASE WHEN y2 <= height * 0.2::DOUBLE THEN 'header' WHEN y1 >= height * 0.85::DOUBLE THEN 'footer' ELSE 'body' END AS role FROM lay JOIN dims USING (doc_id, page)",
    "empty_line_marks": f"""WITH {_LAY}, g AS (SELECT *, ord % 2 AS c, lead(y1) OVER w - y2 AS gap, lead(content) OVER w AS nxt FROM lay WINDOW w AS (PARTITION BY doc_id, page, ord % 2 ORDER BY x1, y1, ord)),
m AS (SELECT *, avg(gap) OVER (PARTITION BY doc_id, page, c) AS mean FROM g)
SELECT doc_id, page, ord, CASE WHEN gap > mean AND (regexp_matches(trim(content), '[,.]$') OR regexp_matches(nxt, '^[A-Z]')) THEN content || chr(10) ELSE content END AS content FROM m""",
    "iou_match": f"WITH {_MATCH} SELECT * FROM pairs6",
    "greedy_match": f"WITH {_MATCH} SELECT * FROM matches",
    "unmatched_truth": f"WITH {_OUT} SELECT * FROM outcome",
    "confusion_matrix": f"WITH {_OUT} {_confusion('model')}",
    "avg_overlap": f"WITH {_OUT} SELECT model, round(avg(CASE WHEN overlap >= 80 THEN overlap END), 6) AS \"full\", round(avg(CASE WHEN overlap >= 70 AND overlap < 80 THEN overlap END), 6) AS partial, round(avg(CASE WHEN overlap < 70 THEN overlap END), 6) AS low FROM outcome WHERE overlap IS NOT NULL GROUP BY model",
    "class_combo_metrics": f"WITH {_OUT}, oc AS (SELECT o.*, type, CASE WHEN x2 - x1 > 300 THEN 'wide' ELSE 'narrow' END AS width FROM outcome o JOIN truth USING (image, truth_id)) {_confusion('model, type, width', 'oc')}",
    "detector_report": f"WITH {_OUT}, oc AS (SELECT o.*, type FROM outcome o JOIN truth USING (image, truth_id)) {_report('oc', 'type', 'overlap', 80)}",
    "structure_report": f"WITH r AS (SELECT p_brand, coalesce(round((1 - least(1.0::DOUBLE, abs((p_partkey % 3)::DOUBLE) / nullif(p_size::DOUBLE, 0))) * 100, 2), 0.0) AS row_accuracy FROM part) {_report('r', 'p_brand', 'row_accuracy', 90)}",
    "model_stats": f"""WITH {_OUT}, e AS (SELECT model, count(*) AS extracted FROM found GROUP BY model),
o AS (SELECT model, count(*) AS truth, count_if(status = 'match-found')::BIGINT AS matched, count_if(status <> 'match-found')::BIGINT AS unmatched, count_if(status = 'match-not-found')::BIGINT AS modified, count_if(status = 'entity-not-extracted')::BIGINT AS added FROM outcome GROUP BY model)
SELECT model, extracted, truth, matched, unmatched, modified, added, extracted + added AS final FROM e JOIN o USING (model)""",
    "band_match": f"""WITH {_BOX} SELECT f.image, model, f.det_id AS rec_id, min(truth_id) AS truth_id FROM found f JOIN truth t ON f.image = t.image
 AND abs(f.x1 - t.x1) <= 60 AND abs(f.y1 - t.y1) <= 60 AND abs(f.x2 - t.x2) <= 60 AND abs(f.y2 - t.y2) <= 60 GROUP BY ALL""",
    "truth_names": f"WITH {_BOX} SELECT image, truth_id, 'table_' || chr(CAST(64 + row_number() OVER (PARTITION BY image ORDER BY truth_id) AS INTEGER)) || '_' || x1 || '_' || y1 || '_' || x2 || '_' || y2 AS table_name FROM truth",
    "result_merge": f"""WITH {_BOX},
a AS (SELECT image, 0 AS rec_id, x1, y1, x2, y2, CASE WHEN det_id % 3 = 0 THEN x1 END AS rows FROM found WHERE model = 'm1'
 QUALIFY row_number() OVER (PARTITION BY image, x1, y1, x2, y2 ORDER BY det_id DESC) = 1),
b AS (SELECT image, min(det_id) OVER (PARTITION BY image, x1, y1, x2, y2) AS rec_id, x1, y1, x2, y2, x2 AS rows, y1 AS confidence FROM found WHERE model = 'm2'
 QUALIFY row_number() OVER (PARTITION BY image, x1, y1, x2, y2 ORDER BY det_id DESC) = 1),
a1 AS (SELECT a.* REPLACE (f.rec_id AS rec_id) FROM a JOIN (SELECT image, x1, y1, x2, y2, min(det_id) AS rec_id FROM found WHERE model = 'm1' GROUP BY ALL) f USING (image, x1, y1, x2, y2))
SELECT a1.image, a1.rec_id, a1.x1, a1.y1, a1.x2, a1.y2, coalesce(a1.rows, b.rows) AS rows, 'a' AS note, b.confidence FROM a1 JOIN b ON a1.image = b.image AND abs(a1.x1 - b.x1) <= 30 AND abs(a1.y1 - b.y1) <= 30
 QUALIFY row_number() OVER (PARTITION BY a1.image, a1.x1, a1.y1, a1.x2, a1.y2 ORDER BY b.rec_id) = 1""",
    "report_rows": f"""WITH {_OUT}, met AS (SELECT o.image, o.truth_id AS met_id, CASE WHEN status <> 'entity-not-extracted' THEN f.y1 END AS y1 FROM outcome o LEFT JOIN found f USING (image, model, det_id) WHERE model = 'm2' AND status <> 'match-not-found'),
rc AS MATERIALIZED (SELECT t.image, t.truth_id, list(met_id ORDER BY met_id) AS c, row_number() OVER (PARTITION BY t.image ORDER BY t.truth_id) AS k FROM truth t JOIN met m ON t.image = m.image AND (m.y1 IS NULL OR abs(t.y1 - m.y1) <= 80) GROUP BY t.image, t.truth_id),
rg AS (SELECT image, truth_id, k, c[1] AS m, [c[1]] AS used FROM rc WHERE k = 1
 UNION ALL SELECT image, truth_id, k, list_extract(f, 1), CASE WHEN len(f) > 0 THEN list_append(used, f[1]) ELSE used END FROM (
 SELECT c.image, c.truth_id, c.k, list_filter(c.c, lambda x: NOT list_contains(rg.used, x)) AS f, rg.used FROM rg JOIN rc c ON c.image = rg.image AND c.k = rg.k + 1))
SELECT t.image, t.truth_id, rg.m AS met_id FROM truth t LEFT JOIN rg USING (image, truth_id)""",
    "combined_report": f"""WITH {_OUT}, j AS (SELECT type, overlap, status = 'match-found' AS hit, (f.x2 - f.x1 - det_id % 4)::DOUBLE AS fw, (t.x2 - t.x1)::DOUBLE AS tw, (f.y2 % 90)::DOUBLE AS fh, (t.y2 % 90)::DOUBLE AS th
 FROM outcome o JOIN truth t USING (image, truth_id) LEFT JOIN found f USING (image, model, det_id)),
v AS (SELECT type, overlap, CASE WHEN hit THEN coalesce(round((1 - least(1.0::DOUBLE, abs(fw - tw) / nullif(tw, 0))) * 100, 2), 0) ELSE -1 END AS rows_ok, CASE WHEN hit THEN coalesce(round((1 - least(1.0::DOUBLE, abs(fh - th) / nullif(th, 0))) * 100, 2), 0) ELSE -1 END AS cols_ok FROM j),
sums AS (SELECT type, count(*) AS tables, {", ".join(f"round(sum(CASE WHEN {c} <> -1 THEN {c} END) / count(*), 6) AS {p}_mean, count_if({c} IS NOT NULL AND {c} <> -1)::BIGINT AS {p}_found, count_if({c} >= {t})::BIGINT AS {p}_hits" for p, c, t in (("td", "overlap", 80), ("row", "rows_ok", 90), ("col", "cols_ok", 90)))} FROM v GROUP BY type)
SELECT *, {", ".join(f"{p}_found - {p}_hits AS {p}_others, CASE WHEN {p}_found > 0 THEN round({p}_hits / {p}_found, 6) ELSE 0.0::DOUBLE END AS {p}_precision, round({p}_hits / tables, 6) AS {p}_recall" for p in ("td", "row", "col"))}, tables - td_found AS no_data FROM sums""",
    "filtered_metrics": f"WITH {_OUT}, oc AS (SELECT o.* FROM outcome o JOIN truth USING (image, truth_id) WHERE type IN ('text', 'Title') AND model = 'm1') {_confusion('model', 'oc')}",
    "table_cells": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY r) - 1 AS row_index FROM s WHERE r = 1 OR s_suppkey % 5 <> 0)
SELECT s_nationkey::BIGINT AS id, row_index, 1::BIGINT AS row_span, 0::BIGINT AS column_index, CASE WHEN r = 1 THEN 2 ELSE 1 END::BIGINT AS column_span, CASE WHEN r = 1 THEN s_name ELSE upper(s_name) END AS text, false AS is_header FROM k
UNION ALL SELECT s_nationkey, row_index, 1, 1, 1, CAST(floor(s_acctbal) AS BIGINT)::VARCHAR, false FROM k WHERE r > 1""",
    "segment_columns": "WITH " + _LAY + """, s AS (SELECT *, CASE WHEN coalesce(x1 > max(x2) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS new FROM lay),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS UNBOUNDED PRECEDING) AS island FROM s),
g AS (SELECT doc_id, page, min(x1) AS cx1, max(x2) AS cx2, row_number() OVER (PARTITION BY doc_id ORDER BY page, island) AS column_seq FROM i GROUP BY doc_id, page, island)
SELECT doc_id, page, ord, coalesce(min(column_seq), -1)::BIGINT AS column_seq FROM lay LEFT JOIN g USING (doc_id, page) WHERE column_seq IS NULL OR (x1 >= cx1 AND x1 < cx2) GROUP BY ALL""",
    "report_left_join": "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "report_full_outer": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang AS file_lang, n_chars AS \"file_Quality\", toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "mean_scores": "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(*) AS n FROM labels",
    "majority_vote": """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY source)::BIGINT AS total FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) = 1)
SELECT source, lang, n, total, n > 1 AND n >= total // 2 AS accepted FROM b""",
    "metadata_schema": f"SELECT key, count(*) AS n FROM {_META} GROUP BY key",
    "unique_metadata_keys": f"WITH {_BM25}, t AS ({_top('bm', 5)}) SELECT qid, key FROM t JOIN {_META} m USING (id) GROUP BY qid, key HAVING count(*) < 2",
    "context_assembly": "SELECT conv_id AS qid, string_agg('[' || turn || '] ' || text || chr(10), '' ORDER BY turn) AS context, string_agg(turn, ',' ORDER BY turn) AS chunk_ids FROM conversations WHERE turn < 3 GROUP BY conv_id",
    "context_lists": "SELECT doc_id, array_to_string(list_concat([array_to_string(l[1:2], '.')], l[3:]), '~') AS joined, array_to_string(l[1:3], '~') AS \"first\" FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS l FROM documents)",
    "prompt_fill": "SELECT item_id AS qid, 'Context: ' || lower(text) || chr(10) || 'Question: ' || text || ' (' || length(text) || ')' AS prompt FROM benchmark",
    "llm_scores": """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN least(3.0, turn)::DOUBLE WHEN 1 THEN least(3.0, turn + 0.5)::DOUBLE ELSE -1.0::DOUBLE END AS json_score,
 CASE WHEN conv_id % 4 = 1 THEN (turn + 0.5)::DOUBLE ELSE turn::DOUBLE END AS free_score FROM conversations""",
    "qna_blocks": "SELECT conv_id, i AS pos, 't' || (i % 2) AS type, 'q' || i AS question, 'a' || i AS answer, CASE WHEN i % 3 = 0 THEN 's' END AS source FROM (SELECT conv_id, unnest(range(max(turn) + 1)) AS i FROM conversations GROUP BY conv_id)",
    "qna_numbering": "SELECT conv_id, turn, 'Q-' || lpad((10 + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 3, '0') AS q_no FROM conversations WHERE role = 'user'",
    "batch_report": "SELECT o_orderkey, o_orderstatus AS status, o_custkey::VARCHAR AS customer, CAST(NULL AS VARCHAR) AS missing FROM orders",
    "graph_nodes_edges": """SELECT 'MERGE (n:Nation {name: ''' || n_name || '''}) SET n += {key: ''' || n_nationkey || '''}' AS statement FROM nation
UNION ALL SELECT 'MERGE (n:Region {name: ''' || r_name || '''}) SET n += {key: ''' || r_regionkey || '''}' FROM region
UNION ALL SELECT 'MATCH (a:Nation {name: ''' || n_name || '''}), (b:Region {name: ''' || r_name || '''}) MERGE (a)-[:IN]->(b)' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "request_filter": "SELECT page_id, url, md5(url) AS claim FROM pages WHERE NOT ends_with(url, '.zip') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1",
    "ocr_azure_read": f"WITH {_LAY}, " + _words("50.0"),
    "ocr_azure_regions": f"WITH {_LAY}, " + _words("-1.0"),
    "ocr_aws_blocks": f"""WITH {_LAY} SELECT doc_id, page, kind, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY ord) - 1 AS ord, {_ONE} AS text, x1::DOUBLE AS x, y1::DOUBLE AS y,
 (x2 - x1)::DOUBLE AS w, 31.0::DOUBLE AS h, 90.0::DOUBLE AS conf FROM lay, (VALUES ('line'), ('word')) v(kind)""",
    "ocr_pdf_tokens": f"""WITH {_LAY}, s AS (SELECT doc_id, page, {_ONE} AS content, x1::DOUBLE AS x1, y2::DOUBLE AS y2, -1.0::DOUBLE AS conf FROM lay WHERE ord % 5 <> 0 AND page <> 3)
SELECT * FROM s UNION ALL SELECT doc_id, page, '[NO DATA FOUND]', NULL, NULL, -1.0 FROM (SELECT DISTINCT doc_id, page FROM lay) ANTI JOIN s USING (doc_id, page)""",
    "ocr_hocr": f"WITH {_LAY}, t AS (WITH " + _words("(ord % 100)::DOUBLE") + ") SELECT * FROM t UNION ALL SELECT DISTINCT doc_id, page, 'page', 0::BIGINT, '', 0.0::DOUBLE, 0.0::DOUBLE, 2000.0::DOUBLE, 1000.0::DOUBLE, -1.0::DOUBLE FROM lay",
    "word_links": f"""WITH {_LAY}, k AS (SELECT doc_id, page, ord AS link_id, 'u' || ord AS uri, x1 - 10 AS a, y1 - 20 AS b, x1 + 150 AS c, y2 + 60 AS d FROM lay WHERE ord % 4 = 1)
SELECT l.doc_id, l.page, ord, arg_min(uri, link_id) AS uri FROM lay l LEFT JOIN k ON l.doc_id = k.doc_id AND l.page = k.page AND least(x2, c) > greatest(x1, a) AND least(y2, d) > greatest(y1, b)
 AND (least(x2, c) - greatest(x1, a)) * (least(y2, d) - greatest(y1, b)) >= (x2 - x1) * (y2 - y1) * 0.6::DOUBLE GROUP BY ALL""",
    "word_cells": f"WITH {_CELLS} SELECT *, row_index = 0 AS is_header FROM cells",
    "picked_cells": f"""WITH {_CELLS} SELECT doc_id, page, table_no, row_index, column_index, text FROM cells WHERE (row_index <= 1 OR row_index BETWEEN 3 AND 9) AND column_index <= 3
 QUALIFY max(length(trim(text))) OVER (PARTITION BY doc_id, page, table_no, row_index) > 0 AND max(length(trim(text))) OVER (PARTITION BY doc_id, page, table_no, column_index) > 0""",
    "table_header_names": f"WITH {_CELLS} SELECT doc_id, page, table_no, column_index, CASE column_index WHEN 0 THEN 'col_0' WHEN 1 THEN 'same' ELSE 'same' || (column_index - 1) END AS name FROM cells WHERE row_index = 0",
    "y_clusters": """WITH j AS (SELECT *, CASE WHEN o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) > 20000 THEN 1 ELSE 0 END AS j FROM orders)
SELECT o_orderkey, sum(j) OVER (PARTITION BY o_custkey ORDER BY o_totalprice)::BIGINT AS cluster FROM j""",
    "word_lines": f"""WITH {_LAY}, s AS (SELECT *, CASE WHEN coalesce(y1 - lag(y1) OVER p > (lag(y2) OVER p - lag(y1) OVER p) * 0.5::DOUBLE, true) THEN 1 ELSE 0 END AS s FROM lay WINDOW p AS (PARTITION BY doc_id, page ORDER BY y1, x1, ord)),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y1, x1, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM s)
SELECT doc_id, page, line, string_agg(content, ' ' ORDER BY x1, ord) AS content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM g GROUP BY doc_id, page, line""",
    "distinct_segments": rf"WITH {_LAY}, k AS (SELECT *, lag(content) OVER (PARTITION BY doc_id, page ORDER BY ord) AS b FROM lay WHERE regexp_matches(content, '[\p{{L}}\p{{N}}]')) SELECT doc_id, page, ord FROM k WHERE b IS NULL OR b <> content",
    "sized_boxes": f"WITH {_LAY} SELECT doc_id, page, ord FROM lay WHERE x2 - x1 BETWEEN 40 AND 450 AND y2 - y1 = 30 AND x2 - x1 BETWEEN 60 AND 360",
    "anchor_similarity": f"""WITH {_LAY}, w AS (SELECT doc_id, page, ord, string_split(lower(trim(content)), ' ') AS w FROM lay),
r AS (SELECT doc_id, page, ord, w[i] || ' ' || w[i + 1] AS r FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
c AS (SELECT doc_id, page, ord, r, list_distinct(string_split(r, '')) AS ch, string_split('the license', '') AS a FROM (SELECT DISTINCT * FROM r)),
m AS (SELECT doc_id, page, ord, round(list_sum(list_transform(a, lambda x: length(r) - length(replace(r, x, '')))) / sqrt(list_sum(list_transform(ch, lambda x: (length(r) - length(replace(r, x, ''))) ** 2)))
 / sqrt(list_sum(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) ** 2))), 3) AS s FROM c)
SELECT DISTINCT doc_id, page, ord FROM m WHERE s >= 0.9""",
    "anchor_pattern": f"""WITH {_LAY}, t AS (SELECT *, lower(trim(content)) AS l FROM lay), {_BELOW}
SELECT DISTINCT doc_id, page, ord, x1, y1, x2, y2 FROM t WHERE regexp_matches(l, '^the .*[.]$')
UNION SELECT a.doc_id, a.page, a.ord, least(a.x1, b.x1), least(a.y1, b.y1), greatest(a.x2, b.x2), greatest(a.y2, b.y2) FROM t a JOIN below n USING (doc_id, page, ord) JOIN t b ON b.doc_id = a.doc_id AND b.page = a.page AND b.ord = n.near_ord
 WHERE regexp_matches(a.l, '^[a-m]') AND regexp_matches(b.l, '[aeiou][.]?$')""",
    "one_anchor_boxes": f"""WITH {_LAY}, p AS (SELECT doc_id, page, ord, x1 - 10.0::DOUBLE AS x, greatest(0, least(820, y2 + (y2 - y1))) AS y, x2 + (1200 - x2) * 0.5::DOUBLE AS u, 205.0::DOUBLE AS v FROM lay WHERE type = 'Title')
SELECT doc_id, page, ord, least(x, u)::DOUBLE AS x1, least(y, v)::DOUBLE AS y1, greatest(x, u)::DOUBLE AS x2, greatest(y, v)::DOUBLE AS y2 FROM p""",
    "nearest_hops": f"""WITH {_LAY}, {_BELOW}, h1 AS (SELECT doc_id, page, ord, 1 AS hop, near_ord FROM below), h2 AS (SELECT h1.doc_id, h1.page, h1.ord, 2 AS hop, b.near_ord FROM h1 JOIN below b ON b.doc_id = h1.doc_id AND b.page = h1.page AND b.ord = h1.near_ord),
h3 AS (SELECT h2.doc_id, h2.page, h2.ord, 3 AS hop, b.near_ord FROM h2 JOIN below b ON b.doc_id = h2.doc_id AND b.page = h2.page AND b.ord = h2.near_ord) SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""",
    "nearest_fields": f"""WITH {_LAY}, j AS (SELECT a.doc_id, a.page, a.ord, b.ord AS field_id, a.x1, a.y1, a.x2, a.y2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page = b.page AND a.type <> 'table' AND b.type = 'table')
SELECT doc_id, page, ord, arg_min(field_id, (abs(x1 - bx1), abs(y1 - by1), field_id)) AS field_id, 'any' AS side FROM j GROUP BY ALL
UNION ALL SELECT doc_id, page, ord, arg_min(field_id, (bx1 - x2, field_id)), 'right' FROM j WHERE bx1 >= x2 AND least(y2, by2) > greatest(y1, by1) GROUP BY ALL
UNION ALL SELECT doc_id, page, ord, arg_min(field_id, (by1 - y2, field_id)), 'bottom' FROM j WHERE by1 >= y2 AND least(x2, bx2) > greatest(x1, bx1) GROUP BY ALL""",
    "attribute_values": f"""WITH {_LAY}, t AS (SELECT *, trim(content) AS text, lower(trim(content)) AS l FROM lay),
a AS (SELECT 'license' AS name, doc_id, page, ord, x1 AS x, y1 - 60 AS y, 1200 AS u, y2 + 60 AS v FROM t WHERE regexp_matches(l, 'license')
 UNION ALL SELECT 'second the', doc_id, page, ord, x1, y1, x2, greatest(0, least(820, y2 + 2 * (y2 - y1))) FROM (SELECT * FROM t WHERE regexp_matches(l, '^the ') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, x1, ord) = 2))
SELECT a.doc_id, name, a.page, coalesce(string_agg(text, ' ' ORDER BY y1, x1, t.ord), '') AS value FROM a LEFT JOIN t ON a.doc_id = t.doc_id AND a.page = t.page AND x1 >= least(x, u) AND y1 >= least(y, v) AND x2 <= greatest(x, u) AND y2 <= greatest(y, v) GROUP BY a.doc_id, name, a.page, a.ord""",
    "two_anchor_boxes": f"""WITH RECURSIVE {_LAY}, {_two_anchors("f", "type = 'Title'", "type = 'image_text' AND ord % 20 = 19")}, {_two_anchors("b", "type = 'image_text' AND ord % 20 = 19", "type = 'Title'")}
SELECT DISTINCT * FROM (SELECT * FROM f_out UNION ALL SELECT * FROM b_out)""",
    "reader_answers": """WITH p AS (SELECT conv_id AS qid, string_agg('[' || turn || '] ' || coalesce(text, '') || chr(10), '' ORDER BY turn) AS context, min(turn) AS s FROM conversations WHERE turn < 2 GROUP BY conv_id),
q AS (SELECT qid, s, coalesce(context, '') || 'Q: what of ' || qid AS prompt FROM (SELECT DISTINCT conv_id AS qid FROM conversations) LEFT JOIN p USING (qid))
SELECT qid, 'k' || qid AS attribute_key, length(prompt)::VARCHAR AS answer, 'ok' AS status, coalesce(s::VARCHAR, '') AS source_id, s + 1 AS source_rank, CASE WHEN s > 0 THEN 1 - s / 10 ELSE -1.0 END::DOUBLE AS confidence FROM q""",
    "picked_lists": """SELECT conv_id AS qid, CASE WHEN conv_id % 3 = 0 THEN 'rrf' WHEN conv_id % 2 = 0 THEN 'vectordb' ELSE 'sparseindex' END AS source, turn AS id, turn + 1 AS rank FROM conversations
WHERE CASE WHEN conv_id % 3 = 0 THEN turn = 0 WHEN conv_id % 2 = 0 THEN turn < 3 ELSE true END""",
    "moderated_answers": r"""WITH a AS (SELECT doc_id AS qid, text, list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), ['license', 'reserved']) AS b, length(text) AS n,
 CASE WHEN contains(text, '[') THEN split_part(substr(text, strpos(text, '[') + 1), ']', 1) ELSE '' END AS s FROM documents), t AS (SELECT *, '{"answer": "' || n || '", "sources": [{"chunk_id": "' || s || '"}]}' AS j FROM a)
SELECT qid, CASE WHEN NOT b THEN CASE WHEN n % 2 = 1 THEN 'see' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' ELSE j END END AS answer, CASE WHEN b THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN b THEN 0 ELSE 1 END::BIGINT AS tries FROM t""",
    "hashed_embeddings": r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), lambda x: CAST('0x' || substr(md5(x), 1, 6) AS INTEGER) % 8) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(range(8), lambda i: len(list_filter(l, lambda x: x = i))), ',') AS slots FROM t""",
    "rewritten_queries": """WITH r AS (SELECT conv_id, arg_min('again ' || turn, turn) AS q FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 GROUP BY conv_id)
SELECT c.conv_id AS attribute_key, coalesce(q, 'turn ' || turn) AS question FROM conversations c LEFT JOIN r USING (conv_id) WHERE role = 'user'""",
    "reader_inputs": "SELECT lang AS attribute_key, doc_id, question FROM documents JOIN (VALUES ('en', 'what'), ('de', 'was')) v(lang, question) USING (lang)",
    "zipped_answers": "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "page_margins": f"""WITH {_LAY}, {_DIMS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page ORDER BY y1 RANGE BETWEEN 1 FOLLOWING AND 75 FOLLOWING) AS below, count(*) OVER (PARTITION BY doc_id, page ORDER BY y1 RANGE BETWEEN 75 PRECEDING AND 1 PRECEDING) AS above FROM lay),
r AS (SELECT *, CASE WHEN NOT ((below <= 2 AND above = 0) OR (above <= 2 AND below = 0)) THEN 'body' WHEN y1 <= height * 0.1::DOUBLE THEN 'header' WHEN y2 >= height * 0.9::DOUBLE THEN 'footer' ELSE 'body' END AS role FROM n JOIN dims USING (doc_id, page))
SELECT doc_id, page, coalesce(string_agg(content, chr(10) ORDER BY ord) FILTER (role = 'header'), '') AS header, coalesce(string_agg(content, chr(10) ORDER BY ord) FILTER (role = 'footer'), '') AS footer FROM r GROUP BY doc_id, page""",
    "first_majorities": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::BIGINT AS total FROM c)
SELECT o_custkey, arg_min(o_orderpriority, seen) FILTER (2 * n >= total) AS o_orderpriority, any_value(total) AS total FROM t GROUP BY o_custkey""",
    "document_metadata": f"""WITH {_LAY}, pg AS (SELECT doc_id, page, {_JOIN} AS content FROM lay GROUP BY doc_id, page), q(name, question) AS (VALUES ('size', 'size?'), ('kind', 'kind of text?')),
a AS (SELECT doc_id, page, name, length(question) + 1 + length(content) AS n FROM pg, q), v AS (SELECT doc_id, page, name, CASE WHEN n % 2 = 1 THEN 'odd' ELSE 'even' END || CASE WHEN name = 'size' THEN '' ELSE ' too' END AS v FROM a WHERE n % 7 <> 0),
c AS (SELECT doc_id, name, v, count(*) AS n, min(page) AS seen FROM v GROUP BY ALL), b AS (SELECT *, sum(n) OVER w AS total, first_value(v) OVER (w ORDER BY seen) AS first, row_number() OVER (w ORDER BY n DESC, seen) AS r FROM c WINDOW w AS (PARTITION BY doc_id, name)),
m AS (SELECT doc_id, name, CASE WHEN n > 1 AND n >= total // 2 THEN v ELSE first END AS v FROM b WHERE r = 1)
SELECT pg.doc_id, {_ID.replace('doc_id', 'pg.doc_id').format('page')} AS chunk_id, s.v AS size, k.v AS kind FROM pg LEFT JOIN m s ON s.doc_id = pg.doc_id AND s.name = 'size' LEFT JOIN m k ON k.doc_id = pg.doc_id AND k.name = 'kind'""",
    "generated_questions": """SELECT item_id AS id, 0::BIGINT AS pos, 'long' AS type, 'how long?' AS question, (length(text) + 20)::VARCHAR AS answer, 's' AS source FROM benchmark
UNION ALL SELECT item_id, 1, 'even', 'even?', (length(text) + 16)::VARCHAR, NULL FROM benchmark""",
    "generated_scores": """WITH p AS (SELECT item_id AS qid, 'relevance' AS metric, 'rel ' || text || ' yes' AS p FROM benchmark UNION ALL SELECT item_id, 'coverage', 'cov ' || text FROM benchmark)
SELECT qid, metric, CASE WHEN length(p) % 3 <> 0 THEN least(3, length(p) % 5) ELSE -1 END::DOUBLE AS score, CASE WHEN length(p) % 3 <> 0 THEN substr(p, 1, 4) ELSE '' END AS reasons FROM p""",
    "overlap_scores": f"""WITH r AS (SELECT u.conv_id || '-' || u.turn AS qid, u.turn, list_distinct({_tokens('a.text')}) AS a, list_distinct({_tokens('u.text')}) AS t, list_distinct({_tokens("coalesce(u.text || ' ', '') || 'the license'")}) AS c
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
s AS (SELECT qid, CASE WHEN turn > 0 THEN {_share('c', 't')} END AS context_recall, {_share('c', 'a')} AS answer_support, CASE WHEN turn > 0 THEN {_share('t', 'a')} END AS answer_precision, CASE WHEN turn > 0 THEN {_share('a', 't')} END AS answer_recall FROM r)
SELECT *, CASE WHEN answer_precision + answer_recall > 0 THEN round(2 * answer_precision * answer_recall / (answer_precision + answer_recall), 6) WHEN answer_precision IS NOT NULL THEN 0 END AS answer_f FROM s""",
    "score_means": "SELECT round(avg(p_size) FILTER (p_size % 5 <> 0), 6) AS size, CAST(NULL AS DOUBLE) AS none, round(avg(p_retailprice) FILTER (p_partkey % 2 = 0), 6) AS price FROM part",
    "numbered_answers": "SELECT conv_id, i AS pos, 't' || (i % 2) AS type, 'what is ' || i || '?' AS question, 'a' || i AS answer FROM (SELECT conv_id, unnest(range(max(turn) + 1)) AS i FROM conversations GROUP BY conv_id)",
    "context_answers": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos, 'c' || i AS sub_context, 't' || (i % 2) AS type, 'q' || i AS question, 'a' || i AS answer FROM (SELECT conv_id, unnest(range(max(turn) + 1)) AS i FROM conversations GROUP BY conv_id) WHERE i % 4 <> 3",
    "evaluation_dataset": """SELECT text AS question, text || '|x' AS contexts, CASE WHEN item_id % 2 = 0 THEN 't' END AS ground_truth, CAST(NULL AS VARCHAR) AS answer, '{"extra":"' || item_id || '"}' AS additional_data FROM benchmark""",
    "piece_counts": r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> ''))::BIGINT AS pieces FROM documents",
    "overlap_dedup": _fold(_TALL, "tall", "CASE type WHEN 'image_text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, x1, ord", _OVER + " AND (a.type <> 'table' OR a.content = b.content)", _NONE, _ACCEPT) + " " + _KEPT.format(c="doc_id, page, ord, type, content, x1, y1, x2, y2"),
    "overlap_dedup_in_order": _fold(_TALL, "tall", "ord", _OVER + " AND (a.type <> 'table' OR a.content = b.content)", _NONE, _ACCEPT) + " " + _KEPT.format(c="doc_id, page, ord"),
    "larger_segments": _fold(_TALL, "tall", "ord", _OVER, _NONE, _LARGER) + " " + _KEPT.format(c="doc_id, page, ord"),
    "adjacent_merge": _fold(_LAY, "lay", "y1, x1, ord", _NEXT, _NONE, _JOINS) + " SELECT doc_id, page, z.s[it.k] AS grp, arg_min(type, it.k) AS type, count(*) AS n, string_agg(content, chr(10) ORDER BY it.k) AS content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM it JOIN z USING (doc_id, page) GROUP BY ALL",
    "phrase_build": _fold(_WORDS, "wide", "x1, y1, ord", _CHAIN, f"{{'ends': {_NONE}, 'chain': {_NONE}}}", _LINK) + _PHRASES,
    "phrase_build_diagonal": _fold(_WORDS, "wide", "x1 + y1, x1, ord", _CHAIN, f"{{'ends': {_NONE}, 'chain': {_NONE}}}", _LINK) + _PHRASES,
    "generated_segments": f"WITH {_GEN} SELECT doc_id, page, ord, technique, type FROM gen",
    "consolidated_segments": _fold(_REST, "rest", "CASE type WHEN 'image_text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, x1, ord", _OVER + " AND (a.type <> 'table' OR a.content = b.content)", _NONE, _ACCEPT)
    + r" SELECT doc_id, page, type, content, x1, y1 FROM gen WHERE technique = 'text' UNION ALL SELECT doc_id, page, type, content, x1, y1 FROM it JOIN z USING (doc_id, page) WHERE list_contains(z.s, it.k) AND regexp_matches(content, '[\p{L}\p{N}]')",
    "classified_segments": f"WITH {_LAY}, {_DIMS} SELECT doc_id, page, ord, CASE WHEN y2 <= height * 0.2::DOUBLE THEN 'header' WHEN y1 >= height * 0.85::DOUBLE THEN 'footer' ELSE 'body' END AS role FROM lay JOIN dims USING (doc_id, page)",
    "sequence_zigzag_dynamic": f"""WITH {_LAY}, j AS (SELECT *, CASE WHEN x1 >= 1.05::DOUBLE * lag(x1) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord) THEN 1 ELSE 0 END AS j FROM lay),
g AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS UNBOUNDED PRECEDING) AS g FROM j) SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY g, y1, x1, ord) AS sequence FROM g""",
    "sequence_by_layout": f"""WITH {_LAY}, n AS (SELECT *, CASE WHEN coalesce(x1 > max(x2) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS new,
 CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord) > 50 THEN 1 ELSE 0 END AS jump FROM lay),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page) > 1 AS multi, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY x1, y1, ord ROWS UNBOUNDED PRECEDING) AS sub FROM n)
SELECT doc_id, page, ord, CASE WHEN multi THEN 'multi-column' ELSE 'single-column' END AS layout, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN multi THEN sub ELSE 0 END, y1, x1, ord) AS sequence FROM s""",
    "configured_chunks": rf"""WITH {_LAY}, s AS (SELECT * REPLACE (replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), 'the', 'THE') || ';' AS content) FROM lay WHERE type <> 'image_text'),
c AS (SELECT doc_id, page, 'page' AS method, page::VARCHAR AS chunk_key, {_JOIN} AS content FROM s GROUP BY doc_id, page UNION ALL SELECT doc_id, page, 'segment', page || '_segment_' || ord, content FROM s
 UNION ALL SELECT doc_id, page, 'page_and_segment_type', page || '_text', {_JOIN} FROM s WHERE type = 'text' GROUP BY doc_id, page
 UNION ALL SELECT doc_id, page, 'page_and_segment_type', page || '_' || type || '_' || row_number() OVER (PARTITION BY doc_id, page, type ORDER BY ord), content FROM s WHERE type = 'table')
SELECT *, length(content)::BIGINT AS char_count FROM c""",
    "updated_rows": f"WITH {_LAY} SELECT doc_id, page, ord AS number, 'any' AS type, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, 'layout' AS source FROM lay",
    "scaled_boxes": f"WITH {_LAY} SELECT doc_id, page, ord, {', '.join(f'round({c} * CASE WHEN page < 3 THEN {k}::DOUBLE ELSE 1 END, 6) AS {c}' for c, k in (('x1', 2), ('y1', 1.25), ('x2', 2), ('y2', 1.25)))} FROM lay",
    "planned_requests": """SELECT DISTINCT md5(url) AS claim, 'G-1' AS group_id, 'D-' || substr(sha1(url), 1, 10) AS document_id, url AS path, split_part(url, '/', -1) AS filename, 'html' AS extension,
 '/work/D-' || substr(sha1(url), 1, 10) || '/input/' || split_part(url, '/', -1) AS work_path, 'evaluation' AS mode FROM pages""",
    "request_rounds": """WITH p AS (SELECT DISTINCT md5(url) AS c FROM pages), n AS (SELECT count(*) AS a, count_if(c < '8')::BIGINT AS b FROM p)
SELECT 'G-1' AS group_id, 'closed' AS state, b AS requests, b AS saved FROM n UNION ALL SELECT 'G-2', 'pending', a - b, NULL FROM n UNION ALL SELECT 'G-4', 'pending', b, NULL FROM n""",
    "filled_metadata": r"""SELECT page_id, split_part(url, '/', -1) AS filename, lower(regexp_extract(split_part(url, '/', -1), '\.([^.]+)$', 1)) AS filetype, CASE WHEN page_id % 2 = 0 THEN 'given' ELSE regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') END AS title FROM pages""",
    "recognised_tokens": """WITH l AS (SELECT doc_id, page, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS r FROM (SELECT conv_id AS doc_id, turn AS page, string_split(text, chr(10)) AS l FROM conversations)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS ord FROM l WHERE trim(line, ' ') <> ''),
p AS (SELECT doc_id, page, r, unnest(w) AS w, generate_subscripts(w, 1) AS i, w AS ws FROM (SELECT *, string_split(line, ' ') AS w FROM k)),
x AS (SELECT *, coalesce(list_sum(list_transform(ws[1:i - 1], lambda y: length(y) + 1)), 0) AS a FROM p)
SELECT doc_id, page, 'line' AS kind, ord, trim(line, ' ') AS text, 0.0::DOUBLE AS x, (r * 16)::DOUBLE AS y, (length(line) * 8)::DOUBLE AS w, 16.0::DOUBLE AS h, -1.0::DOUBLE AS conf FROM k
UNION ALL SELECT doc_id, page, 'word', row_number() OVER (PARTITION BY doc_id, page ORDER BY r, i) - 1, w, a * 8, r * 16, length(w) * 8, 16, 100 FROM x WHERE w <> ''""",
    "converted_pages": "SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)",
    "mark_states": f"""WITH {_PIX}, b AS (SELECT image, (y // 4) * 2 + x // 4 AS box_id, round(avg(CASE WHEN v < 128 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS dark FROM px GROUP BY ALL) SELECT image, box_id::BIGINT AS box_id, dark, dark >= 0.5 AS is_set FROM b""",
    "detected_tables": f"""WITH {_PIX}, b AS (SELECT image, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n FROM px WHERE v * 4 < 128 GROUP BY image)
SELECT image, 'dark' AS model, 0::BIGINT AS det_id, round(n / ((x2 - x1) * (y2 - y1)), 6) AS confidence, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM b""",
    "key_values": f"""WITH {_LAY}, r AS (SELECT a.doc_id, a.page, a.ord, b.ord AS near FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord AND b.x1 >= a.x2 AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY b.x1 - a.x2, b.ord) = 1)
SELECT l.doc_id, l.page, l.ord, CASE l.ord % 7 WHEN 3 THEN 'three' ELSE 'five' END AS name, 'w' || (near % 7) AS value FROM lay l LEFT JOIN r USING (doc_id, page, ord) WHERE l.ord % 7 IN (3, 5)""",
    "ruled_table_cells": f"""WITH {_LAY}, ln AS (SELECT DISTINCT doc_id, page, false AS up, y1::DOUBLE AS pos FROM lay UNION SELECT DISTINCT doc_id, page, true, (x1 + ord % 3)::DOUBLE FROM lay),
j AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, page, up ORDER BY pos) > 5 THEN 1 ELSE 0 END AS j FROM ln), c AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page, up ORDER BY pos)::BIGINT AS k FROM j),
m AS (SELECT doc_id, page, up, k, avg(pos) AS pos FROM c GROUP BY ALL), b AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, page, up ORDER BY k) AS nx FROM m)
SELECT r.doc_id, r.page, r.k AS row_index, c.k AS column_index, c.pos AS x1, r.pos AS y1, c.nx AS x2, r.nx AS y2 FROM b r JOIN b c ON r.doc_id = c.doc_id AND r.page = c.page AND NOT r.up AND c.up WHERE r.nx IS NOT NULL AND c.nx IS NOT NULL""",
    "unruled_table_cells": f"""WITH {_LAY}, j AS (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y1) > 10 THEN 1 ELSE 0 END AS jy, CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id, page ORDER BY x1) > 20 THEN 1 ELSE 0 END AS jx FROM lay),
c AS (SELECT *, sum(jy) OVER (PARTITION BY doc_id, page ORDER BY y1)::BIGINT AS row_index, sum(jx) OVER (PARTITION BY doc_id, page ORDER BY x1)::BIGINT AS column_index FROM j)
SELECT doc_id, page, row_index, column_index, string_agg(content, ' ' ORDER BY x1, ord) AS text FROM c GROUP BY doc_id, page, row_index, column_index""",
    "aggregated_detections": """WITH p AS (SELECT array_to_string(string_split(p_brand || '/' || p_type || '/' || p_name, '/')[1:2], '/') AS image_subpath, p_size FROM part)
SELECT image_subpath, 'm' AS model, 0::BIGINT AS det_id, 0.5::DOUBLE AS confidence, 0.0::DOUBLE AS x1, 1.0::DOUBLE AS y1, p_size::DOUBLE AS x2, 9.0::DOUBLE AS y2 FROM p
UNION ALL SELECT image_subpath, 'm', 1, 0.25, 1, 1, 2, 2 FROM p""",
    "event_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y%m%d') AS day FROM events",
    "updated_json": "SELECT o_orderkey, 'new' AS status, o_custkey::VARCHAR AS key, o_orderkey::VARCHAR AS note, 'true' AS added FROM orders",
    "prefix_meta": f"WITH {_LAY} SELECT doc_id, ord, 'page_char_' || (r_regionkey + 1) AS seq_no, r_name FROM lay JOIN region ON starts_with('page_char_' || ord, 'page_char_' || (r_regionkey + 1))",
    "consolidated_questions": "SELECT conv_id AS doc_id, 'N' || lpad((5 + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 4, '0') AS Q_No, turn || ', ' || (turn + 1) AS pages, text AS \"Question\" FROM conversations WHERE role = 'user'",
    "compared_runs": "SELECT 'first' AS run, round(avg(quality), 6) AS a, round(avg(toxic), 6) AS b FROM labels UNION ALL SELECT 'second', round(avg(p_size), 6), round(avg(p_retailprice), 6) FROM part",
    "searched_answers": f"""WITH {_HYB}, e AS (SELECT qid, id, rank, 0 AS source FROM sp UNION ALL SELECT qid, id, rank, 1 FROM de),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(source * 1000 + rank) AS first FROM e GROUP BY qid, id), k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM f QUALIFY rank <= 2),
c AS (SELECT qid, string_agg(string_split(text, chr(10))[1], '.' ORDER BY rank) AS contexts, string_agg(coalesce(string_split(text, chr(10))[1], '') || chr(10), '' ORDER BY rank) AS context FROM k JOIN documents d ON d.doc_id = k.id GROUP BY qid),
p AS (SELECT b.item_id AS qid, coalesce(context, '') || 'Q: ' || text AS p, coalesce(contexts, '') AS contexts FROM benchmark b LEFT JOIN c ON c.qid = b.item_id)
SELECT qid, length(p)::VARCHAR AS answer, 'ok' AS status, contexts, CASE WHEN contains(p, '[') THEN split_part(substr(p, strpos(p, '[') + 1), ']', 1) ELSE '' END AS source_id FROM p""",
    "region_tokens": f"WITH {_LAY}, {_REG} SELECT region_id, t.doc_id, t.page, t.ord FROM lay t JOIN reg r ON t.doc_id = r.doc_id AND t.page = r.page AND x1 >= rx1 AND y1 >= ry1 AND x2 <= rx2 AND y2 <= ry2",
    "outside_tokens": f"WITH {_LAY}, {_REG} SELECT doc_id, page, ord FROM lay t WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE t.doc_id = r.doc_id AND t.page = r.page AND ((x1 >= rx1 AND y1 >= ry1 AND x2 <= rx2 AND y2 <= ry2) OR (rx1 >= x1 AND ry1 >= y1 AND rx2 <= x2 AND ry2 <= y2)))",
    "nearest_right": _near("b.x1 - a.x2", "least(a.y2, b.y2) - greatest(a.y1, b.y1)", "(a.y2 - a.y1) * 0.5::DOUBLE"),
    "nearest_below": _near("b.y1 - a.y2", "least(a.x2, b.x2) - greatest(a.x1, b.x1)", "0"),
    "anchor_regions": f"""WITH {_LAY}, j AS (SELECT a.doc_id, a.page, a.ord, b.ord AS s_ord, a.x1, a.y1, a.x2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2 FROM lay a JOIN lay b ON a.doc_id = b.doc_id AND a.page = b.page AND a.type = 'Title' AND b.type = 'image_text' AND b.y1 > a.y1
 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY b.y1, b.ord) = 1)
SELECT doc_id, page, ord AS from_ord, s_ord AS to_ord, least(x1, bx1) AS x1, y1, greatest(x2, bx2) AS x2, by1 AS y2 FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page, s_ord ORDER BY y1 DESC, ord) = 1""",
    "region_subtraction": f"""WITH {_LAY}, r AS (SELECT doc_id, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lay GROUP BY doc_id, page),
c AS (SELECT DISTINCT doc_id, page, y1 AS a, y2 AS b FROM lay WHERE type = 'table'),
starts AS (SELECT doc_id, page, y1 AS s FROM r UNION SELECT doc_id, page, b FROM c), ends AS (SELECT doc_id, page, y2 AS e FROM r UNION SELECT doc_id, page, a FROM c),
f AS (SELECT s.doc_id, s.page, s, min(e) AS e FROM starts s JOIN ends USING (doc_id, page) WHERE e >= s AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.page = s.page AND s >= a AND s < b) GROUP BY ALL)
SELECT page AS region_id, doc_id, page, x1, s AS y1, x2, e AS y2 FROM f JOIN r USING (doc_id, page) WHERE e > s AND e <= y2 AND s < y2""",
}
