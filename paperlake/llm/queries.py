"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.llm import bpe, decontam, hilbert, kn_quality, langid, license_scan, quality_rules, simhash, token_count, toolcalls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_counts(_table(spark, sf_dir, "documents"), copies_once=True)


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text AS given, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r),
win AS (SELECT r, i, list_slice(w, i, i + 2) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1) GROUP BY r),
norm AS (SELECT DISTINCT r, lw FROM (SELECT r, regexp_extract_all(lower(line), '{_BLANK}') AS lw FROM lines) WHERE len(lw) > 0),
cnt AS (SELECT source, lw, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS c FROM norm JOIN d USING (r) GROUP BY ALL),
hosts AS (SELECT source AS host, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS docs FROM d GROUP BY ALL),
hot AS (SELECT source AS host, lw FROM cnt JOIN hosts ON host IS NOT DISTINCT FROM source WHERE c > {quality_rules.LINE_LEAST} AND c > docs * CAST({quality_rules.LINE_SHARE} AS DOUBLE)),
lw AS (SELECT r, sum(len(lw)) AS line_words FROM norm GROUP BY r),
lost AS (SELECT r, sum(len(lw)) AS lost_words FROM (SELECT r, source, lw FROM norm JOIN d USING (r)) n JOIN hot USING (lw) WHERE hot.host IS NOT DISTINCT FROM n.source GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(line_words, 0) AS BIGINT) AS line_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
 FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lw USING (r) LEFT JOIN lost USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_words - lost_words >= line_words * CAST({quality_rules.KEEP_SHARE} AS DOUBLE) AS kept FROM o
"""


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.md5(text).alias("digest")
    )
    axes = [hilbert.category(F.col("source"), 4), hilbert.category(F.col("lang"), 4), hilbert.magnitude(F.shiftright("size", 4), 4)]
    out = hilbert.shard_rows(slim, axes, F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "digest")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


_CURVE = ", ".join(map(str, hilbert.curve(3, 4)))
#: The remainder of every byte in the reflected CRC-32, and the fold over a text's bytes.
OP9_SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT *, strlen(text) + 1 AS size, list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS l FROM d),
k AS (SELECT doc_id, source, lang, size, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, md5(text) AS digest,
 coalesce(CAST('0x' || substr(md5(source), 4, 1) AS BIGINT), 0) AS a, coalesce(CAST('0x' || substr(md5(lang), 4, 1) AS BIGINT), 0) AS b, least(length(ltrim(bin(size >> 4), '0')), 15) AS c FROM b, tab),
o AS (SELECT *, [{_CURVE}][256 * a + 16 * b + greatest(c, 1) + 1] AS curve FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY curve, md5(concat_ws(':', doc_id, digest)), doc_id, lang, source) - 1 AS n, count(*) OVER () AS total FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(8 * n // total AS INTEGER) AS shard,
 CAST(n - ((8 * n // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve FROM r
"""


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    calls, results = toolcalls.chat_calls(turns)
    return toolcalls.link_calls(calls, results, toolcalls.CHAT_SCHEMAS).unionByName(toolcalls.other_messages(turns)).withColumnRenamed("conv", "conv_id")


OP10_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS k, turn, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS k, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
asked AS (SELECT k, turn, count(*) AS asked FROM c WHERE turn IS NOT NULL GROUP BY ALL),
got AS (SELECT k, turn, count(*) AS got FROM r WHERE turn IS NOT NULL GROUP BY ALL),
dep AS (SELECT k, turn, 0 AS depth FROM asked a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.k = a.k AND b.turn = a.turn - 2)
 UNION ALL SELECT a.k, a.turn, dep.depth + 1 FROM dep JOIN asked a ON a.k = dep.k AND a.turn = dep.turn + 2),
e AS (SELECT *, array_to_string(list_filter([CASE WHEN text IS NULL THEN 'missing:prompt' END, CASE WHEN turn IS NULL THEN 'missing:turn' WHEN turn < 0 THEN 'range:turn' END], lambda x: x IS NOT NULL), ',') AS errors FROM c)
SELECT conv_id, 'c' || turn AS call_id, 'call' AS kind, CAST(CASE WHEN turn IS NULL THEN 0 ELSE 2 * depth END AS BIGINT) AS position,
 CASE WHEN errors <> '' THEN 'invalid' WHEN asked > 1 THEN 'duplicate' WHEN got IS NULL THEN 'unanswered' ELSE 'ok' END AS status, errors,
 '{"arguments":{' || concat_ws(',', CASE WHEN text IS NOT NULL THEN '"prompt":' || CAST(to_json(text) AS VARCHAR) END, '"turn":' || turn) || '},' || CASE WHEN turn IS NULL THEN '' ELSE '"id":"c' || turn || '",' END || '"name":"ask","type":"call"}' AS message
FROM e LEFT JOIN asked USING (k, turn) LEFT JOIN dep USING (k, turn) LEFT JOIN got USING (k, turn)
UNION ALL
SELECT conv_id, 'c' || turn, 'result', CAST(2 * depth + 1 AS BIGINT), CASE WHEN asked IS NULL THEN 'orphan' WHEN got > 1 THEN 'duplicate' ELSE 'ok' END, '',
 '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || CASE WHEN turn IS NULL THEN '' ELSE '"id":"c' || turn || '",' END || '"type":"result"}'
FROM r LEFT JOIN asked USING (k, turn) LEFT JOIN dep USING (k, turn) LEFT JOIN got USING (k, turn)
UNION ALL
SELECT conv_id, CAST(NULL AS VARCHAR), 'message', CAST(NULL AS BIGINT), 'ok', '',
 '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) || ',' END
 || CASE WHEN turn IS NULL THEN '' ELSE '"turn":' || turn || ',' END || '"type":"message"}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_count.count_tokens(_table(spark, sf_dir, "documents"), path, token_count.new_cache(spark))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_simhash": op2_simhash,
        "op6_token_counts": op6_token_counts,
        "op8_bpe": op8_bpe,
        "op3_license_scan": op3_license_scan,
        "op4_language_id": op4_language_id,
        "op7_quality_classifier": op7_quality_classifier,
        "op5_quality_rules": op5_quality_rules,
        "op9_hilbert_sharding": op9_hilbert_sharding,
        "op10_tool_calls": op10_tool_calls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_quality_rules": OP5_SQL, "op9_hilbert_sharding": OP9_SQL, "op10_tool_calls": OP10_SQL}
