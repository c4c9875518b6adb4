"""Rules on single documents, and lines that many documents of a host share; DataFrame operations only.

A line counts for a host as often as distinct documents (ids) of that host hold it, or,
with copies_once, as often as distinct texts do, whatever its case and spacing. Lines
above the limit are boilerplate; a document of which too few words remain without them is
depleted. The limit is a share of the host's documents, or of its distinct texts. With
copies_once, exact copies are one text however many they are, and are left to
deduplication. Near copies are texts of their own: the lines that a group of them shares
count once for each different text, and are boilerplate beyond the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlake.llm.common import checkpoint

MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_SHARE = 0.01
LINE_LEAST = 20
KEEP_SHARE = 0.3
#: Lines above the limit up to this many, of all hosts, are broadcast.
BROADCAST_LINES = 1_000_000
#: Into so many keys a host's documents are dealt beyond that.
HOST_PARTS = 64
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_HAS_WORD = r"[^\\x20\\x09-\\x0D]"
_GAP = r"[\\x20\\x09-\\x0D]+"


def _repeat_words() -> str:
    """Words in three-word windows that come twice or more, of the array w. Windows of equal hashes are told apart by their words, which hold no blank."""
    hashes = "if(size(w) < 3, CAST(array() AS array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    again = "transform(filter(s, (e, k) -> coalesce(e.x = get(s, k - 1).x AND e.t = get(s, k - 1).t, false) OR coalesce(e.x = get(s, k + 1).x AND e.t = get(s, k + 1).t, false)), e -> e.i)"
    cover = (
        f"aggregate(sort_array({again}), named_struct('upto', 0, 'n', 0), (a, i) -> named_struct("
        "'upto', greatest(a.upto, i + 3), 'n', a.n + i + 3 - greatest(a.upto, i)), a -> a.n)"
    )
    among = f"transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 't', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))), s -> {cover})[0]"
    return f"transform(array({hashes}), h -> if(size(array_distinct(h)) = size(h), 0, {among}))[0]"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added; null texts count as empty,
    and columns of these names are replaced. Equal rows stay; an empty table gives none.

    Words are bound once, by a lambda: a filter on these counts may be pushed below, and must not split the text anew for each word.
    """
    text = f"coalesce({text_col}, '')"
    lines = f"filter(split({text}, '\\n'), x -> x RLIKE '{_HAS_WORD}')"
    fields = (
        "named_struct('n_words', CAST(size(w) AS bigint), 'word_chars', CAST(char_length(array_join(w, '')) AS bigint), "
        f"'n_symbols', CAST(size(split({text}, '[#*$%&|<>]', -1)) - 1 AS bigint), "
        f"'n_dup_lines', CAST(transform(array({lines}), l -> size(l) - size(array_distinct(l)))[0] AS bigint), "
        f"'n_repeat_words', CAST({_repeat_words()} AS bigint))"
    )
    whole = f"named_struct('c', c, 'failed', c.n_words < {MIN_WORDS} OR 100 * c.n_repeat_words > {REPEAT_PERCENT} * c.n_words)"
    words = f"array_remove(split({text}, '{_GAP}'), '')"
    counted = docs.withColumn("__b", F.expr(f"transform(transform(array({words}), w -> {fields}), c -> {whole})[0]"))
    rest = [c for c in docs.columns if c not in _COUNTS]
    return counted.select(*rest, "__b.c.n_words", "__b.c.word_chars", "__b.c.n_symbols", "__b.c.n_dup_lines", "__b.c.n_repeat_words", F.col("__b.failed").alias("base_failed"))


def _lines(text_col: str) -> str:
    """Distinct normalised lines of a text by hash, each with its words, as an array."""
    parts = f"array_remove(split(x, '{_GAP}'), '')"
    return f"array_distinct(filter(transform(split(lower({text_col}), '\\n'), x -> transform(array({parts}), p -> named_struct('line', xxhash64(p), 'n', size(p)))[0]), l -> l.n > 0))"


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, share: float, least: int, copies_once: bool = False) -> DataFrame:
    """Rows (host, line): lines in more than `least` documents and more than `share` of the documents of their host; with copies_once, texts stand for documents.

    One pass: a document's row without a line (null) counts it for its host. Counts are added up before and after the shuffle by
    (host, line, document), so no line's documents meet in one task.
    """
    own = F.unhex(F.md5(F.col(text_col))) if copies_once else F.col(id_col).cast("string").cast("binary")
    keyed = docs.select(F.col(host_col).alias("host"), F.coalesce(own, F.lit(b"")).alias("key"), F.expr(f"transform({_lines(text_col)}, l -> l.line)").alias("lines"))
    each = keyed.select("host", "key", F.explode(F.expr("concat(array(CAST(NULL AS bigint)), coalesce(lines, CAST(array() AS array<bigint>)))")).alias("line"))
    counts = checkpoint(each.groupBy("host", "line").agg(F.countDistinct("key").alias("c")).where((F.col("c") > least) | F.col("line").isNull()))
    per_host = counts.where("line IS NULL").select(F.col("host").alias("__host"), F.col("c").alias("docs"))
    return counts.where("line IS NOT NULL").join(per_host, F.col("host").eqNullSafe(F.col("__host"))).where(F.col("c") > F.col("docs") * share).select("host", "line")


def _with_hot(docs: DataFrame, host_col: str, hot: DataFrame, broadcast_lines: int) -> DataFrame:
    """The documents with __hot, the lines above the limit of their host (null: none).

    A host's lines are an array: each is in over a `share` of its documents, so there are at most 1 / share times as many as
    lines in a document. They are broadcast up to `broadcast_lines`; beyond, documents of a host are dealt out over
    HOST_PARTS keys and its lines go to each.
    """
    hot = checkpoint(hot)
    arrays = hot.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__hot"))
    same = F.col(host_col).eqNullSafe(F.col("__host"))
    if hot.count() <= broadcast_lines:
        return docs.join(F.broadcast(arrays), same, "left").drop("__host")
    salted = docs.withColumn("__part", F.pmod(F.xxhash64("text"), F.lit(HOST_PARTS)).cast("int"))
    arrays = arrays.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    return salted.join(arrays, same & (F.col("__part") == F.col("__p")), "left").drop("__host", "__part", "__p")


_LOST = "coalesce(aggregate(filter(__lines, l -> array_contains(__hot, l.line)), 0L, (a, l) -> a + l.n), 0L)"
_ALL = "coalesce(aggregate(__lines, 0L, (a, l) -> a + l.n), 0L)"


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = LINE_SHARE,
                least: int = LINE_LEAST, keep_share: float = KEEP_SHARE, copies_once: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per document row: id, the base counts, base_failed, line_words, lost_words, kept.

    line_words are the words of a document's distinct lines and lost_words those of its lines above
    the limit; it is depleted if less than keep_share remains. Null texts have no words and fail; null
    hosts are one host; null ids are one document; with copies_once, documents of one text are one, null texts too;
    equal rows get equal results each and count once; other columns are not read; an empty table gives none; a very
    long text is worked on in its own row.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    hot = frequent_lines(slim, "id", "text", "source", share, least, copies_once)
    base = _with_hot(base_counts(slim.withColumn("__lines", F.expr(_lines("text")))), "source", hot, broadcast_lines)
    out = base.withColumn("line_words", F.expr(_ALL)).withColumn("lost_words", F.expr(_LOST))
    kept = ~F.col("base_failed") & (F.col("line_words") - F.col("lost_words") >= F.col("line_words") * keep_share)
    return out.select(F.col("id").alias(id_col), *_COUNTS, "line_words", "lost_words", kept.alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = LINE_SHARE,
          least: int = LINE_LEAST, keep_share: float = KEEP_SHARE, copies_once: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The kept documents with their columns, their texts without the lines above the limit.

    A text without such lines stays as it is. The verdicts are those of rule_counts on the texts as they come, and so is
    what holds for nulls, equal rows, long texts and empty tables. Texts are not shuffled.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    hot = frequent_lines(slim, "id", "text", "source", share, least, copies_once)
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    good = _with_hot(base_counts(packed).where("NOT base_failed").select("__doc", "text", "source"), "source", hot, broadcast_lines)
    good = good.withColumn("__lines", F.when(F.col("__hot").isNotNull(), F.expr(_lines("text"))))
    good = good.where(F.col("__hot").isNull() | (F.expr(_ALL) - F.expr(_LOST) >= F.expr(_ALL) * keep_share))
    rest = f"filter(split(text, '\\n'), x -> NOT array_contains(__hot, xxhash64(array_remove(split(lower(x), '{_GAP}'), ''))))"
    text = F.when(F.expr(f"coalesce({_LOST} > 0, false)"), F.expr(f"array_join({rest}, '\\n')")).otherwise(F.col("text"))
    return good.select(*[text.alias(c) if c == text_col else F.col("__doc").getField(c).alias(c) for c in docs.columns])
