"""From matches to answers: embeddings, prompts, providers with retries and moderation, votes, generated questions and their scores.

A model is a function from a list of prompts to a list of answers (and an embedder one to a list of vectors); it runs on
batches in the executors. All around it is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paperlake.functions import text as T
from paperlake.operators import qna, search
from paperlake.sources.shared import checkpoint

Provider = Callable[[list[str]], list[str]]


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic embedding without a model: how many tokens have each remainder of a hash, as doubles. Null has none of any."""
    slots = F.transform(T.tokens(text, ()), lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % size)
    # as an array's element the slots are computed once, and not for every number
    return F.get(F.transform(F.array(slots), lambda have: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(have, lambda s: s == i)).cast("double"))), F.lit(0))


def embed(rows: DataFrame, text_col: str, provider: Callable[[list[str]], list[list[float]]], name: str = "vector", batch: int = 64) -> DataFrame:
    """Rows with the provider's vector of their text; equal texts are asked once, null ones not."""
    asked = rows.select(F.col(text_col).alias("__t")).where("__t IS NOT NULL").distinct()

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf["__t"].iloc[a : a + batch]
                yield pd.DataFrame({"__t": part, name: provider(part.tolist())})

    got = asked.mapInPandas(run, f"__t string, {name} array<double>")
    return rows.join(got, F.col(text_col) == F.col("__t"), "left").drop("__t")


def blocked(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, whole and in any case: a moderation without a service."""
    return F.coalesce(F.arrays_overlap(T.tokens(text, ()), F.array(*map(F.lit, [w.lower() for w in words]))), F.lit(False)) if words else F.lit(False)


def _valid(answer: str | None) -> bool:
    """JSON, or text with JSON in a fence."""
    for part in [answer or "", *((answer or "").split("```")[1:2])]:
        try:
            json.loads(part.removeprefix("json"))
            return True
        except ValueError:
            continue
    return False


def answer(prompts: DataFrame, provider: Provider, attempts: int = 1, as_json: bool = False, banned: list[str] = (), cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """prompts (qid, prompt) with answer, status and tries: ok, invalid (no JSON after all attempts) or blocked (by a word in the prompt or the answer; the answer is null then).

    Answers of cache (key: SHA-1 of the prompt, answer) are not asked for, equal prompts are asked once, and of a batch only those
    whose answer is no JSON are asked again.
    """
    keyed = prompts.withColumn("key", F.sha1("prompt")).withColumn("__no", blocked(F.col("prompt"), list(banned)))
    asked = keyed.where("NOT __no AND prompt IS NOT NULL").select("key", "prompt").dropDuplicates(["key"])
    if cache is not None:
        asked = asked.join(cache.select("key"), "key", "left_anti")

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                texts, got, tries = part["prompt"].tolist(), [None] * len(part), [0] * len(part)
                left = list(range(len(part)))
                for _ in range(attempts):
                    for i, x in zip(left, provider([texts[i] for i in left])):
                        got[i], tries[i] = x, tries[i] + 1
                    left = [i for i in left if as_json and not _valid(got[i])]
                    if not left:
                        break
                yield pd.DataFrame({"key": part["key"], "answer": got, "tries": tries})

    answers = asked.mapInPandas(run, "key string, answer string, tries long")
    if cache is not None:
        answers = answers.unionByName(cache.select("key", "answer", F.lit(0).cast("long").alias("tries")))
    j = keyed.join(answers, "key", "left")
    stop = F.col("__no") | blocked(F.col("answer"), list(banned))
    good = T.fenced_json(F.col("answer")).isNotNull() if as_json else F.col("answer").isNotNull()
    return j.select(*prompts.columns, F.when(~stop, F.col("answer")).alias("answer"), F.when(stop, "blocked").when(good, "ok").otherwise("invalid").alias("status"), F.coalesce("tries", F.lit(0)).cast("long").alias("tries"))


def pick_lists(lists: dict[str, DataFrame], order: tuple[str, ...] = ("rrf", "vectordb", "sparseindex")) -> DataFrame:
    """(qid, source, id, rank, score, content): of every question the matches of the first list in `order` that has any."""
    every = reduce(DataFrame.unionByName, [lists[n].select("qid", "id", "rank", "score", "content", F.lit(n).alias("source"), F.lit(i).alias("__i")) for i, n in enumerate(order) if n in lists])
    best = every.groupBy("qid").agg(F.min("__i").alias("__b"))
    return every.join(best, "qid").where("__i = __b").drop("__i", "__b")


def read(questions: DataFrame, matches: DataFrame, provider: Provider, template: str, part: str = "{content}\n", k: int = 3, **how) -> DataFrame:
    """(qid, attribute_key, prompt, answer, status, source_id, source_rank, confidence): the k first matches of each question in a prompt, its answer, and the match that the answer names as its first source.

    questions (qid, attribute_key, question), matches (qid, id, rank, score, content); the template has {context} and {question}. An
    answer is JSON with `answer` and `sources[0].chunk_id`; other text is the answer itself. A question without matches is asked with none.
    """
    context = qna.contexts(matches, part, k)
    filled = questions.join(context, "qid", "left").withColumn("prompt", T.fill(template, {"context": F.col("context"), "question": F.col("question")}))
    got = answer(filled.select("qid", "attribute_key", "prompt"), provider, **how)
    body = T.fenced_json(F.col("answer"))
    named = got.withColumn("source_id", F.get_json_object(body, "$.sources[0].chunk_id")).withColumn("answer", F.coalesce(F.get_json_object(body, "$.answer"), F.col("answer")))
    first = matches.groupBy(F.col("qid").alias("m_qid"), F.col("id").cast("string").alias("m_id")).agg(F.min(F.struct("rank", "score")).alias("m"))
    return named.join(first, (F.col("qid") == F.col("m_qid")) & (F.col("source_id") == F.col("m_id")), "left").select(
        "qid", "attribute_key", "prompt", "answer", "status", "source_id", F.col("m.rank").alias("source_rank"), T.confidence_pct(F.col("m.score")).alias("confidence"))


def with_inputs(inputs: DataFrame, queries: DataFrame) -> DataFrame:
    """Reader inputs joined with the queries of their attribute_key."""
    return inputs.join(queries, "attribute_key")


def with_rewritten(queries: DataFrame, rewritten: DataFrame) -> DataFrame:
    """queries (attribute_key, question) with the first (by ord) rewritten question of their key that is not blank."""
    r = rewritten.where("trim(question) <> ''").groupBy("attribute_key").agg(F.min_by("question", "ord").alias("__q"))
    return queries.join(r, "attribute_key", "left").withColumn("question", F.coalesce("__q", "question")).drop("__q")


def zip_rows(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows side by side by their ordinal; what the right lacks is null."""
    return left.join(right.withColumnRenamed(ordinal, "__o"), F.col(ordinal) == F.col("__o"), "left").drop("__o")


def with_margins(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Page chunks (doc_id, page, …) with header and footer: the texts of these roles on the page, in order, joined by line breaks; empty for none."""
    def texts(role: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("ord", "content")))), lambda e: e["content"]), "\n")  # a page's margin

    m = segments.where("role IN ('header', 'footer')").groupBy("doc_id", "page").agg(texts("header").alias("header"), texts("footer").alias("footer"))
    return chunks.join(m, ["doc_id", "page"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("header", "footer")})


def first_majority(votes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the first seen value that half of the votes have, if any; null votes count in the total only."""
    c = votes.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("seen", F.col(value).alias("v"), "n"))).alias("l"))  # a key's values
    hit = F.filter("l", lambda e: e["v"].isNotNull() & (e["n"] * 2 >= F.col("total")))
    return total.select(*keys, F.get(hit, F.lit(0))["v"].alias(value), "total")


def document_metadata(pages: DataFrame, questions: dict[str, str], provider: Provider, chunks: DataFrame, **how) -> DataFrame:
    """Chunks (doc_id, …) with custom_metadata: for each named question the value that most pages (doc_id, page, content) of the document answer; a document without a majority has the first page's."""
    asked = pages.select("doc_id", "page", F.explode(F.create_map(*[F.lit(x) for kv in questions.items() for x in kv])).alias("name", "question"), "content")
    prompts = asked.select(F.col("doc_id"), F.col("page"), "name", F.struct("doc_id", "page", "name").alias("qid"), F.concat("question", F.lit("\n"), "content").alias("prompt"))
    got = answer(prompts, provider, **how).where("answer IS NOT NULL AND trim(answer) <> ''")
    c = got.groupBy("doc_id", "name", "answer").agg(F.count("*").alias("n"), F.min("page").alias("seen"))
    best = c.groupBy("doc_id", "name").agg(F.sum("n").alias("total"), F.max_by(F.struct("answer", "n"), F.struct("n", -F.col("seen"))).alias("b"), F.min_by("answer", "seen").alias("first"))
    value = F.when((F.col("b.n") > 1) & (F.col("b.n") >= F.floor(F.col("total") / 2)), F.col("b.answer")).otherwise(F.col("first"))
    meta = best.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", value.alias("v"))))).alias("custom_metadata"))  # an entry for each question
    return chunks.join(meta, "doc_id", "left").withColumn("custom_metadata", F.coalesce("custom_metadata", F.create_map().cast("map<string,string>")))


def query_filters(queries: DataFrame, keys: list[str], provider: Provider, **how) -> DataFrame:
    """queries (qid, question) with rewritten (question) and filters (map): a provider's JSON {question, filters} for a prompt of the index's metadata keys and the question; only known keys stay."""
    prompt = F.concat(F.lit("keys: " + ", ".join(sorted(keys)) + "\nquestion: "), F.col("question"))
    got = answer(queries.select("qid", prompt.alias("prompt")), provider, as_json=True, **how)
    body = T.fenced_json(F.col("answer"))
    found = F.from_json(F.get_json_object(body, "$.filters"), "map<string,string>")
    known = F.map_filter(F.coalesce(found, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*keys)) if keys else F.create_map().cast("map<string,string>")
    out = got.select(F.col("qid").alias("__q"), F.get_json_object(body, "$.question").alias("rewritten"), known.alias("filters"))
    return queries.join(out, F.col("qid") == F.col("__q")).drop("__q")


def numbered_blocks(text: Column) -> Column:
    """Questions of an answer like `Q1: … Type: … Answer: …` as structs (type, question, answer)."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)^\s*Q\d+\s*:"), lambda p: p.rlike(r"(?m)^\s*Type\s*:"))

    def field(p: Column, pattern: str) -> Column:
        return F.trim(F.regexp_extract(p, pattern, 1))

    return F.transform(parts, lambda p: F.struct(field(p, r"(?m)^\s*Type\s*:\s*(.*)$").alias("type"), field(p, r"(?s)^(.*?)(?:\n\s*(?:Type|Answer)\s*:|$)").alias("question"), field(p, r"(?m)^\s*Answer\s*:\s*(.*)$").alias("answer")))


def context_blocks(text: Column) -> Column:
    """Blocks between blank lines with at least four lines, as structs of their first four lines without a `label:`: sub_context, type, question, answer."""
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.size(F.split(F.trim(b), "\n")) >= 4)
    line = lambda b, i: F.trim(F.regexp_replace(F.get(F.split(F.trim(b), "\n"), F.lit(i)), r"^\s*[A-Za-z_ ]+\s*:\s*", ""))
    return F.transform(blocks, lambda b: F.struct(*[line(b, i).alias(n) for i, n in enumerate(("sub_context", "type", "question", "answer"))]))


QNA_PARSERS: dict[str, Callable[[Column], Column]] = {"blocks": T.qna_blocks, "context_blocks": context_blocks, "numbered": numbered_blocks}


def generate_questions(chunks: DataFrame, provider: Provider, template: str, parser: str = "blocks", second: str | None = None, count: int = 3, **how) -> DataFrame:
    """(id, pos, type, question, answer, …) made from chunks (id, content) by a prompt of {context} and {question_count}; with a second template of {question} as well, its answer replaces the first stage's."""
    p = chunks.select(F.col("id").alias("qid"), "content", T.fill(template, {"context": F.col("content"), "question_count": F.lit(count)}).alias("prompt"))
    got = answer(p, provider, **how)
    rows = got.select("qid", "content", F.posexplode(QNA_PARSERS[parser](F.col("answer"))).alias("pos", "b")).select(F.col("qid").alias("id"), "content", F.col("pos").cast("long").alias("pos"), "b.*")
    if second is None:
        return rows.drop("content")
    again = rows.select(F.struct("id", "pos").alias("qid"), T.fill(second, {"context": F.col("content"), "question": F.col("question")}).alias("prompt"))
    final = answer(again, provider, **how).select(F.col("qid.id").alias("__id"), F.col("qid.pos").alias("__pos"), F.col("answer").alias("__a"))
    return rows.join(final, (F.col("id") == F.col("__id")) & (F.col("pos") == F.col("__pos")), "left").withColumn("answer", F.coalesce("__a", "answer")).drop("__id", "__pos", "__a", "content")


def prompt_scores(rows: DataFrame, metrics: dict[str, str], provider: Provider, **how) -> DataFrame:
    """(qid, metric, score, reasons): each row (qid, question, answer, context) by each metric's template of {question}, {answer} and {context}; the provider's JSON has score and reasons, -1 and empty where it cannot be read."""
    named = F.explode(F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])).alias("metric", "template")
    m = rows.select("qid", "question", "answer", "context", named)
    prompt = F.col("template")
    for c in ("question", "answer", "context"):
        prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c), F.lit("")))
    got = answer(m.select(F.struct("qid", "metric").alias("qid"), prompt.alias("prompt")), provider, **how)
    body = T.fenced_json(F.col("answer"))
    return got.select("qid.qid", "qid.metric", T.json_score(F.col("answer")).alias("score"), F.coalesce(F.get_json_object(body, "$.reasons"), F.lit("")).alias("reasons"))


def overlap_scores(rows: DataFrame) -> DataFrame:
    """(qid, context_recall, answer_precision, answer_recall, answer_f) from token sets of question, answer, contexts (array) and ground_truth: local stand-ins for a model's judgement; those that need a ground truth are null without one."""
    a, t = F.array_distinct(T.tokens(F.col("answer"))), F.array_distinct(T.tokens(F.col("ground_truth")))
    c = F.array_distinct(T.tokens(F.array_join("contexts", " ")))
    s = rows.select("qid", "ground_truth", a.alias("a"), t.alias("t"), c.alias("c"))

    def share(x: str, y: str) -> Column:
        return F.when(F.size(y) > 0, F.round(F.size(F.array_intersect(x, y)) / F.size(y), 6)).otherwise(F.lit(0.0))

    known = F.col("ground_truth").isNotNull()
    s = s.select("qid", F.when(known, share("c", "t")).alias("context_recall"), share("c", "a").alias("answer_support"), F.when(known, share("t", "a")).alias("answer_precision"), F.when(known, share("a", "t")).alias("answer_recall"))
    p, r = F.col("answer_precision"), F.col("answer_recall")
    return s.withColumn("answer_f", F.when(p + r > 0, F.round(2 * p * r / (p + r), 6)).when(p.isNotNull(), 0.0))


def mean_of(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row of the mean of each value, NaN and null left out; a value without any is null."""
    return rows.agg(*[F.round(F.avg(F.when(~F.isnan(v), F.col(v))), 6).alias(v) for v in values])


def load_dataset(raw: DataFrame) -> DataFrame:
    """Evaluation rows (question, contexts, ground_truth, answer, additional_data) of JSON objects (`value`): other keys go to additional_data as JSON; rows without question or contexts are an error."""
    have = F.json_object_keys("value")
    if raw.where(~F.coalesce(F.array_contains(have, "question") & F.array_contains(have, "contexts"), F.lit(False))).limit(1).count():
        raise ValueError("every entry needs question and contexts")
    known = ("question", "contexts", "ground_truth", "answer")
    rest = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(*known))
    return raw.select(F.get_json_object("value", "$.question").alias("question"), F.from_json(F.get_json_object("value", "$.contexts"), "array<string>").alias("contexts"),
                      F.get_json_object("value", "$.ground_truth").alias("ground_truth"), F.get_json_object("value", "$.answer").alias("answer"), F.to_json(rest).alias("additional_data"))


def search_request(questions: DataFrame, top_k: int, limit: int = 100) -> None:
    """A search request's rules: questions there and not blank, at most `limit` of them, a positive top_k; else an error."""
    n, blank = questions.agg(F.count("*"), F.count_if(F.col("question").isNull() | (F.trim("question") == ""))).first()
    if not n or blank or n > limit or top_k <= 0:
        raise ValueError(f"{n} questions, {blank} of them blank, top_k {top_k}")


def semantic_search(questions: DataFrame, chunks: DataFrame, sparse: DataFrame, dense: DataFrame, provider: Provider, template: str, k: int = 3, **how) -> DataFrame:
    """(qid, answer, status, contexts, source_id): ranked lists (qid, id, rank) fused, the k best chunks (id, content) as context, and the provider's answer; contexts are joined by full stops up to k."""
    fused = checkpoint(search.rrf([sparse, dense], k))  # k rows a question, which three joins read
    matches = fused.join(chunks.select("id", "content"), "id").select("qid", "id", "rank", "score", "content")
    got = read(questions.withColumn("attribute_key", F.col("qid").cast("string")), matches, provider, template, k=k, **how)
    context = matches.groupBy(F.col("qid").alias("__q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda e: e["content"]), ".").alias("contexts"))  # k chunks
    return got.join(context, F.col("qid") == F.col("__q"), "left").select("qid", "answer", "status", F.coalesce("contexts", F.lit("")).alias("contexts"), "source_id")
