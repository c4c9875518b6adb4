"""Column expressions on text: tokens, cleaning, and parsers of model answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The 33 English stop words that the Lucene project's analyzers have by default; any list of lower-case words can be passed instead.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case word tokens of two or more characters, stop words left out, repeats kept; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def clean(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A prompt template with {name} placeholders; null values are empty."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def fenced_json(answer: Column) -> Column:
    """The JSON of an answer: all of it, or the body of its ```json fence; null if neither parses."""
    inside = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.when(F.try_parse_json(answer).isNotNull(), answer), F.when(F.try_parse_json(inside).isNotNull(), F.trim(inside)))


def json_score(answer: Column) -> Column:
    """`score` of a JSON answer within 0 to 3; -1 where it cannot be read."""
    score = F.get_json_object(fenced_json(answer), "$.score").try_cast("double")
    return F.when(score.isNull(), -1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(3.0), score)))


def free_score(answer: Column) -> Column:
    """A score in free text: the text itself, else the number behind `score:` or `rating:`, else its only number; null else."""
    number = r"-?\d+(?:\.\d+)?"
    direct = F.when(answer.rlike(rf"^\s*{number}\s*$"), F.trim(answer).try_cast("double"))
    named = F.regexp_extract(answer, rf"(?i)(?:score|rating)\s*[:=]\s*({number})", 1).try_cast("double")
    every = F.regexp_extract_all(answer, F.lit(number), F.lit(0))
    return F.coalesce(direct, named, F.when(F.size(every) == 1, every[0].try_cast("double")))


def qna_blocks(answer: Column, fields: tuple[str, ...] = ("type", "question", "answer", "source")) -> Column:
    """Blocks between blank lines with at least three lines, as structs of their first lines without a `label:`."""
    blocks = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\n\s*\n"), lambda b: F.size(F.split(F.trim(b), "\n")) >= 3)
    strip = r"^\s*[A-Za-z]+\s*:\s*"
    return F.transform(blocks, lambda b: F.struct(*[F.trim(F.regexp_replace(F.get(F.split(F.trim(b), "\n"), F.lit(i)), strip, "")).alias(n) for i, n in enumerate(fields)]))


def natural_key(name: Column) -> list[Column]:
    """Sort keys: a leading number (none: last), then the name."""
    return [F.coalesce(F.regexp_extract(name, r"^(\d+)", 1).try_cast("double"), F.lit(float("inf"))), name]


def confidence_pct(score: Column) -> Column:
    """1 - score for a positive distance, else -1."""
    return F.when(score > 0, 1 - score).otherwise(F.lit(-1.0))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An identifier that follows from its parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 10))
