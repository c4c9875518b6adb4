"""Tool calls and their results: linked, ordered, validated and written as canonical JSON; DataFrame operations only.

Calls and results meet in a hash join on (conversation, identifier). A call may name the
call it follows (its parent, in the same conversation); depths come from pointer doubling,
so a chain of n calls takes about log2(n) joins on identifiers, and no conversation is ever
collected. Arguments are parsed to a variant, whose text has sorted keys and no blanks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paperlake.llm.common import checkpoint


@dataclass(frozen=True)
class Param:
    """A parameter of a tool: its JSON type and whether a call must have it."""

    kind: str  # string, integer, number, boolean, object or array
    required: bool = True
    least: float | None = None


_KINDS = {
    "string": "t = 'STRING'", "integer": "t = 'BIGINT'", "number": "t IN ('BIGINT', 'DOUBLE') OR t LIKE 'DECIMAL%'",
    "boolean": "t = 'BOOLEAN'", "object": "t LIKE 'OBJECT%'", "array": "t LIKE 'ARRAY%'",
}


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def argument_errors(name_col: str, json_col: str, schemas: dict[str, dict[str, Param]]) -> Column:
    """A call's errors as sorted strings: bad_json, unknown_tool, missing:p, type:p, range:p, unknown:p."""
    checks = []
    for tool, params in schemas.items():
        found = []
        for p, rule in params.items():
            path = _quoted("$['" + p + "']")
            value = f"try_variant_get(__args, {path}, 'variant')"
            kind = f"transform(array(schema_of_variant({value})), t -> {_KINDS[rule.kind]})[0]"
            absent = f"{value} IS NULL"
            found.append(f"CASE WHEN {absent} THEN {_quoted('missing:' + p) if rule.required else 'NULL'} WHEN NOT ({kind}) THEN {_quoted('type:' + p)}"
                         + (f" WHEN try_variant_get(__args, {path}, 'double') < {rule.least} THEN {_quoted('range:' + p)}" if rule.least is not None else "") + " END")
        known = ", ".join(_quoted(p) for p in params) or "''"
        extra = f"transform(filter(coalesce(json_object_keys({json_col}), array()), k -> k NOT IN ({known})), k -> concat('unknown:', k))"
        checks.append(f"WHEN {name_col} = {_quoted(tool)} THEN array_sort(filter(concat(array({', '.join(found)}), {extra}), e -> e IS NOT NULL))")
    object_ = "coalesce(schema_of_variant(__args) LIKE 'OBJECT%', false)"
    return F.expr(f"CASE WHEN NOT {object_} THEN array('bad_json') {' '.join(checks)} ELSE array('unknown_tool') END")


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call_id, parent) -> (conv, call_id, depth): 0 for a call without a known parent, one more than the parent's else; null on or behind a cycle."""
    ids = calls.select("conv", "call_id").distinct()
    p = ids.select(F.col("conv").alias("__c"), F.col("call_id").alias("__p"))
    state = calls.groupBy("conv", "call_id").agg(F.min("parent").alias("parent")).join(
        p, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("parent") == F.col("__p")), "left"
    ).select("conv", "call_id", F.col("__p").alias("up"), F.when(F.col("__p").isNull(), 0).otherwise(1).alias("depth"))
    state = checkpoint(state)
    total, step = state.count(), 1
    while step <= 2 * total and state.where("up IS NOT NULL").limit(1).count():
        other = state.select(F.col("conv").alias("__c"), F.col("call_id").alias("__i"), F.col("up").alias("__u"), F.col("depth").alias("__d"))
        state = checkpoint(
            state.join(other, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("up") == F.col("__i")), "left").select(
                "conv", "call_id", F.col("__u").alias("up"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"))
        )
        step *= 2
    return state.select("conv", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Param]]) -> DataFrame:
    """Rows (conv, call_id, kind, position, status, errors, message) of calls and results.

    calls has (conv, call_id, parent, name, arguments), results (conv, call_id, content). kind is call or
    result; position orders a conversation with every call behind its parent's result and every result behind
    its call (2 x depth, and one more; null where calls run in a cycle, or for a result without a call). status of
    a call: ok, invalid, unanswered, duplicate or cycle; of a result: ok, orphan or duplicate. message is
    canonical JSON: sorted keys, no blanks. A null identifier links to nothing; null conversations are one
    conversation; bad or null arguments are bad_json and stay as a string; rows equal in every column stay, as
    duplicates. Other columns are not read; empty tables give none.
    """
    calls = calls.select("conv", "call_id", "parent", "name", "arguments")
    results = results.select("conv", "call_id", "content")
    depth = depths(calls.where("call_id IS NOT NULL")).select(F.col("conv").alias("__c"), F.col("call_id").alias("__i"), "depth")
    asked = calls.groupBy("conv", "call_id").agg(F.count("*").alias("n")).where("call_id IS NOT NULL").select(F.col("conv").alias("__ac"), F.col("call_id").alias("__ai"), F.col("n").alias("asked"))
    got = results.groupBy("conv", "call_id").agg(F.count("*").alias("n")).where("call_id IS NOT NULL").select(F.col("conv").alias("__gc"), F.col("call_id").alias("__gi"), F.col("n").alias("got"))

    def on(c: str, i: str) -> Column:
        return F.col("conv").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(i))

    known = depth.join(asked, (F.col("__c").eqNullSafe(F.col("__ac"))) & (F.col("__i") == F.col("__ai"))).join(
        got.hint("shuffle_hash"), (F.col("__c").eqNullSafe(F.col("__gc"))) & (F.col("__i") == F.col("__gi")), "left"
    ).select("__c", "__i", "depth", "asked", F.coalesce("got", F.lit(0)).alias("got"))
    c = calls.join(known.hint("shuffle_hash"), on("__c", "__i"), "left").withColumn("__args", F.expr("try_parse_json(arguments)"))
    c = c.withColumn("errors", argument_errors("name", "arguments", schemas))
    status = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("asked") > 1, "duplicate").when(F.col("call_id").isNull() | (F.col("got") == 0), "unanswered")
        .when(F.col("depth").isNull(), "cycle").otherwise("ok")
    )
    said = F.when(
        F.expr("__args IS NULL"), F.expr("to_json(named_struct('arguments', arguments, 'id', call_id, 'name', name, 'type', 'call'))")
    ).otherwise(F.expr("concat('{\"arguments\":', to_json(__args), ',', substr(to_json(named_struct('id', call_id, 'name', name, 'type', 'call')), 2))"))
    c = c.select("conv", "call_id", F.lit("call").alias("kind"), (2 * F.when(F.col("call_id").isNull(), 0).otherwise(F.col("depth"))).cast("long").alias("position"),
                 status.alias("status"), F.array_join("errors", ",").alias("errors"), said.alias("message"))
    r = results.join(known.hint("shuffle_hash"), on("__c", "__i"), "left").select(
        "conv", "call_id", F.lit("result").alias("kind"), (2 * F.col("depth") + 1).cast("long").alias("position"),
        F.when(F.col("asked").isNull(), "orphan").when(F.col("got") > 1, "duplicate").otherwise("ok").alias("status"), F.lit("").alias("errors"),
        F.expr("to_json(named_struct('content', content, 'id', call_id, 'type', 'result'))").alias("message"))
    return c.unionByName(r)


def _turns(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def chat_calls(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chat turns as calls and results: a user turn t calls `ask` as c<t>, follows c<t - 2>, and turn t + 1 is its result if an assistant's.

    Turns of any other role, or of none, are neither: other_messages has them. A null turn has no identifier; null conversations are
    one; null texts stay null; repeated rows stay; other columns are not read; an empty table gives none of either.
    """
    rows = _turns(messages, conv_col, turn_col, role_col, text_col)
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    calls = rows.where("role = 'user'").select(
        "conv", call_id.alias("call_id"), F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")).alias("parent"), F.lit("ask").alias("name"),
        F.expr("to_json(named_struct('turn', turn, 'prompt', text))").alias("arguments"))
    results = rows.where("role = 'assistant'").select("conv", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns that are neither calls nor results, as rows like link_calls': kind message, without identifier and position, status ok.

    Null roles, turns and texts are left out of the message's JSON.
    """
    rows = _turns(messages, conv_col, turn_col, role_col, text_col).where("role IS NULL OR role NOT IN ('user', 'assistant')")
    return rows.select(
        "conv", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("position"), F.lit("ok").alias("status"), F.lit("").alias("errors"),
        F.expr("to_json(named_struct('content', text, 'role', role, 'turn', turn, 'type', 'message'))").alias("message"))


CHAT_SCHEMAS = {"ask": {"prompt": Param("string"), "turn": Param("integer", least=0)}}
