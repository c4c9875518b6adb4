"""License scans by diagonal voting.

All word 3-grams of every text are joined, by hash, to their places in license templates.
A template that stands in a text gives votes on one diagonal (text position less template
position); words put in or left out move them to neighbouring ones, which are merged. A
run that spreads too far, as a phrase repeated back to back does, is split at its widest
gaps until it does not, if need be into single diagonals. A run's span is verified by
words: its 3-grams, taken in text order as far as they stand in template order, must cover
enough of the template and every word of the template's name in it. The table of templates
is part of this module, so its broadcast has a fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from paperlake.llm.common import checkpoint, repeat_rows, text_digest, words

GRAM = 3
#: Neighbouring diagonals at most so far apart are one run.
NEAR = 4
MIN_COVER = 0.6
MAX_SPREAD = 2.0
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values: (label, the words that name the license, wording from the public license texts). A find must have the name;
#: long wordings that are a license's own need none.
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-2.0", "Apache License", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "MIT License", "Released under the MIT License"),
    ("mit", "MIT License", "Licensed under the MIT License"),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "GNU General Public License", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "GNU General Public License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "GNU Lesser General Public License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "CC BY 4.0", "Licensed under CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "CC BY-SA 4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]
_DOCUMENT = 0
_HASHES = "if(size(w) < 3, CAST(array() AS array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"


def _template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def _named_places(name: str, text: str) -> list[int]:
    """Where a template has the words of its name, the first such place."""
    n, w = _template_words(name), _template_words(text)
    at = next((i for i in range(len(w) - len(n) + 1) if w[i : i + len(n)] == n), None)
    if at is None:
        raise ValueError(f"the name {name!r} is not in the template {text!r}")
    return list(range(at, at + len(n)))


def _grams(docs: DataFrame, templates: list[tuple[str, str, str]], phrases: list[str], apart: str) -> DataFrame:
    """Rows (id, digest, n, pos, tpl, tpos, apart): one with tpl -1 for each document, one for each 3-gram of a template, and one with tpl -2 - i for each place of phrase i of three words.

    A gram's row carries its three words and not the text, so the work is linear in a text's length.
    """
    spark = docs.sparkSession
    if any(len(_template_words(t)) < GRAM for _, _, t in templates):
        raise ValueError(f"a template has fewer than {GRAM} words")
    texts = [(i, t) for i, (_, _, t) in enumerate(templates)] + [(-2 - i, t) for i, t in enumerate(phrases) if len(t.split()) == GRAM]
    literals = F.array(*[F.struct(F.lit(i).alias("tpl"), F.lit(t).alias("text")) for i, t in texts] or [F.struct(F.lit(0).alias("tpl"), F.lit("").alias("text"))])
    table = spark.range(1).select(F.inline(literals)).select("tpl", words(F.col("text")).alias("w")).select(
        "tpl", "w", F.posexplode(F.expr(_HASHES)).alias("tpos", "key")).selectExpr("key", "tpl", "tpos", "w[tpos] AS ta", "w[tpos + 1] AS tb", "w[tpos + 2] AS tc")
    table = table.unionByName(spark.range(1).selectExpr(f"{_DOCUMENT}L AS key", "-1 AS tpl", "0 AS tpos", "'' AS ta", "'' AS tb", "'' AS tc"))
    kind = "named_struct('key', {}, 'pos', {}, 'a', {}, 'b', {}, 'c', {}, 'n', {}, 'apart', {})"
    none = "CAST(NULL AS array<struct<start:int,label:string,phrase:int>>)"
    alone = kind.format(f"{_DOCUMENT}L", "-1", "''", "''", "''", "size(w)", apart)
    gram = kind.format("xxhash64(w[i], w[i + 1], w[i + 2])", "i", "w[i]", "w[i + 1]", "w[i + 2]", "0", none)
    each = f"if(size(w) < {GRAM}, array({alone}), concat(array({alone}), transform(sequence(0, size(w) - {GRAM}), i -> {gram})))"
    met = docs.select("id", "digest", F.explode(F.expr(each)).alias("g")).select("id", "digest", "g.*").join(F.broadcast(table), "key")
    return met.where("if(pos < 0, tpl = -1, tpl <> -1 AND a = ta AND b = tb AND c = tc)").select("id", "digest", "n", "pos", "tpl", "tpos", "apart")


def _phrase_starts(phrase: str) -> str:
    """Starts of a phrase of any other length, as an array; most texts lack its first word and pay no more than that look."""
    first, *rest = phrase.split()
    same = " AND ".join([f"x = '{first}'"] + [f"get(w, i + {k + 1}) = '{r}'" for k, r in enumerate(rest)])
    return f"if(array_contains(w, '{first}'), filter(transform(w, (x, i) -> if(coalesce({same}, false), i, -1)), i -> i >= 0), CAST(array() AS array<int>))"


def _runs(diagonals: DataFrame, line: WindowSpec, near: int, size: str) -> DataFrame:
    """Diagonals with at_near, the run of those at most `near` apart, and whether it is narrow enough."""
    numbered = diagonals.withColumn("at_near", F.sum(F.coalesce((F.col("gap") > near).cast("int"), F.lit(1))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "digest", "tpl", "at_near")
    return numbered.withColumn("narrow", F.max("hi").over(whole) + GRAM - F.min("lo").over(whole) <= MAX_SPREAD * F.expr(size))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None,
         phrases: dict[str, str] | None = None, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest starts (null if
    none); spans are the finds (start, end, label, cover); score is 1 with a phrase, else the best cover, else 0. Null and
    empty texts have no words; null ids and equal rows stay; other columns are not read; an empty table gives none. A text's
    work is linear in its length, and what a template's votes in one text gather is bounded by that text.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    named = list(phrases)
    toks = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("w"))
    others = [(i, p) for i, p in enumerate(named) if len(p.split()) != GRAM]
    apart = ", ".join(f"transform({_phrase_starts(p)}, s -> named_struct('start', s, 'label', '{phrases[p]}', 'phrase', {i}))" for i, p in others)
    rows = _grams(toks, templates, named, f"concat({apart})" if apart else "CAST(array() AS array<struct<start:int,label:string,phrase:int>>)")
    label = "CASE tpl " + " ".join(f"WHEN {-2 - i} THEN '{phrases[p]}'" for i, p in enumerate(named)) + " ELSE '' END"
    base = F.when(F.col("tpl") < -1, F.struct(F.col("pos").alias("start"), F.expr(label).alias("label"), (-2 - F.col("tpl")).alias("phrase")))
    vote = F.when(F.col("tpl") >= 0, F.struct("tpl", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos"))
    per = checkpoint(rows.groupBy("id", "digest").agg(
        F.max("n").alias("n_words"), F.count_if(F.col("tpl") == -1).alias("copies"), F.collect_set(base).alias("base"), F.max("apart").alias("apart"), F.collect_set(vote).alias("votes")))
    documents = per.drop("votes")
    votes = per.where("size(votes) > 0").select("id", "digest", F.inline("votes")).groupBy("id", "digest", "tpl", "diagonal").agg(
        F.collect_set("tpos").alias("at"), F.min(F.col("diagonal") + F.col("tpos")).alias("lo"), F.max(F.col("diagonal") + F.col("tpos")).alias("hi"))
    line = Window.partitionBy("id", "digest", "tpl").orderBy("diagonal")
    size = "CASE tpl " + " ".join(f"WHEN {i} THEN {len(_template_words(t))}" for i, (_, _, t) in enumerate(templates)) + " ELSE 1 END"
    runs = checkpoint(_runs(votes.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(line)), line, NEAR, size))
    wide = runs.where("NOT narrow")
    if wide.limit(1).count():  # few texts have such, so the rest does not go through this
        split = wide.withColumn("run", F.lit(None).cast("struct<near:int,run:bigint>"))
        for near in range(NEAR - 1, -1, -1):
            split = _runs(split.drop("narrow", "at_near"), line, near, size).withColumn("run", F.coalesce("run", F.when(F.col("narrow") | (F.lit(near) == 0), F.struct(F.lit(near).alias("near"), F.col("at_near").alias("run")))))
        runs = runs.where("narrow").withColumn("run", F.struct(F.lit(NEAR).alias("near"), F.col("at_near").alias("run"))).unionByName(split)
    else:
        runs = runs.withColumn("run", F.struct(F.lit(NEAR).alias("near"), F.col("at_near").alias("run")))
    name = "CASE tpl " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(templates)) + " ELSE '' END"
    must = "CASE tpl " + " ".join(f"WHEN {i} THEN array({', '.join(map(str, _named_places(n, t)))})" for i, (_, n, t) in enumerate(templates) if n) + " ELSE array() END" if any(n for _, n, _ in templates) else "array()"
    places = F.transform("at", lambda t: F.struct((F.col("diagonal") + t).alias("start"), t.alias("tpos")))
    runs = runs.withColumn("places", places).groupBy("id", "digest", "tpl", "run").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    # in text order, the places that stand in template order as well
    chain = F.expr("aggregate(places, CAST(array() AS array<struct<start:int,tpos:int>>), (c, p) -> if(size(c) = 0 OR (p.start > element_at(c, -1).start AND p.tpos > element_at(c, -1).tpos), concat(c, array(p)), c))")
    runs = runs.withColumn("chain", chain).withColumn("at", F.expr("array_distinct(flatten(transform(chain, p -> array(p.tpos, p.tpos + 1, p.tpos + 2))))"))
    finds = runs.selectExpr("id AS __id", "digest AS __digest", "chain[0].start AS lo", f"element_at(chain, -1).start + {GRAM} AS hi", f"{name} AS label", f"size(at) / {size} AS cover", f"size(array_except({must}, at)) AS lacking").where(
        (F.col("cover") >= min_cover) & (F.col("lacking") == 0))
    finds = finds.groupBy("__id", "__digest").agg(F.sort_array(F.collect_set(F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"), "label", "cover"))).alias("spans"))
    out = documents.join(finds, F.col("id").eqNullSafe(F.col("__id")) & F.col("digest").eqNullSafe(F.col("__digest")), "left")
    out = out.withColumn("base", F.expr("concat(base, coalesce(apart, array()))")).withColumn("spans", F.expr("coalesce(spans, array())"))
    base = "array_distinct(transform(base, b -> b.label))"
    return repeat_rows(out.selectExpr(
        f"id AS {id_col}", "CAST(n_words AS long) AS n_words", "CAST(size(base) AS long) AS n_base", "CAST(array_min(transform(base, b -> b.start)) AS long) AS first_word",
        "CAST(array_max(transform(base, b -> b.start)) AS long) AS last_word", f"array_join(sort_array({base}), ',') AS base_labels",
        f"array_join(sort_array(array_distinct(concat({base}, transform(spans, s -> s.label)))), ',') AS labels",
        "CASE WHEN size(base) > 0 THEN 1.0D ELSE coalesce(array_max(transform(spans, s -> s.cover)), 0.0D) END AS score", "spans", "copies"), "copies")
