"""License scan: an exact set-similarity (containment) join of text blocks with templates.

Tokens are ordered by their frequency, rarest first, over all blocks that have enough template tokens to match any template; any order
gives the same result. A block B contains at
least ``threshold`` of template T only if they share alpha = ceil(threshold * |T|) tokens, so
 - one of T's first |T| - alpha + 1 tokens is among B's tokens (prefix filter),
 - B has at least alpha tokens (length filter),
 - a shared token at position i of T and j of B leaves room for alpha shared ones (positional filter).
What passes is verified by the true overlap. Tokens that no template has can't add to an
overlap, so blocks are reduced to the templates' vocabulary at the scan; the filters are
exact on the reduced blocks, too. Texts never move: only the few tokens kept of a block do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, spread, stage, table

#: Notices and header paragraphs of common licenses: (template, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-short", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-short", "Licensed under the GNU Lesser General Public License."),
    ("agpl-short", "Licensed under the GNU Affero General Public License."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
)
THRESHOLD = 0.8
_SEP = r"[^\p{L}\p{N}]+"


def template_tokens(text: str) -> list[str]:
    return sorted({t for t in re.split(r"[^\w]+|_+", text.lower()) if t})


def alpha(size: int, threshold: float) -> int:
    """Least overlap with a template of ``size`` tokens."""
    return max(1, math.ceil(threshold * size - 1e-9))


def blocks(docs: DataFrame, vocabulary: Sequence[str], least: int) -> DataFrame:
    """(doc_id, para_no, line_no, tokens) of every line, and with line_no -1 of every paragraph of
    several lines, that has at least ``least`` distinct tokens of the vocabulary."""
    words = sorted(vocabulary)
    paras = docs.select("doc_id", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("para_no", "para"))
    per_line = F.transform(
        F.split("para", "\n"),
        lambda line: F.array_distinct(F.filter(F.split(F.lower(line), _SEP), lambda t: t.isin(words))),
    )
    lined = paras.select("doc_id", "para_no", per_line.alias("lines")).select(
        "doc_id",
        "para_no",
        F.concat(
            F.transform("lines", lambda toks, i: F.struct(i.alias("line_no"), toks.alias("tokens"))),
            F.when(
                F.size("lines") > 1,
                F.array(F.struct(F.lit(-1).alias("line_no"), F.array_distinct(F.flatten("lines")).alias("tokens"))),
            ).otherwise(F.array().cast("array<struct<line_no:int,tokens:array<string>>>")),
        ).alias("b"),
    )
    kept = F.filter("b", lambda x: F.size(x["tokens"]) >= F.lit(least))
    return lined.select("doc_id", "para_no", F.explode(kept).alias("b")).select("doc_id", "para_no", "b.line_no", "b.tokens")


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, para_no, line_no, template, overlap, template_size, containment) of every text block that
    holds at least ``threshold`` of a template's distinct tokens.

    A block is a line, or (line_no -1) a paragraph of several lines; paragraphs end at blank lines,
    and both are numbered from 0. Null and empty texts have no blocks. Rows with a null id are scanned like any others. Tokens of equal frequency are ordered by themselves. Repeated rows (same id and text) give
    their matches once. A text of any length is scanned whole. No documents, or no templates with a
    token, give an empty result. Other columns play no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    tokens = {name: template_tokens(text) for name, text in templates}
    tokens = {name: toks for name, toks in tokens.items() if toks}
    vocabulary = sorted({t for toks in tokens.values() for t in toks})
    least = min((alpha(len(t), threshold) for t in tokens.values()), default=1)
    own = spread(narrow(docs, doc_id=id_col, text=text_col))
    found = stage(blocks(own, vocabulary or [""], least), "blocks")

    # the global order: how many of all blocks have the token; ties by the token
    frequency = {r["t"]: r["n"] for r in found.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    index, prefix_tokens = [], set()
    for name, toks in tokens.items():
        ranks = sorted(rank[t] for t in toks)
        need = alpha(len(ranks), threshold)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, name, i, need, ranks))
            prefix_tokens.add(vocabulary_of(rank, r))
    prefixes = spark.createDataFrame(index, "rank int, template string, t_pos int, alpha int, t_ranks array<int>")
    ranked = spark.createDataFrame(list(rank.items()), "token string, rank int")
    ranking = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.lit(r)) for t, r in rank.items()])) if rank else None
    if ranking is None:
        return ranked.select(*[F.lit(None).cast(t).alias(c) for c, t in _SCHEMA(own)]).limit(0)

    hits = found.where(F.exists("tokens", lambda t: t.isin(sorted(prefix_tokens)))).select(
        "doc_id", "para_no", "line_no", F.array_sort(F.transform("tokens", lambda t: ranking[t])).alias("b_ranks")
    )
    probes = hits.select("*", F.posexplode("b_ranks").alias("b_pos", "rank"))
    room = F.least(F.size("t_ranks") - F.col("t_pos"), F.size("b_ranks") - F.col("b_pos")) + F.least("t_pos", "b_pos")
    candidates = (
        probes.join(prefixes, "rank")
        .where((F.size("b_ranks") >= F.col("alpha")) & (room >= F.col("alpha")))
        .withColumn("overlap", F.size(F.array_intersect("b_ranks", "t_ranks")))
        .where("overlap >= alpha")
    )
    return candidates.select(
        "doc_id", "para_no", "line_no", "template", "overlap", F.size("t_ranks").alias("template_size"), (F.col("overlap") / F.size("t_ranks")).alias("containment")
    ).distinct()


def vocabulary_of(rank: dict[str, int], r: int) -> str:
    return next(t for t, i in rank.items() if i == r)


def _SCHEMA(own: DataFrame):  # noqa: N802
    return [("doc_id", own.schema["doc_id"].dataType), ("para_no", "int"), ("line_no", "int"), ("template", "string"), ("overlap", "int"), ("template_size", "int"), ("containment", "double")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))


_ROWS = ", ".join(f"('{name}', {[t for t in template_tokens(text)]!r}, {alpha(len(template_tokens(text)), THRESHOLD)})" for name, text in TEMPLATES)
SQL = f"""
WITH templates(template, tokens, alpha) AS (VALUES {_ROWS}),
paras AS (SELECT doc_id, unnest(p) AS para, generate_subscripts(p, 1) - 1 AS para_no
          FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS p FROM documents)),
lines AS (SELECT doc_id, para_no, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS line_no
          FROM (SELECT doc_id, para_no, string_split(para, chr(10)) AS l FROM paras)),
blocks AS (SELECT doc_id, para_no, line_no, block FROM lines
           UNION ALL SELECT doc_id, para_no, -1, para FROM paras WHERE contains(para, chr(10))),
tokens AS (SELECT doc_id, para_no, line_no, list_distinct(string_split_regex(lower(block), '[^\\p{{L}}\\p{{N}}]+')) AS b FROM blocks),
pairs AS (SELECT doc_id, para_no, line_no, template, len(list_intersect(b, tokens)) AS overlap, len(tokens) AS template_size, alpha
          FROM tokens, templates)
SELECT DISTINCT doc_id, para_no::INT AS para_no, line_no::INT AS line_no, template, overlap::INT AS overlap,
       template_size::INT AS template_size, round(overlap / template_size, 6) AS containment
FROM pairs WHERE overlap >= alpha
"""
