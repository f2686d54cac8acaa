"""Licence scan: lines against licence templates by Dice coefficient over word bigrams.

A line and a template are lower-cased and cut into words (runs of letters and
digits); their bags of word bigrams of sizes a and b that share c give Dice
2c / (a + b).  Since c is at most min(a, b), a Dice of t needs a and b within a
factor of (2 - t) / t: lines no template can match by size are dropped before
any bigram is made, and each bigram meets only templates within bounds.
Everything is DataFrame expressions; the templates' bigrams (a fixed list of a
few hundred) are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

DICE = 0.8
WORD_BREAK = r"[^\p{L}\p{N}]+"

#: licence -> notices, in the wording in which they are commonly given
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "bsd-3-clause": ["Use of this source code is governed by a BSD-style license.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}


def template_bigrams(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, int, str, int]]:
    """(licence, notice number, bigrams, bigram, times) rows of all notices of two words or more."""
    out = []
    for licence, notices in templates.items():
        for i, notice in enumerate(notices):
            words = re.findall(r"[^\W_]+", notice.lower())
            grams = Counter(zip(words, words[1:]))
            out += [(licence, i, len(words) - 1, f"{a} {b}", n) for (a, b), n in grams.items()]
    return out


def size_bounds(size: int, dice: float) -> tuple[int, int]:
    """Fewest and most bigrams a line may have to reach ``dice`` with a template of ``size``."""
    factor = (2 - dice) / dice
    return math.ceil(size / factor - 1e-9), math.floor(size * factor + 1e-9)


def licence_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE,
                  templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, line, licence, dice): the best template of every line that reaches ``dice`` (ties by name).

    Lines are cut at line feeds and numbered from 0.  Null and empty texts and one-word lines match nothing.
    Repeated rows are matched each by itself; null ids stay null; other columns are not read.
    """
    spark = docs.sparkSession
    grams = template_bigrams(templates)
    bounds = [size_bounds(g[2], dice) for g in grams]
    table = spark.createDataFrame([(*g, *b) for g, b in zip(grams, bounds)],
                                  "licence string, notice int, size long, gram string, times long, lo long, hi long")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        F.posexplode(F.split(text_of(text_col), "\n")).alias("line", "text"))
    words = lines.select("doc_id", "row", "line", F.array_remove(F.split(F.lower("text"), WORD_BREAK), "").alias("words"))
    sized = words.withColumn("n", (F.size("words") - 1).cast("long")).where(
        F.col("n").between(max(1, min(lo for lo, _ in bounds)), max(hi for _, hi in bounds)))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.col("n").cast("int")), F.slice("words", F.lit(2), F.col("n").cast("int")),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    each = sized.select("doc_id", "row", "line", "n", F.explode(pairs).alias("gram"))
    met = each.join(F.broadcast(table), "gram").where("n between lo and hi")
    shared = met.groupBy("row", "doc_id", "line", "n", "licence", "notice", "size", "gram", "times").agg(
        F.least(F.count("*"), F.col("times")).alias("shared"))
    scored = shared.groupBy("row", "doc_id", "line", "n", "licence", "notice", "size").agg(
        (2.0 * F.sum("shared") / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= dice)
    best = scored.groupBy("row", "doc_id", "line").agg(F.min(F.struct((-F.col("dice")).alias("less"), "licence")).alias("best"))
    return best.select("doc_id", F.col("line").cast("long").alias("line"), "best.licence", (-F.col("best.less")).alias("dice"))


def licence_sql(dice: float = DICE, templates: dict[str, list[str]] = TEMPLATES) -> str:
    """The same matches in DuckDB SQL over ``documents``."""
    rows = ", ".join(f"('{lic}', {i}, {size}, '{gram}', {n}, {size_bounds(size, dice)[0]}, {size_bounds(size, dice)[1]})"
                     for lic, i, size, gram, n in template_bigrams(templates))
    return rf"""
        WITH t(licence, notice, size, gram, times, lo, hi) AS (VALUES {rows}),
        d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, r, unnest(ls) AS txt, unnest(range(len(ls))) AS line FROM d),
        w AS (SELECT doc_id, r, line, list_filter(regexp_split_to_array(lower(txt), '{WORD_BREAK}'), lambda x: x <> '') AS ws FROM l),
        g AS (SELECT doc_id, r, line, len(ws) - 1 AS n, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram
              FROM w WHERE len(ws) > 1),
        s AS (SELECT doc_id, r, line, n, licence, notice, size, gram, least(count(*), times) AS c
              FROM g JOIN t USING (gram) WHERE n BETWEEN lo AND hi 
              GROUP BY doc_id, r, line, n, licence, notice, size, gram, times),
        m AS (SELECT doc_id, r, line, licence, 2.0::DOUBLE * sum(c)::DOUBLE / (n + size) AS dice
              FROM s GROUP BY doc_id, r, line, n, licence, notice, size)
        SELECT doc_id, line::BIGINT AS line, first(licence ORDER BY dice DESC, licence) AS licence, max(dice) AS dice
        FROM m WHERE dice >= {dice} GROUP BY doc_id, r, line"""
