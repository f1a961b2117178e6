"""Licence scan: Dice coefficient over word bigrams.

A document is looked at in units: every line, every paragraph of several lines
(a line without words ends a paragraph), and, if it has several paragraphs, the
whole of it.  A unit's words are what stands
between punctuation and blanks (all ASCII but letters and digits, U+0080 to
U+00BF, and the blocks of general and CJK punctuation), A-Z lowered; it matches a template if the Dice
coefficient of their sets of word bigrams reaches ``percent``.

Sets of a and b bigrams have a coefficient of at most 2 * min(a, b) / (a + b), so a
template only comes into question for units whose size lies within its bounds.
Units outside the bounds of all templates are dropped before their bigrams are
spread, the join checks the bounds of each template, and only rows that pass it
are shuffled, by document.  All steps are built-in functions.

Defined results: a null or empty text, and a unit of one word, match nothing;
repeated documents are reported once; templates are rows of a table, those
without a bigram match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.llm.native import ascii_lower
from cartledger.llm.session import staged

WORD_GAP = "[\\x00-\\x09\\x0B-/:-@\\[-`{-\\x{BF}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}]+"
_ONE = WORD_GAP[:-1]
GAP = f"(?! (?!{_ONE})){WORD_GAP}"  # but for a blank alone, which is to become one anyway
LOOKED_AT = 4  # times as many words as a matching unit has bigrams tell whether a unit is too long
MANY = 2**31 - 1
PARAGRAPH_GAP = "\n(?: *\n)+"

# The wording of common licence notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]


@dataclass(frozen=True)
class Dice:
    percent: int = 80


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def _spread(worded: DataFrame, least: int, most: int) -> DataFrame:
    """One row (gram, n) per distinct word bigram (as a 64-bit hash) of each ``w`` whose number n of them lies within the bounds.

    Words and bigrams are steps of their own and no filter stands on them, so
    each is computed once; units out of bounds spread nothing.  All but the first
    of d different words end a bigram of their own, so there are at least d - 1 of
    those: long units are known by their first words and their bigrams not made.
    """
    if most < MANY:
        different = F.size(F.array_distinct(F.slice("w", 1, LOOKED_AT * (most + 2))))
        worded = worded.withColumn("w", F.when((F.size("w") > least) & (different <= most + 1), F.col("w")).otherwise(F.slice("w", 1, 0)))
    left = F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(left, F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    found = worded.withColumn("grams", F.array_distinct(pairs)).drop("w")
    n = F.coalesce(F.size("grams"), F.lit(0))  # never null, or a join on it would filter the units by an n of its own
    return found.select(
        *[c for c in found.columns if c != "grams"], n.alias("n"), F.explode(F.when(n.between(least, most), F.col("grams"))).alias("gram")
    )


def _plain(text: Column) -> Column:
    """A-Z lowered, gaps as single blanks, line breaks kept; the pattern runs once over the whole text."""
    return F.regexp_replace(ascii_lower(text), GAP, " ")


def _words(plain: Column) -> Column:
    return F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" ")), " "), "")


def _units(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, no, w): words of the lines, the paragraphs of several lines, the text of several paragraphs."""
    found = documents.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), _plain(F.col(text)).alias("plain")
    )
    lines, newline = F.split("plain", "\n"), F.lit("\n")
    blocks = F.filter(F.split("plain", PARAGRAPH_GAP), lambda p: F.contains(p, newline))
    units = (
        F.when(~F.contains("plain", newline), F.array("plain"))
        .when(F.col("plain").rlike(PARAGRAPH_GAP), F.concat(lines, blocks, F.array("plain")))
        .otherwise(F.concat(lines, F.array("plain")))
    )
    listed = found.select("doc_id", "row", F.posexplode(units).alias("no", "unit"))
    return listed.select("doc_id", "row", "no", _words(F.col("unit")).alias("w"))


def scan(
    documents: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", dice: Dice = Dice()
) -> DataFrame:
    """(doc_id, license_id, dice, n_units): the best coefficient of each licence and the units that match it."""
    p = dice.percent
    known = templates.select("license_id", F.xxhash64("license_id", "text").alias("template"), "text").distinct()
    known = _spread(known.select("license_id", "template", _words(_plain(F.col("text"))).alias("w")), 1, MANY).select(
        "license_id",
        "template",
        F.col("n").alias("size"),
        F.ceil(F.col("n") * p / (200 - p)).alias("least"),
        F.floor(F.col("n") * (200 - p) / p).alias("most"),
        "gram",
    )
    known = staged(known, "license_templates")
    bounds = known.agg(F.min("least"), F.max("most")).first()
    spread = _spread(_units(documents, doc_id, text), bounds[0] or 1, bounds[1] or 0)
    held = spread.join(known, "gram").where("n BETWEEN least AND most")
    # Equal rows share id, hash and unit number: distinct bigrams are counted.
    held = held.select("doc_id", "row", "no", "n", "license_id", "template", "size", "gram").distinct()
    matched = held.groupBy("doc_id", "row", "no", "n", "license_id", "template", "size").agg(F.count(F.lit(1)).alias("shared"))
    matched = matched.where(200 * F.col("shared") >= p * (F.col("n") + F.col("size")))
    value = 2 * F.col("shared") / (F.col("n") + F.col("size"))
    per_unit = matched.groupBy("doc_id", "row", "no", "license_id").agg(F.max(value).alias("dice"))
    found = per_unit.groupBy("doc_id", "row", "license_id").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))
    return found.select("doc_id", "license_id", "dice", "n_units")
