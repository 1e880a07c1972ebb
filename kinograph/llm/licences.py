"""Licence scan: normalised units of text compared with licence templates by the Dice coefficient of word bigrams.

A unit is a line, a sentence of a line, a paragraph, a run of up to RUN paragraphs, or the whole text. Dice = 2 * common / (a + b)
over distinct bigrams can reach t only if b lies between a * t / (2 - t) and a * (2 - t) / t. Units and templates
meet in an equi-join on the unit's number of bigrams, for which each template lists all sizes within its bounds; units
of other sizes are dropped before any comparison. A unit that reaches t lacks at most a * (1 - t / (2 - t)) of a template's bigrams,
so that texts without any of the words that stand in more bigrams than that (cues) aren't cut into units at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence notices and texts, by identifier
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the 2-Clause BSD License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the 3-Clause BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST_DICE = 0.9
#: Paragraphs of the longest run that is a unit.
RUN = 3
# Words too common to be cues where a template has others
COMMON = frozenset("a all an and any are as at be by can for from if in is it may not of on or that the this to under use used was with without you".split())


def words_of(text: str) -> list[str]:
    """ASCII letters and digits, lower-cased, in runs."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates: dict[str, str | tuple[str, ...]], least: float) -> list[tuple[str, list[str], int, int]]:
    """(licence, bigrams, smallest and largest unit size that can reach `least`) of each text of each licence."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in (texts,) if isinstance(texts, str) else texts:
            grams = bigrams_of(words_of(text))
            low, high = math.ceil(len(grams) * least / (2 - least) - 1e-9), math.floor(len(grams) * (2 - least) / least + 1e-9)
            out.append((name, grams, max(1, low), high))
    return out


def cues(known: list[tuple[str, list[str], int, int]]) -> list[str]:
    """Words of which every unit that can reach a template has one: for each template, words that stand in more of its bigrams
    than such a unit can lack, those of most bigrams first."""
    chosen: set[str] = set()
    for _, grams, low, _ in known:
        left = [set(g.split()) for g in grams]
        # a unit shares at least `low` of the bigrams
        while len(grams) - len(left) <= len(grams) - low:
            left = [g for g in left if not g & chosen]
            if len(grams) - len(left) > len(grams) - low:
                break
            count = Counter(w for g in left for w in g)
            chosen.add(min(count, key=lambda w: (w in COMMON, -count[w], -len(w), w)))
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """(row, doc_id, licence, dice, units): for every row of docs (doc_id, text) the licence with the highest Dice (ties: the
    first name), and how many different units reach `least` with any template. A licence may have several texts.

    A row without such a unit, an empty or null text: licence and dice null, units 0. Rows that repeat a doc_id, or have none,
    are scanned one by one. Other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("the Dice coefficient to reach has to be above 0 and at most 1")
    spark: SparkSession = docs.sparkSession
    parts = template_rows(templates or TEMPLATES, least)
    # one row for each text and size: bounded by the templates
    known = spark.createDataFrame(parts, "licence string, grams array<string>, low int, high int")
    known = known.select("licence", "grams", F.explode(F.sequence("low", "high")).alias("size"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    cued = rows.where(F.col("text").rlike("(?i)(?<![a-z0-9])(?:" + "|".join(cues(parts)) + ")(?![a-z0-9])"))
    lines = F.split("text", "\n")
    sentences = F.split(F.regexp_replace("text", r"([.!?])[ \t]+([A-Z(\"])", "$1\n$2"), "\n")
    paragraphs = F.split("text", "\n[ \t\r]*\n")
    runs = [F.transform(F.sequence(F.lit(1), F.size("p") - (k - 1)), lambda i: F.array_join(F.slice("p", i, k), "\n")) for k in range(2, RUN + 1)]
    runs = [F.when(F.size("p") >= k, run).otherwise(F.array().cast("array<string>")) for k, run in enumerate(runs, 2)]
    units = cued.withColumn("p", paragraphs).select("row", F.posexplode(F.array_distinct(F.concat(lines, sentences, "p", *runs, F.array("text")))).alias("u", "unit"))
    words = F.split(F.trim(F.regexp_replace(F.translate("unit", upper, lower), "[^a-z0-9]+", " ")), " ")
    sized = units.select("row", "u", words.alias("w")).where(F.size("w") > 1)
    grams = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    sized = sized.select("row", "u", grams.alias("g")).withColumn("size", F.size("g"))
    met = sized.join(F.broadcast(known), "size")
    dice = 2 * F.size(F.array_intersect("g", "grams")) / (F.col("size") + F.size("grams"))
    hits = met.select("row", "u", "licence", dice.alias("dice")).where(F.col("dice") >= least)
    first = F.min_by(F.struct("licence", "dice"), F.struct((-F.col("dice")).alias("d"), "licence"))
    named = hits.groupBy("row").agg(first.alias("b"), F.countDistinct("u").alias("units")).select("row", "units", "b.*")
    return rows.select("row", "doc_id").join(named, "row", "left").select("row", "doc_id", "licence", "dice", F.coalesce("units", F.lit(0)).cast("long").alias("units"))


def op2_licences(spark, sf_dir: str) -> DataFrame:
    """doc_id, licence, dice, units of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "licence", "dice", "units")


def oracle(templates: dict[str, str | tuple[str, ...]] | None = None, least: float = LEAST_DICE) -> str:
    """DuckDB SQL for op2_licences' rows."""
    values = ", ".join(f"('{n}', {g!r}::VARCHAR[], {low}, {high})" for n, g, low, high in template_rows(templates or TEMPLATES, least))
    runs = ", ".join(f"list_transform(range(1, len(p) - {k - 2}), lambda i: array_to_string(p[i:i + {k - 1}], chr(10)))" for k in range(2, RUN + 1))
    return f"""
    WITH known(licence, grams, low, high) AS (VALUES {values}),
    texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT r, t, string_split(t, chr(10)) AS l, string_split(regexp_replace(t, '([.!?])[ \\t]+([A-Z("])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS s,
                     string_split_regex(t, '\\n[ \\t\\r]*\\n') AS p FROM texts),
    units AS (SELECT r, unnest(list_distinct(flatten([l, s, p, {runs}, [t]]))) AS unit FROM parts),
    worded AS (SELECT r, unit, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
    sized AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
    hits AS (SELECT s.r, s.unit, k.licence, 2 * len(list_intersect(s.g, k.grams)) / (len(s.g) + len(k.grams))::DOUBLE AS dice
             FROM sized s JOIN known k ON len(s.g) BETWEEN k.low AND k.high),
    kept AS (SELECT * FROM hits WHERE dice >= {least}),
    best AS (SELECT r, max(dice) AS dice, count(DISTINCT unit) AS units FROM kept GROUP BY r),
    named AS (SELECT b.r, b.dice, b.units, min(k.licence) AS licence FROM best b JOIN kept k ON k.r = b.r AND k.dice = b.dice GROUP BY ALL)
    SELECT d.doc_id, n.licence, n.dice, coalesce(n.units, 0)::BIGINT AS units FROM texts d LEFT JOIN named n USING (r)
    """
