"""Licence scans over whole texts, native DataFrame operations only.

Method: a text's lines, its paragraphs (between blank lines) and the whole text are
normalised (lower case, runs of anything but letters and digits become one space) and
cut into word bigrams. A unit is compared with the templates whose size allows
THRESHOLD: with t the threshold, a template of b bigrams needs between t/(2-t)*b and
(2-t)/t*b of them in the unit. The best template by the Dice coefficient of the bigram
sets is the unit's licence, ties to the smaller name.

Notices inside a line or paragraph, or wrapped over several, are found by windows: a
match shares at least t/(2-t) of a template's bigrams, so it holds one of any larger
part of them. Those of such a part are the template's probes, and each place of the whole
text's words that has one is a window as long as the template, lying so that the probe
stands where the template has it. Windows that reach the threshold are taken by Dice
coefficient, the largest first (ties: the longer, then the smaller name, then the first);
each counts unless one taken before overlaps it. So every separate notice counts, however
many a text has of one template.

Before any of that, texts and units without a probe word are passed over, which loses
nothing for the same reason: more bigrams have a probe word than a match can lack.

All work is map-side and inside each row; nothing is joined, shuffled or collected.

Defined results: null text is empty and has no licence; units with fewer than two words
match nothing; equal units of a text count once, and a window that reads like a matching
unit is that unit, while one inside a longer matching unit is a match of its own; repeated
rows are scanned each; a null doc_id stays null; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
LONG_WORD = 5

# The usual notices of common licences, and the bodies of the short ones.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "boost-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsd-2-clause-body": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-3-clause-terms": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-body": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-body": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def probe_bigrams(text: str, threshold: float) -> list[tuple[str, int]]:
    """As many bigrams of a template as no match can miss, those with long words first, each with where the template first has it."""
    w = template_words(text)
    grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    distinct = sorted(set(grams), key=lambda g: (-max(map(len, g.split())), g))
    least = math.ceil(threshold / (2 - threshold) * len(distinct) - 1e-9)
    return [(g, grams.index(g)) for g in distinct[: len(distinct) - least + 1]]


def probes(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every match holds one: so many of each template's bigrams have one that a match can't do without them all.

    Chosen one by one: what serves the most bigrams still wanting, long words before short ones of the same use."""
    grams = {name: [g.split() for g in template_bigrams(text)] for name, text in templates.items()}
    wanting = {name: len(g) - math.ceil(threshold / (2 - threshold) * len(g) - 1e-9) + 1 for name, g in grams.items()}
    found: list[str] = []
    while any(n > 0 for n in wanting.values()):
        use: dict[str, int] = {}
        for name, pairs in grams.items():
            for w in {w for pair in pairs for w in pair} if wanting[name] > 0 else ():
                # rare words come before common ones, of which length is a sign; short ones only where nothing else is left
                use[w] = use.get(w, 0) + min(wanting[name], sum(w in pair for pair in pairs)) * (len(w) ** 2 if len(w) >= LONG_WORD else 1e-3)
        found.append(max(use, key=lambda w: (use[w], w)))
        for name, pairs in grams.items():
            wanting[name] -= sum(found[-1] in pair for pair in pairs)
            grams[name] = [pair for pair in pairs if found[-1] not in pair]
    # a word that holds another probe is found by it
    return sorted(w for w in found if not any(v != w and v in w and len(v) >= LONG_WORD for v in found))


def holds_probe(lowered: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds one of the words: long ones anywhere, short ones between other characters than a-z and 0-9."""
    found = F.exists(F.array(*[F.lit(w) for w in words if len(w) >= LONG_WORD]).cast("array<string>"), lambda p: F.contains(lowered, p))
    for w in words:
        if len(w) < LONG_WORD:
            found = found | lowered.rlike(f"{w}(?<![a-z0-9]{w})(?![a-z0-9])")
    return found


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches: (unit, license, dice) of every unit that reaches the threshold, for every row of ``docs``."""
    probe = probes(templates, threshold)
    table = F.array(*[F.struct(F.lit(k).alias("license"), F.split(F.lit("|".join(template_bigrams(v))), r"\|").alias("grams"), F.lit(len(template_bigrams(v))).alias("n")) for k, v in sorted(templates.items())])
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("text", F.lower("text"))
    d = d.withColumn("text", F.when(holds_probe(F.col("text"), probe), F.col("text")))
    units = F.concat(F.split("text", "\n", -1), F.split("text", r"\n[\x20\x09-\x0D]*\n", -1), F.array("text"))
    units = F.array_distinct(F.transform(F.filter(units, lambda u: holds_probe(u, probe)), normalised))

    def compared(unit: Column) -> Column:
        low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
        grams = unit["grams"]
        fits = F.filter(table, lambda t: (F.size(grams) >= t["n"] * low) & (F.size(grams) <= t["n"] * high))
        dice = lambda t: F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (F.size(grams) + t["n"])
        scored = F.transform(fits, lambda t: F.struct((-dice(t)).alias("minus"), t["license"].alias("license")))
        best = F.array_min(scored)  # the largest Dice, then the smallest name
        return F.struct(unit["unit"].alias("unit"), best["license"].alias("license"), (-best["minus"]).alias("dice"))

    cut = F.transform("units", lambda u: F.struct(u.alias("unit"), _bigrams(u).alias("grams")))
    words = F.split(normalised(F.col("text")), " ")
    d = d.select("doc_id", units.alias("units"), words.alias("words"))
    d = d.select("doc_id", F.when(F.size("units") > 0, cut).alias("cut"), F.when(F.size("units") > 0, F.col("words")).alias("words"))
    found = F.filter(F.transform("cut", compared), lambda m: m["dice"] >= threshold)
    none = F.array().cast("array<struct<unit:string,license:string,dice:double>>")
    d = d.select("doc_id", F.coalesce(found, none).alias("by_unit"), _windows(F.col("words"), templates, threshold).alias("by_window"))
    # a window that reads like a matching unit is that unit
    new = F.filter("by_window", lambda w: ~F.exists("by_unit", lambda u: u["unit"] == w["unit"]))
    return d.select("doc_id", F.concat("by_unit", F.coalesce(new, none)).alias("matches"))


def _windows(words: Column, templates: dict[str, str], threshold: float) -> Column:
    """(unit, license, dice) of the windows that match and don't overlap; null without words."""
    rows = [(gram, name, at, len(template_words(text))) for name, text in sorted(templates.items()) for gram, at in probe_bigrams(text, threshold)]
    # constants that are folded once
    column = lambda k: F.split(F.lit(";".join(str(r[k]) for r in rows)), ";")
    entries = F.arrays_zip(column(0).alias("gram"), column(1).alias("license"), column(2).cast("array<int>").alias("at"), column(3).cast("array<int>").alias("size"))
    grams_of = F.create_map(*[F.lit(x) if isinstance(x, str) else x for k, v in sorted(templates.items()) for x in (k, F.split(F.lit("|".join(template_bigrams(v))), r"\|"))])
    probes_ = F.split(F.lit(";".join(sorted({r[0] for r in rows}))), ";")

    def of_text(w: Column) -> Column:
        n = F.size(w)
        grams = F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        return F.get(F.transform(F.array(grams), lambda g: placed(w, g)), 0)

    def placed(w: Column, grams: Column) -> Column:
        found = F.array_intersect(grams, probes_)

        def starts(gram: Column) -> Column:
            of_gram = F.filter(entries, lambda e: e["gram"] == gram)
            places = F.filter(F.transform(grams, lambda g, i: F.when(g == gram, i)), lambda i: i.isNotNull())
            return F.flatten(F.transform(of_gram, lambda e: F.transform(places, lambda i: F.struct(e["license"].alias("license"), F.greatest(i - e["at"], F.lit(0)).alias("start"), e["size"].alias("size")))))

        def scored(x: Column) -> Column:
            own = F.array_distinct(F.slice(grams, x["start"] + 1, x["size"] - 1))
            theirs = F.element_at(grams_of, x["license"])
            dice = F.size(F.array_intersect(own, theirs)) * 2.0 / (F.size(own) + F.size(theirs))
            return F.struct(x["license"].alias("license"), (-dice).alias("minus"), x["start"].alias("start"), F.least(x["size"], F.size(w) - x["start"]).alias("size"))

        matches = F.filter(F.transform(F.array_distinct(F.flatten(F.transform(found, starts))), scored), lambda x: -x["minus"] >= threshold)
        return F.get(F.transform(F.array(F.array_sort(matches)), lambda m: apart(w, m)), 0)

    def apart(w: Column, matches: Column) -> Column:
        # sorted by Dice, size, licence and start, each stays unless one that stays already overlaps it
        ordered = F.array_sort(F.transform(matches, lambda x: F.struct(x["minus"].alias("minus"), (-x["size"]).alias("shorter"), x["license"].alias("license"), x["start"].alias("start"))))
        meets = lambda x: lambda y: (y["start"] < x["start"] - x["shorter"]) & (x["start"] < y["start"] - y["shorter"])
        none = F.array().cast("array<struct<minus:double,shorter:int,license:string,start:int>>")
        kept = F.aggregate(ordered, none, lambda kept, x: F.when(F.exists(kept, meets(x)), kept).otherwise(F.array_append(kept, x)))
        return F.transform(kept, lambda x: F.struct(F.array_join(F.slice(w, x["start"] + 1, -x["shorter"]), " ").alias("unit"), x["license"].alias("license"), (-x["minus"]).alias("dice")))

    return F.get(F.transform(F.array(words), lambda w: F.when(w.isNotNull(), of_text(w))), 0)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {len(template_words(v))}, [{', '.join(map(quoted, template_bigrams(v)))}])" for k, v in sorted(TEMPLATES.items()))
    probe_rows = ", ".join(f"({quoted(g)}, {quoted(k)}, {at}, {len(template_words(v))})" for k, v in sorted(TEMPLATES.items()) for g, at in probe_bigrams(v, THRESHOLD))
    return rf"""
WITH RECURSIVE templates(license, size, grams) AS (VALUES {rows}),
probes(gram, license, place, size) AS (VALUES {probe_rows}),
units AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS unit FROM (
    SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), [text])) AS unit FROM documents)),
words AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units),
grams AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, license, len(list_intersect(g.grams, t.grams)) * 2.0::DOUBLE / (len(g.grams) + len(t.grams)) AS dice
  FROM grams g JOIN templates t ON len(g.grams) BETWEEN len(t.grams) * 0.66 AND len(t.grams) * 1.51),
best AS (
  SELECT doc_id, unit, dice, license FROM scored WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1),
texts AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
bigrams AS (SELECT doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM texts WHERE len(w) > 1),
places AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS i FROM bigrams),
starts AS (SELECT DISTINCT doc_id, license, size, greatest(i - place, 0) AS start FROM places JOIN probes USING (gram)),
cut AS (SELECT doc_id, license, start, least(s.size, len(w) - start) AS size, list_distinct(g[start + 1:start + s.size - 1]) AS own, w FROM starts s JOIN bigrams USING (doc_id)),
rated AS (SELECT doc_id, c.license, c.start, c.size, c.w[c.start + 1:c.start + c.size] AS own_words,
            len(list_intersect(own, t.grams)) * 2.0::DOUBLE / (len(own) + len(t.grams)) AS dice FROM cut c JOIN templates t USING (license)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, size DESC, license, start) AS turn FROM rated WHERE dice >= {THRESHOLD}),
taken AS (
  SELECT doc_id, 1 AS turn, [{{'a': start, 'b': start + size}}] AS spans, true AS stays FROM ordered WHERE turn = 1
  UNION ALL SELECT o.doc_id, o.turn, CASE WHEN x.meets THEN t.spans ELSE list_append(t.spans, {{'a': o.start, 'b': o.start + o.size}}) END, NOT x.meets
  FROM taken t JOIN ordered o ON o.doc_id = t.doc_id AND o.turn = t.turn + 1,
    LATERAL (SELECT len(list_filter(t.spans, lambda y: y.a < o.start + o.size AND o.start < y.b)) > 0 AS meets) x),
apart AS (SELECT o.doc_id, array_to_string(own_words, ' ') AS unit, dice, license FROM taken t JOIN ordered o USING (doc_id, turn) WHERE stays),
matches AS (SELECT * FROM best UNION ALL SELECT * FROM apart a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = a.doc_id AND b.unit = a.unit))
SELECT d.doc_id, count(b.unit) AS n_matches, coalesce(string_agg(DISTINCT b.license, ',' ORDER BY b.license), '') AS licenses, coalesce(max(b.dice), 0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN matches b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""


ORACLE = _oracle()
