"""License recognition by sentences: known sentences become identifiers, and rules are ordered identifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences as they stand in license texts and notices; {} stands for nothing, all are normalised below.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-the": "Licensed under the Apache License, Version 2.0 (the License);",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl-notice-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under the CC0 License.",
    "unlicense": "This is free and unencumbered software released into the public domain without license.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-origin": "This software is provided as-is, without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "lgpl-free-21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-free-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mit-under": "This project is licensed under the MIT License.",
    "apache-under": "This project is licensed under the Apache License 2.0.",
}
# The license that follows when these sentences stand in this order, others between them or not.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("Apache-2.0", ["apache-notice-the", "apache-may-not", "apache-copy"]),
    ("Apache-2.0", ["apache-as-is", "apache-see"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("GPL-3.0", ["gpl-notice-3"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0", ["gpl-notice-2"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-origin", "zlib-grant"]),
    ("LGPL-2.1-or-later", ["lgpl-free-21"]),
    ("LGPL-3.0-or-later", ["lgpl-free-3"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("EPL-2.0", ["epl-notice"]),
    ("MIT", ["mit-under"]),
    ("Apache-2.0", ["apache-under"]),
]
NAMES = list(SENTENCES)
#: Every known sentence has one of these, so that a text without any needs no splitting.
ANCHORS = "licen[sc]|warrant|permi|redistribut|apache"
END = r"([.!?:;])\s+"


def norm(sentence: str) -> str:
    """Lower case, and anything but ASCII letters and digits as one blank."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, int]:
    return {norm(s): i + 1 for i, s in enumerate(SENTENCES.values())}


assert all(re.search(ANCHORS, s) for s in known())


def marked(text: Column) -> Column:
    """The normalised pieces of a text, with | before, between and after them.

    Pieces end at a line's end, or at one of .!?:; before white space; comment
    marks go like anything else but letters and digits.
    """
    cut = F.regexp_replace(F.translate(F.lower(text), "|", "-"), END + "|\n", "|")
    return F.regexp_replace(F.concat(F.lit("|"), F.regexp_replace(cut, "[^a-z0-9|]+", " "), F.lit("|")), r" ?\|[| ]*", "|")


def known_pattern() -> str:
    """Runs of whole pieces that make up a known sentence, wherever it is cut; the longest first."""
    return r"\|(?:" + "|".join(s.replace(" ", "[ |]") for s in sorted(known(), key=len, reverse=True)) + r")(?=\|)"


def occurrences(sentences: Column, ids: list[str]) -> Column:
    """How often the sentences of a rule stand in this order in an array of identifiers: a count of those met so far, over and over."""
    table = F.array(*(F.lit(NAMES.index(x) + 1) for x in ids))
    return F.floor(F.aggregate(sentences, F.lit(0), lambda met, x: met + F.when(F.element_at(table, met % len(ids) + 1) == x, 1).otherwise(0)) / len(ids))


def occurrences_sql(ids: list[str]) -> str:
    """The same of an array named ids."""
    table = [NAMES.index(x) + 1 for x in ids]
    return f"(list_reduce(list_prepend(0, ids), lambda met, x: met + CASE WHEN {table}[met % {len(ids)} + 1] = x THEN 1 ELSE 0 END) // {len(ids)})"


def covering(ids: list[str]) -> list[list[str]]:
    """The rules that have all sentences of a rule, in this order, and others."""

    def within(other: list[str]) -> bool:
        rest = iter(other)
        return len(other) > len(ids) and all(x in rest for x in ids)

    return [other for _, other in RULES if within(other)]


# The field that declares an expression of license identifiers, and the words that join them.
IDENTIFIER = r"[A-Za-z0-9]+(?:[.+-]+[A-Za-z0-9]+)*[+]?"
EXPRESSION = rf"SPDX-License-Identifier:[ \t]*((?:[(][ \t]*)*{IDENTIFIER}(?:[ \t]*[)])*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:[(][ \t]*)*{IDENTIFIER}(?:[ \t]*[)])*)*)"
EXCEPTION, JOINED = rf"WITH[ \t]+{IDENTIFIER}", "AND|OR"


def declared(text: Column) -> Column:
    """The identifiers of the expressions that a text declares; exceptions and the words between them are none."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), lambda e: F.regexp_replace(e, EXCEPTION, " "))
    ids = F.flatten(F.transform(parts, lambda e: F.regexp_extract_all(e, F.lit(IDENTIFIER), F.lit(0))))
    return F.filter(ids, lambda x: ~x.isin(*JOINED.split("|")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): n_sentences known, their ids in order, and the licenses whose rules match.

    A rule whose sentences all belong to a longer rule that matches as often
    doesn't count. The identifiers of SPDX expressions are licenses too,
    whatever they are. Null and empty texts, and texts without either, have 0
    and two empty strings. The tables of sentences and rules are fixed, so the
    map is a literal of the plan.
    """
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.transform(F.regexp_extract_all(marked(text), F.lit(known_pattern()), F.lit(0)), lambda s: F.element_at(table, F.trim(F.translate(s, "|", " "))))
    none = F.array().cast("array<string>")
    found = docs.select("doc_id", F.when(F.lower(text).rlike(ANCHORS), ids).otherwise(F.array().cast("array<int>")).alias("ids"), F.when(text.contains("SPDX-License-Identifier"), declared(text)).otherwise(none).alias("declared"))

    def hit(name: str, ids: list[str]) -> Column:
        times = occurrences(F.col("ids"), ids)
        alone = [times > occurrences(F.col("ids"), other) for other in covering(ids)]
        return F.when(reduce(Column.__and__, [times > 0, *alone]), F.lit(name))

    hits = F.when(F.size("ids") > 0, F.array_compact(F.array(*(hit(*rule) for rule in RULES)))).otherwise(none)
    licenses = F.array_join(F.array_sort(F.array_distinct(F.concat(hits, "declared"))), ",")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licenses.alias("licenses"))


def licenses_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(k)}, {v})" for k, v in known().items())
    hits = [f"CASE WHEN {' AND '.join([occurrences_sql(ids) + ' > 0', *(f'{occurrences_sql(ids)} > {occurrences_sql(other)}' for other in covering(ids))])} THEN {quote(name)} END" for name, ids in RULES]
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM
  (SELECT r, string_split_regex(regexp_replace(text, '([.!?:;])[ \\t\\n\\x0B\\f\\r]+', E'\\\\1\\n', 'g'), E'\\n+') AS p FROM d)),
hit AS (SELECT r, k, id FROM parts JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
seq AS (SELECT d.r, d.doc_id, any_value(d.text) AS text, count(id) AS n_sentences, coalesce(list(id ORDER BY k) FILTER (id IS NOT NULL), []) AS ids
  FROM d LEFT JOIN hit ON d.r = hit.r GROUP BY d.r, d.doc_id),
named AS (SELECT *, list_concat([{', '.join(hits)}], list_filter(flatten(list_transform(regexp_extract_all(text, {quote(EXPRESSION)}, 1), lambda e: regexp_extract_all(regexp_replace(e, {quote(EXCEPTION)}, ' ', 'g'), {quote(IDENTIFIER)}))), lambda x: x NOT IN ('AND', 'OR'))) AS all_names FROM seq)
SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(list_filter(all_names, lambda x: x IS NOT NULL))), ',') AS licenses FROM named"""
