"""License scans: sentences are known by their normalised form, and rules are sequences of known sentences.

A text is cut into sentences at blank lines, at addresses, and after . ! ? ; or : before white space, so a sentence may
run over line ends. A sentence's normal form is lower case with every run of other characters than a-z and 0-9 as one space, without
a number at its start; comment marks and quotes fall away with it. Known sentences become identifiers. Where a sentence
over several lines isn't known, its lines are looked up one by one, as notices often stand on a line without a full stop.
Rules are tried in order, from the longest: one matches where its identifiers follow each other among the document's
identifiers (unknown sentences in between don't count), and what a rule has matched is used up. Everything is one narrow
projection: no shuffle, no Python.

Null and empty texts have no sentences. Repeated rows get equal results. Very long texts only have more sentences.
Input columns named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

# Sentences of public licences and notices, and the rules over them. Some sentences are in use in several
# forms, which have one identifier.
SENTENCES: dict[int, str | tuple[str, ...]] = {
    1: (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License 2.0",
        "Released under the Apache License, Version 2.0",
    ),
    2: "you may not use this file except in compliance with the License",
    3: "You may obtain a copy of the License at",
    4: (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    ),
    5: "See the License for the specific language governing permissions and limitations under the License",
    6: (
        'Licensed under the Apache License, Version 2.0 (the "License")',
        'This file is licensed to you under the Apache License, Version 2.0 (the "License")',
    ),
    7: (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "Distributed under the MIT License",
    ),
    9: (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    10: (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ),
    11: (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    ),
    12: (
        "This work is licensed under the GNU General Public License version 3",
        "Licensed under the GNU General Public License version 3",
        "Licensed under the GPL-3.0",
    ),
    13: "This program is free software",
    14: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    15: "either version 2 of the License, or (at your option) any later version",
    16: "either version 3 of the License, or (at your option) any later version",
    17: (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    18: (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    19: (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    20: "All rights reserved",
    21: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    22: (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer",
    ),
    23: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    24: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    25: (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    ),
    26: "This is free and unencumbered software released into the public domain",
    27: (
        "This software is released under CC0 1.0",
        "Released under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    28: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    29: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    30: "This library is free software",
    31: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    32: "either version 2.1 of the License, or (at your option) any later version",
    33: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    34: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    35: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    36: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    37: "This software is provided 'as-is', without any express or implied warranty",
    38: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    39: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    40: (
        "Distributed under the Boost Software License, Version 1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ),
    41: "Apache License Version 2.0, January 2004",
    42: "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    43: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    44: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    45: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    46: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    47: ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    48: (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    49: 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',
    50: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    51: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    53: "SPDX-License-Identifier: MIT",
    54: "SPDX-License-Identifier: Apache-2.0",
    55: "The origin of this software must not be misrepresented",
    56: "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    57: "This notice may not be removed or altered from any source distribution",
}
RULES = [
    ("BSD-3-Clause", (21, 22, 23, 24)),
    ("BSD-2-Clause", (21, 22, 23)),
    ("MIT-text", (9, 10, 11)),
    ("Apache-2.0-header", (6, 2, 3, 4, 5)),
    ("Apache-2.0-header", (6, 2, 3)),
    ("Apache-2.0-header", (1, 2, 3)),
    ("Apache-2.0-header", (6, 2)),
    ("Apache-2.0-header", (1, 2)),
    ("Apache-2.0-text", (41, 42)),
    ("Apache-2.0", (6,)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (54,)),
    ("MIT", (7,)),
    ("MIT", (53,)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("GPL-2.0-or-later", (13, 29)),
    ("GPL-3.0-or-later", (13, 14, 16)),
    ("GPL-3.0-or-later", (13, 28)),
    ("LGPL-2.1-or-later", (30, 31, 32)),
    ("LGPL-2.1-or-later", (13, 31, 32)),
    ("LGPL-3.0-or-later", (13, 33)),
    ("LGPL-3.0-or-later", (30, 33)),
    ("LGPL-3.0-or-later", (13, 31, 16)),
    ("AGPL-3.0-or-later", (13, 34)),
    ("GPL-3.0", (12,)),
    ("GPL-3.0", (43,)),
    ("GPL-2.0", (44,)),
    ("LGPL-3.0", (45,)),
    ("LGPL-2.1", (50,)),
    ("AGPL-3.0", (46,)),
    ("CC-BY-NC-4.0", (17,)),
    ("CC-BY-4.0", (18,)),
    ("CC-BY-SA-4.0", (19,)),
    ("MPL-2.0", (25,)),
    ("MPL-2.0", (47,)),
    ("EPL-2.0", (48, 49)),
    ("EPL-2.0", (48,)),
    ("ISC", (35, 11)),
    ("ISC", (35,)),
    ("ISC", (36,)),
    ("Zlib", (37, 38, 55, 56, 57)),
    ("Zlib", (37, 38)),
    ("BSL-1.0", (39,)),
    ("BSL-1.0", (40,)),
    ("Unlicense", (26, 51)),
    ("Unlicense", (26,)),
    ("CC0-1.0", (27,)),
    ("all-rights-reserved", (20,)),
]
#: A sentence that names a holder is known without the name, up to this many characters of it.
HOLDER = "neither the name of .{1,120} nor the names of (its|their) contributors"
NO_HOLDER = "neither the name of nor the names of its contributors"
RESULTS = ["n_sentences", "sentence_ids", "licenses"]


def normal_form(sentence: str) -> str:
    """The normal form of a sentence of the table."""
    found = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    return re.sub(HOLDER, NO_HOLDER, re.sub("^[0-9]+ ", "", found))


def known_forms(sentences: dict) -> dict[str, int]:
    return {normal_form(v): i for i, s in sentences.items() for v in ((s,) if isinstance(s, str) else s)}


def _normal(text: Column) -> Column:
    found = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), "^[0-9]+ ", "")
    return F.when(found.startswith("neither the name of "), F.regexp_replace(found, HOLDER, NO_HOLDER)).otherwise(found)


def _cut(text: Column) -> Column:
    """The sentences of a text as they stand, with the line ends in them."""
    marked = F.regexp_replace(text, "([.!?;:])[ \\t\\r\\n]+", "$1\u0001")
    return F.split(F.regexp_replace(marked, "\\n[ \\t\\r]*\\n|https?://", "\u0001"), "\u0001")


def scan(
    docs: DataFrame,
    *,
    text_col: str = "text",
    sentences: dict | None = None,
    rules: list[tuple[str, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """docs with n_sentences, sentence_ids (known ones in order, by commas) and licenses (matched rules' names, by commas)."""
    forms, rules = known_forms(sentences or SENTENCES), rules or RULES
    known = F.create_map(*[F.lit(x) for s, i in forms.items() for x in (s, i)])
    # the table is a short fixed list, so most sentences are told apart by their length alone
    ends = sorted({len(s) for s in forms})

    def identifier(form: Column) -> Column:
        return F.when(F.length(form).isin(ends), F.try_element_at(known, form))

    def identifiers(sentence: Column) -> Column:
        whole = identifier(sentence["form"])
        lines = F.when(
            sentence["raw"].contains("\n"),
            F.transform(F.split(sentence["raw"], "\n"), lambda x: identifier(_normal(x))),
        )
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    own = [c for c in docs.columns if c.lower() not in RESULTS]
    cut = F.transform(
        _cut(_shared.text_or_empty(text_col)), lambda x: F.struct(x.alias("raw"), _normal(x).alias("form"))
    )
    cut = F.filter(cut, lambda x: x["form"] != "")
    rows = docs.select(F.struct(*own).alias("row"), cut.alias("cut"))
    found = F.array_compact(F.flatten(F.filter(F.transform("cut", identifiers), lambda x: x.isNotNull())))
    rows = rows.select("row", F.size("cut").cast("long").alias("n"), found.cast("array<string>").alias("ids"))
    state = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    for name, rule in rules:
        state = F.replace(state, F.lit("".join(f"<{i}>" for i in rule)), F.lit(f"{{{name}}}"))
    rows = rows.select(
        "row",
        "n",
        F.array_join("ids", ",").alias("listed"),
        F.when(F.size("ids") > 0, state).otherwise("").alias("state"),
    )
    names = [
        F.when(F.col("state").contains(f"{{{name}}}"), F.lit(name)) for name in dict.fromkeys(name for name, _ in rules)
    ]
    licenses = F.when(F.col("state") != "", F.array_join(F.array_compact(F.array(*names)), ",")).otherwise("")
    return rows.select(
        "row.*", F.col("n").alias("n_sentences"), F.col("listed").alias("sentence_ids"), licenses.alias("licenses")
    )


def oracle_sql() -> str:
    """The scan of documents in DuckDB's SQL."""
    known = ", ".join(f"('{s}', {i})" for s, i in known_forms(SENTENCES).items())
    names = list(dict.fromkeys(name for name, _ in RULES))
    state = "coalesce(marks, '')"
    for name, rule in RULES:
        state = f"replace({state}, '{''.join(f'<{i}>' for i in rule)}', '{{{name}}}')"
    found = ", ".join(f"CASE WHEN contains(state, '{{{n}}}') THEN '{n}' END" for n in names)
    normal = "regexp_replace(regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '^[0-9]+ ', ''), '" + HOLDER + "', '" + NO_HOLDER + "', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (
  SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\r]*\\n|https?://', chr(1), 'g'), chr(1)) AS s
    FROM documents)),
forms AS (SELECT doc_id, pos, raw, {normal.replace("{x}", "raw")} AS form FROM cut),
whole AS (SELECT doc_id, pos, raw, form, id FROM forms LEFT JOIN known ON form = sentence WHERE form <> ''),
lines AS (
  SELECT doc_id, pos, unnest(l) AS line, generate_subscripts(l, 1) AS nth
  FROM (SELECT doc_id, pos, string_split(raw, chr(10)) AS l FROM whole WHERE id IS NULL AND contains(raw, chr(10)))),
ids AS (
  SELECT doc_id, pos, 0 AS nth, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, pos, nth, known.id FROM lines JOIN known ON {normal.replace("{x}", "line")} = sentence),
listed AS (
  SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos, nth) AS ids, string_agg('<' || id || '>', '' ORDER BY pos, nth) AS marks
  FROM ids GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM whole GROUP BY doc_id),
matched AS (
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, {state} AS state
  FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ',') AS licenses FROM matched"""
