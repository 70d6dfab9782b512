import struct
import math
import base64
import hashlib
import io
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, licenses, warc

PAGES = [
    (3, "http://b.example/x?q=1", "<p>same</p>"),
    (1, "http://a.example/", "<p>same</p>"),
    (2, "https://www.a.example:8080/é path", None),
    (5, None, ""),
    (None, "http://z.example", "<p>same</p>"),
    (7, "http://a.example/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\r\n" * 3),
    (8, "not a url\r\nX: y", "é" * 70_000),
    (1, "http://a.example/", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        PAGES, "page_id long, url string, html string"
    ).withColumn("payload_bytes", F.lit("clash")).repartition(3)


@pytest.mark.parametrize("least", [0, 1, 10**9])
def test_archives(pages, least):
    rows = warc.archived(pages, least_bytes=least).collect()
    owner = {}
    for page, _, html in PAGES:
        if page is not None:
            owner[html or ""] = min(page, owner.get(html or "", page))
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        response = len(data) < least or page == owner.get(html or "", page)
        want[
            (
                page,
                len(data),
                base64.b32encode(hashlib.sha1(data).digest()).decode(),
                "response" if response else "revisit",
                None if response else owner[html or ""],
            )
        ] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert len({(r["archive"], r["record_offset"]) for r in rows}) == len(PAGES)


def test_history_is_in_order(pages):
    rows = warc.archived(pages).withColumn("part", F.spark_partition_id()).collect()
    assert [
        warc._order(tuple(r)) for r in sorted(rows, key=lambda r: r["part"])
    ] == sorted(warc._order(tuple(r)) for r in rows)
    assert warc.archived(pages.where("false")).count() == 0


def test_small_archives_and_members(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, f"http://h{i % 5}.example/", "x" * i) for i in range(50)], "page_id long, url string, html string"
    ).coalesce(1)
    manifest = warc.write(rows, f"file://{tmp_path}/w", archive_bytes=1000)
    assert manifest.count() > 3 and warc.read(manifest).count() == 50
    packed = b"".join(
        (c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(x) + c.flush() for x in (b"one", b"", b"three" * 9999)
    )
    assert [x for _, _, x in warc.members(io.BytesIO(packed), 7)] == [b"one", b"", b"three" * 9999]
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(packed[:-9])))


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [
            sorted(
                (
                    (None,) * 5 + (
                        f"k{rnd.randrange(20)}", "t", str(i), rnd.randrange(9), 0
                    ) for _ in range(rnd.randint(1, 20))
                ),
                key=warc._order,
            ) for i in range(k)
        ]
        got = list(warc.merged(runs))
        assert [warc._order(r) for r in got] == sorted(warc._order(r) for run in runs for r in run)


def likeness(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (a, b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for i in range(0, 400, 3)] + [
        (500, None), (501, ""), (502, "ü 日本" * 5), (503, "😀 b"), (10**12, "same text"), (-5, "same text")
    ]
    got = {
        r["doc_id"]: r for r in fingerprints.fingerprint(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        ).collect()
    }
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    error = bias = 0
    for i, (k, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == sum(a == b for a, b in zip(re.findall("....", r["fingerprint"]), re.findall("....", got[ordered[(i + 1) % len(ordered)][0]]["fingerprint"]), strict=True)) / fingerprints.SAMPLES
        bias += r["near_edited"] - likeness(t, edited)
        error += (r["near_edited"] - likeness(t, edited)) ** 2
    assert abs(bias / len(rows)) < 0.03 and (error / len(rows)) ** 0.5 < 0.11
    assert got[10**12]["fingerprint"] == got[-5]["fingerprint"] and got[500]["fingerprint"] == got[501]["fingerprint"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sample(words, i):
    """Sample i of a bag of words, from plain loops; None without words."""

    def uniform(h, shift, bits):
        return (((h >> shift) & ((1 << bits) - 1)) + 0.5) / (1 << bits)

    least = None
    for word, n in words.items():
        term = struct.pack("<q", signed(xxhash.xxh64(word.encode(), seed=42).intdigest()))
        x, y = (
            xxhash.xxh64(
                struct.pack("<i", 2 * i + k + fingerprints.SEED), seed=xxhash.xxh64(term, seed=42).intdigest()
            ).intdigest() for k in (0, 1)
        )
        r = -math.log(uniform(x, 0, 32) * uniform(x, 32, 32))
        log_c, b = math.log(-math.log(uniform(y, 0, 22) * uniform(y, 22, 21))), uniform(y, 43, 21)
        value = log_c - r * (math.floor(math.log(n) / r + b) - b + 1)
        least = value if least is None or value < least else least
    return None if least is None else xxhash.xxh64(struct.pack("<d", least), seed=42).intdigest() & 0x7FFF


def test_samples_against_loops(spark):
    """Every sample of every text, worked out anew. Logarithms of the two libraries differ in the last bit now and then, and so does the hash of a value then: that explains one in twenty."""
    rnd = random.Random(6)
    rows = [
        (i, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(0, 60)))) for i in range(40)
    ] + [(100, "é 日本 é"), (101, None)]
    total = same = 0
    for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r["doc_id"]] or ""))
        for i, got in enumerate(re.findall("....", r["fingerprint"])):
            want = sample(words, i)
            total += 1
            same += got == ("ffff" if want is None else f"{want:04x}")
    assert total == len(rows) * fingerprints.SAMPLES and same >= 0.92 * total


def test_many_rows_of_one_id_and_few_ranges(spark, monkeypatch):
    """Repeated and missing ids are told apart by the text's hash, also over bucket ends."""
    monkeypatch.setattr(fingerprints, "RANGES", 4)
    rows = [(None, f"text {i}") for i in range(150)] + [(7, f"seven {i}") for i in range(150)] + [
        (i, f"own {i}") for i in range(0, 4000, 40)
    ] + [
        (-(1 << 63), "least"), ((1 << 63) - 1, "most")
    ]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)

    def digest(text, following):
        cut = len(text) // 3
        return hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()

    def order(row):
        return -(row[0] if row[0] is not None else -(1 << 63)), signed(
            xxhash.xxh64(row[1].encode(), seed=42).intdigest()
        )

    ordered = sorted(rows, key=order)
    want = Counter((k, digest(t, ordered[(i + 1) % len(ordered)][1])) for i, (k, t) in enumerate(ordered))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_fingerprints_are_close_to_the_likeness(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    have = dict(rows)
    off = []
    for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        t, following = have[r["doc_id"]], have[(r["doc_id"] - 1) % len(rows)]
        cut = len(t) // 3
        off.append(r["near_edited"] - likeness(t, t[: len(t) - cut] + following[:cut]))
    # the binomial error of 64 samples at a likeness of 0.5 is 0.0625, that of 48 samples 0.072
    assert abs(sum(off) / len(off)) < 0.03 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.082


def test_fingerprints_of_repeated_null_and_single_rows(docs, spark):
    assert fingerprints.fingerprint(docs).count() == docs.count()
    assert fingerprints.fingerprint(docs.where("false")).count() == 0
    one = fingerprints.fingerprint(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()


APACHE = "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at"


def test_licenses(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "All rights reserved."),
        (4, "x. Released  under the\tMIT license! All Rights Reserved"),
        (5, APACHE),
        (6, "this program is free software; either version 2 of the license, or (at your option) any later version"),
        (3, "All rights reserved."),
    ]
    got = [
        (r["doc_id"], r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in licenses.scan(
            spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("clash"))
        ).collect()
    ]
    assert (3, 1, "20", "all-rights-reserved") in got and got.count((3, 1, "20", "all-rights-reserved")) == 2
    assert (4, 3, "7,20", "MIT,all-rights-reserved") in got and (1, 0, "", "") in got and (2, 0, "", "") in got
    assert next(g for g in got if g[0] == 6)[2:] == ("13,15", "")


APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
STANDARD = {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT": "Released under the MIT License.",
    "MIT,all-rights-reserved": "Licensed under the MIT License. All rights reserved.",
    "GPL-3.0": "This work is licensed under the GNU General Public License version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC-BY-SA 4.0.",
    "CC0-1.0": "This software is released under CC0 1.0.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software must be included.',
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/. More.",
}
STANDARD[
    "BSD-3-Clause"
] = STANDARD[
    "BSD-2-Clause"
] + " 3. Neither the name of the Example Group nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_standard_texts_have_their_licenses_however_wrapped(spark):
    rows = [(f"{name}|{width}|{mark}", "Some code.\n\n" + "\n".join(mark + x for x in textwrap.wrap(text, width, break_on_hyphens=False)) + "\n\nThe end") for name, text in STANDARD.items() for width, mark in ((10**6, ""), (72, ""), (40, ""), (25, ""), (60, " * "))]
    rows += [
        ("|not", "This is not licensed under the MIT license."),
        ("LGPL-3.0-or-later|", STANDARD["GPL-3.0-or-later"].replace("GNU General", "GNU Lesser General")),
    ]
    rows += [
        ("MIT,all-rights-reserved|lines", "All rights reserved\nReleased under the MIT license\nthe end"),
        ("|part", STANDARD["MIT-text"].partition(" The above")[0]),
    ]
    rows += [
        ("Apache-2.0-header|as published", "/*\n * Copyright\n *\n * " + APACHE_HEADER.replace("\n", "\n * ") + "\n */")
    ]
    rows += [
        (
            "GPL-3.0|title",
            "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
        )
    ]
    rows += [
        (
            "Apache-2.0-text|title",
            "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
        )
    ]
    got = {
        r["doc_id"]: r["licenses"] for r in licenses.scan(
            spark.createDataFrame(rows, "doc_id string, text string")
        ).collect()
    }
    assert {k: v for k, v in got.items() if v != k.split("|")[0]} == {}


def test_licenses_are_their_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001/documents.parquet"
    more = [(10**6 + i, "\n".join(textwrap.wrap(t, 50, break_on_hyphens=False)) + e) for i, t in enumerate(STANDARD.values()) for e in ("", "\n\nAll rights reserved\nx")]
    more = [(10 * i, t) for i, (_, t) in enumerate(more, 10**6)] + [(5, None), (6, ""), (7, "a;  b:\n\n. c\r\n\r\nd")]
    docs = spark.read.parquet(sf).select("doc_id", "text").where("doc_id > 7").union(
        spark.createDataFrame(more, "doc_id long, text string")
    )
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    rel = con.sql(licenses.oracle_sql())
    got = licenses.scan(spark.read.parquet(str(tmp_path / "d"))).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_licenses_with_clashing_names(spark):
    rows = [(1, "All rights reserved", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, cut int, State int")
    got = licenses.scan(docs)
    assert got.columns == [
        *docs.columns, "n_sentences", "sentence_ids", "licenses"
    ] and got.first()["licenses"] == "all-rights-reserved"
    assert licenses.scan(docs.where("false")).count() == 0
