"""Licence scan by canonical digests, in DataFrame operations only.

A text is normalised (letter case, punctuation, white space, copyright lines and equivalent
spellings), and the digest of the whole normalised text meets the digests of known licence texts in
a hash join.  So do its blocks, which blank lines part, since licences also stand inside files, and
its lines, as short notices are known texts of one line.  Digests are made only of parts as long as
a known one.  The known texts are a fixed table, far below any broadcast limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

# Licence texts and standard notices, and spellings that count as the same.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
SPDX = {"MIT": ["MIT"], "ISC": ["ISC"], "0BSD": ["0BSD"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "Apache-2.0": ["Apache-2.0"], "MPL-2.0": ["MPL-2.0"], "CC0-1.0": ["CC0-1.0"], "Unlicense": ["Unlicense"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"]} | {f"{name}-{v}": [f"{name}-{v}{end}" for end in ("", "+", "-only", "-or-later")] for name, vs in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",))) for v in vs}
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_END),
    ("BSD-3-Clause", _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tags in SPDX.items() for tag in tags],
]
#: Lengths and digests of normalised whole texts of longer licences (see ``normalised`` and ``whole``).
KNOWN_DIGESTS = [
    ("Apache-2.0", 9705, "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("Artistic-1.0-Perl", 5683, "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19515, "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", 21884, "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17053, "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", 33277, "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0", 23937, "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", 25024, "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14272, "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]
SPELLINGS = [("licence", "license"), ("behaviour", "behavior"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("sub license", "sublicense"), ("copyright owner", "copyright holder")]
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


#: What parts blocks.
BLANK_LINES = r"\n[ \n]*\n"


def normalised(text: Column) -> Column:
    """Lower case, no copyright lines, one blank for each run of anything but letters, digits and line ends, one spelling."""
    text = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return text


def whole(normal: Column) -> Column:
    return F.trim(F.regexp_replace(normal, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]], digests: list[tuple[str, int, str]]) -> DataFrame:
    """(digest, length, part, parts, license): whole known texts (part and parts 0), and the paragraphs of those of several lines, from 1 on."""
    rows = spark.createDataFrame(known, "license string, text string").select("license", normalised(F.col("text")).alias("normal"), F.xxhash64("text").alias("of"))
    parts = F.posexplode(F.concat(F.array(whole(F.col("normal"))), F.transform(F.split("normal", "\n"), lambda line: F.trim(line))))
    rows = rows.select("license", "of", parts.alias("part", "body")).filter("body <> ''")
    rows = rows.join(rows.filter("part > 0").groupBy("of").agg(F.count(F.lit(1)).alias("parts")), "of").filter("part = 0 OR parts > 1")
    rows = rows.withColumn("parts", F.when(F.col("part") > 0, F.col("parts")).otherwise(0)).withColumn("own", F.when(F.col("part") > 0, F.col("license")))
    rows = rows.groupBy(F.sha2("body", 256).alias("digest"), F.char_length("body").alias("length"), "part", "parts", "own").agg(F.min("license").alias("license")).drop("own")
    if digests:
        more = spark.createDataFrame(digests, "license string, length int, digest string").selectExpr("digest", "length", "0 AS part", "0L AS parts", "license")
        rows = rows.unionByName(more)
    return rows


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, int, str]] = KNOWN_DIGESTS) -> DataFrame:
    """A row for each document, license and scope found: doc_id, license, scope, matches.

    ``scope`` is ``text`` where the whole text is a known one, ``block`` where one of its blocks of
    several lines is, or where its blocks hold all paragraphs of a known text, and ``line`` for its
    single lines; ``matches`` counts them.  Null and empty texts, and parts without letters or
    digits, match nothing.  Repeated ids add up; a null id is an id like any other; other columns
    are ignored; an empty table gives no rows.
    """
    table_ = known_digests(docs.sparkSession, known, digests)
    lengths = [r["length"] for r in table_.select("length").distinct().collect()]  # as many as known texts at most
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("normal"))
    part = lambda scope, body, several: F.struct(F.lit(scope).alias("scope"), body.alias("body"), several.alias("several"))
    blocks = F.transform(F.split("normal", BLANK_LINES), lambda b: part("block", whole(b), F.contains(b, F.lit("\n"))))
    lines = F.transform(F.split("normal", "\n"), lambda line: part("line", F.trim(line), F.lit(False)))
    parts = normal.select("doc_id", F.explode(F.concat(F.array(part("text", whole(F.col("normal")), F.lit(False))), blocks, lines)).alias("p")).select("doc_id", "p.*")
    found = parts.filter(F.char_length("body").isin(lengths)).withColumn("digest", F.sha2("body", 256)).join(F.broadcast(table_), "digest")
    found = found.filter("scope <> 'block' AND part = 0 OR scope = 'block' AND (several OR part > 0)")
    counted = found.groupBy("doc_id", "license", "scope", "parts", "part").agg(F.count(F.lit(1)).alias("n"))
    # Of a known text's paragraphs all must be there; it is there as often as the rarest of them.
    held = counted.groupBy("doc_id", "license", "scope", "parts").agg(F.when(F.col("parts") == 0, F.sum("n")).when(F.count(F.lit(1)) == F.col("parts"), F.min("n")).alias("n")).filter("n IS NOT NULL")
    n = lambda which: F.coalesce(F.max(F.when(which, F.col("n"))), F.lit(0))
    return held.groupBy("doc_id", "license", "scope").agg((n(F.col("parts") == 0) + n(F.col("parts") > 0)).alias("matches"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}


def _sql_normal(text: str) -> str:
    text = f"regexp_replace(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{COPYRIGHT_LINE}', '', 'g')"
    text = rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for other, usual in SPELLINGS:
        text = f"replace({text}, '{other}', '{usual}')"
    return text


_QUOTED = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(KNOWN))
_DIGESTS = ", ".join(f"('{digest}', 0, 0, '{name}')" for name, _, digest in KNOWN_DIGESTS)
_WHOLE = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"

ORACLE_SQL = {
    "op9_license_scan": f"""
        WITH v AS (SELECT of, license, {_sql_normal("text")} AS normal FROM (VALUES {_QUOTED}) v(of, license, text)),
             l AS (SELECT of, license, trim(unnest(string_split(normal, chr(10)))) AS body, unnest(range(1, len(string_split(normal, chr(10))) + 1)) AS part FROM v),
             c AS (SELECT of, count(*) AS parts FROM l WHERE body <> '' GROUP BY of HAVING count(*) > 1),
             k AS (SELECT sha256({_WHOLE.format("normal")}) AS digest, 0 AS part, 0 AS parts, min(license) AS license FROM v GROUP BY digest
                   UNION ALL SELECT DISTINCT sha256(body), part, parts, license FROM l JOIN c USING (of) WHERE body <> ''
                   UNION ALL SELECT * FROM (VALUES {_DIGESTS}) d(digest, part, parts, license)),
             n AS (SELECT doc_id, {_sql_normal("text")} AS normal FROM documents),
             b AS (SELECT doc_id, unnest(string_split_regex(normal, '{BLANK_LINES}')) AS block FROM n),
             p AS (SELECT doc_id, 'text' AS scope, {_WHOLE.format("normal")} AS body, false AS several FROM n
                   UNION ALL SELECT doc_id, 'block', {_WHOLE.format("block")}, contains(block, chr(10)) FROM b
                   UNION ALL SELECT doc_id, 'line', trim(unnest(string_split(normal, chr(10)))), false FROM n),
             f AS (SELECT doc_id, license, scope, parts, part, count(*) AS n FROM p JOIN k ON sha256(body) = digest
                   WHERE (scope <> 'block' AND part = 0) OR (scope = 'block' AND (several OR part > 0)) GROUP BY ALL),
             h AS (SELECT doc_id, license, scope, parts, CASE WHEN parts = 0 THEN sum(n) WHEN count(*) = parts THEN min(n) END AS n FROM f GROUP BY doc_id, license, scope, parts)
        SELECT doc_id, license, scope, (coalesce(max(CASE WHEN parts = 0 THEN n END), 0) + coalesce(max(CASE WHEN parts > 0 THEN n END), 0))::BIGINT AS matches
        FROM h WHERE n IS NOT NULL GROUP BY doc_id, license, scope"""
}
