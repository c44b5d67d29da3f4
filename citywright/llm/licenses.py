"""Licence scan by canonical digests, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence notices as published, by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

# Identifiers of tag lines, and the names under which the notices above report some of them.
TAGS = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
FAMILIES = {"GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0"}

# Whole short licences as published, with the titles they are given.
WHOLE_TEXTS = [
    ("MIT", ["The MIT License (MIT)", "The MIT License", "MIT License"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", ["ISC License", "The ISC License"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", ["The Unlicense"], "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("Zlib", ["zlib License"], "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", [], "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

#: Texts that are looked up: a whole licence with each of its titles or none, and with or without what stands below a copyright line.
# A tag line names the licence by its identifier; families that the notices know by one name keep it.
KNOWN_TEXTS = NOTICES + [(FAMILIES.get(name, name), f"SPDX-License-Identifier: {name}") for name in TAGS] + [(name, f"{title} {rights} {body}".strip()) for name, titles, body in WHOLE_TEXTS for title in ["", *titles] for rights in ("", "All rights reserved.")]

# Spellings that licence texts use for the same word, and the one kept.
SAME_WORDS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("centre", "center"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("v 2 0", "version 2 0"), ("https", "http")]

#: Lines that name holders, not terms.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(copyright|©|\(c\))[^\p{L}\p{N}\n]*(\(c\)[^\p{L}\p{N}\n]*)?[0-9][^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Digests of known texts are broadcast up to this many bytes; a longer list is joined by shuffling.
MOST_BROADCAST = 16 << 20


def plain(text: Column) -> Column:
    """Lower case, no copyright lines, one blank for all that is not a letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "(?imd)" + COPYRIGHT_LINE, " ")), NOT_WORD, " "))


def one_spelling(plain_text: Column) -> Column:
    """A plain text with one spelling of each word."""
    # every word gets blanks of its own, so that plain replacement finds whole words only
    out = F.concat(F.lit(" "), F.replace(plain_text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SAME_WORDS:
        out = F.replace(out, F.lit(_apart(a)), F.lit(_apart(b)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """What two texts of one licence have in common."""
    return one_spelling(plain(text))


def _apart(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def digest(text: Column) -> Column:
    """The canonical text's SHA-256; null where no letter or digit is left."""
    c = canonical(text)
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of licence texts, one file each; the file's name without its ending names the licence."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.(txt|md)$", "").alias("license"), F.col("value").alias("text"))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license, length) of known texts, one row for each digest; the first licence by name where two share one."""
    named = known.select(digest(F.col("text")).alias("digest"), "license", F.length(canonical(F.col("text"))).alias("length"))
    return named.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"), F.max("length").alias("length"))


def longest_plain(longest_canonical: int) -> int:
    """The greatest length of a plain text that has a canonical text of ``longest_canonical``.

    A word with its blank shrinks by its replacement's ratio at most, and at worst by those of all replacements in turn.
    """
    shrunk = 1.0
    for a, b in SAME_WORDS:
        shrunk *= min(1.0, (len(b) + 1) / (len(a) + 1))
    return int((longest_canonical + 1) / shrunk) + 1


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_license, licenses, n_license_lines) for each row of ``docs``.

    text_license is the licence whose known text the entire document is; licenses are those whose text is
    the entire document or an entire line of it, sorted and joined by commas ('' if none); n_license_lines
    counts such lines (long). "Is" means an equal digest after canonicalisation, so case, punctuation, copyright
    lines and equivalent spellings do not matter. ``known`` are pairs or a table (license, text), ``read_known``'s for example.
    Null and empty texts match nothing; of licences that share a text, the first by name is found. Repeated rows get a row each;
    other columns are ignored.
    """
    if not isinstance(known, DataFrame):
        known = docs.sparkSession.createDataFrame(known or KNOWN_TEXTS, "license string, text string")
    digests = known_digests(known)
    size = digests.agg(F.max("length").alias("longest"), F.sum(F.length("digest") + F.length("license")).alias("bytes")).first()
    # a plain text beyond this length cannot have a known one's digest
    longest = longest_plain(size["longest"] or 0)
    table = digests.select("digest", "license")
    table = F.broadcast(table) if (size["bytes"] or 0) <= MOST_BROADCAST else table
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).select("doc_id", F.md5("text").alias("blob"), F.transform(F.split("text", "\n"), plain).alias("lines"))
    # line -1 is the entire text: its lines put together again
    whole = F.struct(F.lit(-1).alias("at"), F.array_join(F.filter("lines", lambda x: x != ""), " ").alias("plain"))
    units = F.concat(F.array(whole), F.transform("lines", lambda x, k: F.struct(k.alias("at"), x.alias("plain"))))
    spread = rows.select("doc_id", "blob", F.explode(F.filter(units, lambda u: F.length(u["plain"]).between(1, longest))).alias("u"))
    spelled = spread.select("doc_id", "blob", "u.at", F.sha2(one_spelling(F.col("u.plain")), 256).alias("digest"))
    # repeated rows find the same lines again: one of each stays. What is grouped here are hits, not lines
    hits = spelled.join(table, "digest").select("doc_id", "blob", "at", "license").distinct()
    found = hits.groupBy("doc_id", "blob").agg(
        F.max(F.when(F.col("at") < 0, F.col("license"))).alias("text_license"),
        F.array_sort(F.collect_set("license")).alias("found"),
        F.count(F.when(F.col("at") >= 0, 1)).alias("n"),
    )
    paths = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.md5(text).alias("blob"))
    both = paths.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (paths["blob"] == found["blob"]), "left")
    return both.select("doc_id", "text_license", F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(expr: str) -> str:
    """``canonical`` as DuckDB SQL."""
    out = f"' ' || replace(trim(regexp_replace(lower(regexp_replace({expr}, {_quoted('(?im)' + COPYRIGHT_LINE)}, ' ', 'g')), {_quoted(NOT_WORD)}, ' ', 'g')), ' ', '  ') || ' '"
    for a, b in SAME_WORDS:
        out = f"replace({out}, {_quoted(_apart(a))}, {_quoted(_apart(b))})"
    return f"trim(replace({out}, '  ', ' '))"


def oracle_sql() -> str:
    """``scan_licenses`` over ``documents`` with the built-in texts, as DuckDB SQL."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN_TEXTS)
    return f"""
WITH known AS (SELECT canon, min(license) AS license FROM (SELECT license, {canonical_sql('t')} AS canon FROM (VALUES {known}) AS v(license, t)) WHERE canon <> '' GROUP BY canon),
whole AS (SELECT d.doc_id, k.license FROM (SELECT doc_id, {canonical_sql("coalesce(text, '')")} AS canon FROM documents) d LEFT JOIN known k ON d.canon = k.canon),
lines AS (SELECT doc_id, {canonical_sql('line')} AS canon FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
hits AS (SELECT doc_id, license FROM lines JOIN known USING (canon)),
names AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT doc_id, license FROM hits UNION SELECT doc_id, license FROM whole WHERE license IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, w.license AS text_license, coalesce(n.licenses, '') AS licenses, coalesce(h.n, 0)::BIGINT AS n_license_lines
FROM whole w LEFT JOIN names n USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) h USING (doc_id)
"""
