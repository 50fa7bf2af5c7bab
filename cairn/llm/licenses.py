"""License scans by canonical digests: whole texts, single lines and blocks of lines are looked up among known notices and licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

#: Known texts are broadcast only up to so many digests (32 bytes and a name each, about 10 MB).
BROADCAST_ROWS = 100_000

#: SPDX names, with notices and short licences as they are usually written (an entire licence without its copyright line).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]

#: The same with bullets for numbers, and with "and" for "and/or", as many projects have them.
KNOWN += [(name, changed) for name, text in KNOWN for changed in {re.sub(r"(?m)^[0-9][.] ", "* ", text), text.replace("and/or distribute", "and distribute")} - {text}]

#: Entire long licences, as their stewards publish them: SPDX name, first words, number of words and digest of the canonical form.
LONG = [
    ("Apache-2.0", "apache license v2", 1588, "8a02440038a1db8c38b92b4eb8628eed7c1af01f3a5eb8a02097c7860dbc7c1b"),
    ("Artistic-1.0-Perl", "the artistic license", 967, "efb3949693e4ada79731b02b728ecbd96c3717290449569ffc9e7a93a00b0499"),
    ("CC0-1.0", "creative commons legal", 1084, "09981ea514631576f68544ed91e9e200b92773c3119b4843bd31da8801107d33"),
    ("GFDL-1.2", "gnu free documentation", 3284, "fc8cdfe27b7fec14d9ef9737b3b2cf8017d78432ffe31e3d5de99acc0fc5bb68"),
    ("GFDL-1.3", "gnu free documentation", 3692, "7b895c0ba816b5d784bc752389eaa77514b119c8aa55e04619158aa1cdb4b5df"),
    ("GPL-1.0", "gnu general public", 2053, "99e9a17005d277a30aef21a970b4c52d2e6ebe56356f5e8554fec904b1476292"),
    ("GPL-2.0", "gnu general public", 2959, "c089c0a23886520d9dbb3aeb4e41ab37c2022caf181ae8792f03162531b95a73"),
    ("GPL-3.0", "gnu general public", 5652, "4285a1a59cddceeb1b6c191367a914d3ab7df75f6902af416da3d7fd5e08a2a8"),
    ("LGPL-2.0", "gnu library general", 4177, "ef3d11768b1882798b380c8221c35072f4136a3b5f650887205d810c704de365"),
    ("LGPL-2.1", "gnu lesser general", 4372, "64c8107768e40e1fcf337039d34b4fa0ed3709938939b7df4068ebbc57883bef"),
    ("LGPL-3.0", "gnu lesser general", 1212, "7049a8642059be3fdceb4cb7c57d15f3786173dfd4e24799b2ee8ef3e153f783"),
    ("MPL-1.1", "mozilla public license", 3757, "ff18416612a8f4aa5ce5dea0532869d0e8f89a5dff589f15add8653ff94179a6"),
    ("MPL-2.0", "mozilla public license", 2410, "733c719b1a4dd30cc23fa21c40779a2a0dacc85dfa893c8163991c09b05bff0f"),
]

#: Words at a text's start by which known texts are looked up before digests are compared.
HEAD = 3
#: Known texts of so many words are entire licences or notices of a paragraph: they are found inside documents, however their lines are cut.
BLOCK_WORDS = 20

#: Fixed values: (pattern, replacement) over lower-case text, in order. Patterns keep line feeds, so that one pass serves
#: whole texts and lines; only what joins "copyright holder" and the like takes a line feed, so that a line that begins with
#: these words isn't taken for a copyright line. Replacements hold no groups: they mean the same to Spark and to SQL engines
#: with RE2. Both sides of a comparison go through them, so an equivalent spelling may become any one form.
# The names that a licence gives its holder and authors may go over the end of a line, and the line's end goes with them.
SPELLINGS = [
    ("copyright[^a-z0-9]+owner", "copyrightholder"),
    ("copyright[^a-z0-9]+holder", "copyrightholder"),
    ("copyright[^a-z0-9]+notice", "copyrightnotice"),
    ("copyright[^a-z0-9]+license", "copyrightlicense"),
    ("copyright[^a-z0-9]+law", "copyrightlaw"),
    ("neither[^a-z0-9]+the[^a-z0-9]+name[^a-z0-9]+of[^a-z0-9]+[^.]{1,120}?[^a-z0-9]+nor[^a-z0-9]+the[^a-z0-9]+names", "neither the name of copyrightholder nor the names"),
    ("software[^a-z0-9]+is[^a-z0-9]+provided[^a-z0-9]+by[^a-z0-9]+[^.]{1,120}?[^a-z0-9]+as[^a-z0-9]+is", "software is provided by copyrightholder as is"),
    ("in[^a-z0-9]+no[^a-z0-9]+event[^a-z0-9]+shall[^a-z0-9]+[^.]{1,120}?[^a-z0-9]+be[^a-z0-9]+liable", "in no event shall copyrightholder be liable"),
    ("licence", "license"),
    ("isation", "ization"),
    ("avour", "avor"),
    ("dgement", "dgment"),
    ("artefact", "artifact"),
    ("fulfill", "fulfil"),
    ("cancelled", "canceled"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("sub-license|sub license", "sublicense"),
    ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"),
    ("and/or", "and or"),
    ("https?://", " "),
    ("[&]", " and "),
    ("(?:^|\n)[^a-z0-9\n]*(?:copyright *(?:[(]c[)]|©|[0-9<\\[{]|by )|[(]c[)] *(?:copyright|[0-9<\\[{])|©|all rights reserved)[^\n]*", "\n"),
    ("version |ver[.] ?", "v"),
    ("v[.] ?", "v"),
    ("[^a-z0-9à-￿\n]+", " "),
]
#: Stands before the first word of a line while a text's words are counted; no canonical text has it.
MARK = "~"


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines; copyright lines and lines without letters or digits are empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def whole(lines: Column) -> Column:
    """Canonical form of a text, from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def head(canonical: Column) -> Column:
    """The first words, or all where there are fewer."""
    return F.substring_index(canonical, " ", HEAD)


def known_digests(known: DataFrame) -> DataFrame:
    """license_id, head, n_words and digest of each known text; texts without content are left out."""
    made = known.where(F.col("license_id").isNotNull()).select("license_id", whole(canonical_lines(F.col("text"))).alias("canonical")).where("canonical <> ''")
    return made.select("license_id", head(F.col("canonical")).alias("head"), F.size(F.split("canonical", " ")).alias("n_words"), digest(F.col("canonical")).alias("digest")).distinct()


def embedded(docs: DataFrame, found: DataFrame) -> DataFrame:
    """_key and license_id of the known texts (``found``: _key and a known text that may be there) that a document holds from the start of one of its lines on."""
    lines = F.filter(canonical_lines(F.col("text")), lambda x: x != "")
    marked = F.split(F.array_join(F.transform(lines, lambda x: F.concat(F.lit(MARK), x)), " "), " ")
    starts = F.array_compact(F.transform("marked", lambda w, i: F.when(w.startswith(MARK), i + 1)))
    words = docs.select("_key", marked.alias("marked")).select("_key", starts.alias("starts"), F.transform("marked", lambda w: F.ltrim(w, F.lit(MARK))).alias("words"))
    both = words.join(found, "_key")
    held = F.exists("starts", lambda at: (F.array_join(F.slice("words", at, HEAD), " ") == F.col("head")) & (digest(F.array_join(F.slice("words", at, F.col("n_words")), " ")) == F.col("digest")))
    return both.where(held).select("_key", "license_id").distinct()


def scan(docs: DataFrame, known: DataFrame, long_texts: DataFrame | None = None) -> DataFrame:
    """Known licences of every document.

    ``known`` has license_id and text; ``long_texts`` has what ``known_digests``
    makes of others, of which only digests are kept. Returns doc_id, n_lines
    (non-empty canonical lines), n_hits (lines that are a known notice),
    license_ids (sorted names of those, joined by commas; empty if none),
    whole_license (names of known texts that the document as a whole is) and
    embedded_licenses (names of known texts of at least BLOCK_WORDS words that
    it holds from the start of a line on, whatever its comment marks and however
    its lines are cut, if the first holds HEAD words). A null or empty text has no
    lines and no licence; rows with the same doc_id share their
    hits, rows without one are told apart by their texts; an empty table stays empty; other columns of ``docs`` are left out.
    Known texts that are null never match.
    """
    table = known_digests(known)
    if long_texts is not None:
        table = table.unionByName(long_texts.select(*table.columns))
    table = stored(table, "known")
    # Known texts have a proven size only if they are counted.
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = F.broadcast(table) if few else table
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))).alias("_key"))
    lines = docs.select("doc_id", "_key", F.filter(canonical_lines(F.col("text")), lambda x: x != "").alias("lines"))
    # The whole text travels as a unit of its own; a text of one line is both.
    units = lines.select("_key", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole(F.col("lines")).alias("unit"))), F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
    units = units.select("_key", "u.whole", "u.unit", head(F.col("u.unit")).alias("head"))
    exact = digest(F.col("unit")) == F.col("digest")
    begun = ~F.col("whole") & (F.col("n_words") >= BLOCK_WORDS)
    hits = stored(units.join(wanted, "head").withColumn("exact", exact).where(F.col("exact") | begun).select("_key", "whole", "exact", "license_id", "head", "n_words", "digest"), "hits")
    # Documents with a line that begins a known text are few; those alone are read again.
    begin = hits.where(begun).select("_key", "license_id", "head", "n_words", "digest").distinct()
    ids = begin.select("_key").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    inside = embedded(docs.join(ids, "_key", "left_semi"), begin)
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    lone = hits.where("exact").select("_key", "whole", "license_id", F.lit(False).alias("inside")).unionByName(inside.select("_key", F.lit(True).alias("whole"), "license_id", F.lit(True).alias("inside")))
    found = lone.groupBy("_key").agg(
        F.count_if(~F.col("whole")).alias("n_hits"), names(F.when(~F.col("whole"), F.col("license_id"))).alias("license_ids"), names(F.when(F.col("whole") & ~F.col("inside"), F.col("license_id"))).alias("whole_license"), names(F.when(F.col("inside"), F.col("license_id"))).alias("embedded_licenses")
    )
    base = lines.select("doc_id", "_key", F.size("lines").cast("long").alias("n_lines"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return base.join(found, "_key", "left").select("doc_id", "n_lines", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), text("license_ids"), text("whole_license"), text("embedded_licenses"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, among KNOWN and LONG."""
    return scan(documents(spark, sf_dir), spark.createDataFrame(KNOWN, "license_id string, text string"), spark.createDataFrame(LONG, "license_id string, head string, n_words int, digest string"))


def oracle() -> str:
    """The scan as SQL; the known texts are part of it."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    canonical = "lower(coalesce({}, ''))"
    for pattern, replacement in SPELLINGS:
        pattern, replacement = (f"replace({quoted(x.replace(chr(10), '@@'))}, '@@', chr(10))" for x in (pattern, replacement))
        pattern = pattern.replace("{", "{{").replace("}", "}}")
        canonical = f"regexp_replace({canonical}, {pattern}, {replacement}, 'g')"
    lines = lambda c: f"list_filter(list_transform(string_split({canonical.format(c)}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    values = ", ".join(f"({quoted(i)}, replace({quoted(t.replace(chr(10), '@@'))}, '@@', chr(10)))" for i, t in KNOWN)
    long_values = ", ".join(f"({quoted(i)}, {quoted(h)}, {n}, {quoted(d)})" for i, h, n, d in LONG)
    return f"""
WITH texts AS (SELECT DISTINCT license_id, array_to_string({lines("text")}, ' ') AS canonical FROM (VALUES {values}) k(license_id, text)),
known AS (SELECT license_id, len(string_split(canonical, ' ')) AS n_words, array_to_string(list_slice(string_split(canonical, ' '), 1, {HEAD}), ' ') AS head, sha256(canonical) AS digest FROM texts WHERE canonical <> ''
  UNION SELECT license_id, n_words, head, digest FROM (VALUES {long_values}) k(license_id, head, n_words, digest)),
d AS (SELECT doc_id, {lines("text")} AS lines FROM documents),
u AS (SELECT doc_id, false AS whole, unnest(lines) AS canonical FROM d UNION ALL SELECT doc_id, true, array_to_string(lines, ' ') FROM d),
h AS (SELECT doc_id, count(*) FILTER (NOT whole) AS n_hits, string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole) AS license_ids,
      string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (whole) AS whole_license FROM u JOIN known ON sha256(canonical) = digest WHERE canonical <> '' GROUP BY doc_id),
w AS (SELECT doc_id, lines, string_split(array_to_string(lines, ' '), ' ') AS words FROM d),
s AS (SELECT doc_id, words, unnest(range(len(lines))) AS k, list_transform(lines, lambda x: len(string_split(x, ' '))) AS sizes FROM w),
b AS (SELECT doc_id, words, 1 + coalesce(list_sum(list_slice(sizes, 1, k)), 0) AS spot FROM s),
e AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS embedded_licenses FROM b JOIN known
  ON array_to_string(list_slice(words, spot, spot + {HEAD - 1}), ' ') = head AND n_words >= {BLOCK_WORDS} AND sha256(array_to_string(list_slice(words, spot, spot + n_words - 1), ' ')) = digest GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, coalesce(license_ids, '') AS license_ids, coalesce(whole_license, '') AS whole_license, coalesce(embedded_licenses, '') AS embedded_licenses
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id)
"""
