"""Licence scan by canonical digest: DataFrame functions only, no Python on the executors.

A text is brought to a canonical form (lower case; copyright notices removed; every run of punctuation and white
space, comment marks among them, a single space; equivalent spellings made one) and hashed with SHA-256. Known
licences go through the same expression, and the two digests are hash-joined. The form does not depend on where lines
break or on marks before them. A copyright notice begins a line, with the word copyright and then a sign and a name or
a year, or with the sign and a year, and goes to the end of its sentence, at most of its line: prose after it stays.
Some published notices inside paragraphs, and "all rights reserved", go as phrases.
The digests of the lines of a text are joined likewise, so that a one-line notice inside a longer document is found
as well.

Defined results: a null text counts as empty; its digest is that of the empty string and it matches nothing.
Repeated rows give repeated results; ids may be null; extra input columns are ignored (only the id and the text are read).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many known texts their digests are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 10_000

#: Equivalent spellings, applied in this order to lower-case words with single spaces between them. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("creative commons", "cc"),
    ("merchantibility", "merchantability"),
)

#: White space and comment marks at the start of a line (but not a copyright sign).
LINE_START = r"(^|\n)[^\p{L}\p{N}\n©(]+"

_YEAR = r"(?:(?:19|20)[0-9]{2}|19[xy]{2}|year|yyyy)\b"
_MARKS = r"[^\p{L}\p{N}\n]*"
#: Notices that published texts have inside a paragraph, wherever lines break. Fixed values.
COPYRIGHT_PHRASE = (
    r"copyright[ \t\n]+(?:\(c\)|©)[ \t\n]+(?:[0-9][0-9, \t\n-]*free[ \t\n]+software[ \t\n]+foundation,?[ \t\n]+inc\b|<?(?:year|19[xy]{2})>?[ \t\n]+<?name[ \t\n]+of[ \t\n]+author>?|year[ \t\n]+your[ \t\n]+name)"
    r"|\ball[ \t\n]+rights[ \t\n]+reserved\b"
)
#: What a notice goes on with: to the end of its sentence, at most of its line. A point ends no sentence inside a word, after an initial or after one of these.
_REST = r"(?:[^\n.]*(?:\.[^ \t\n]|\b(?:\p{L}|inc|ltd|co|corp|llc|jr|sr|dr|mr|st)\.)){0,20}[^\n.]*\.*"
#: Sentences that begin so, as terms do, begin a line of their own.
TERMS = r"([.;])[ \t]+((?:licensed|released|distributed|redistribution|permission|this (?:program|software|file|work|project|source))\b)"
#: A line that starts so begins with a copyright notice; what stands after the notice's sentence stays.
COPYRIGHT_LINE = rf"(^|\n){_MARKS}(?:copyright[ \t]*(?:\(c\)|©)[ \t,<\[]*[\p{{L}}\p{{N}}]|copyright{_MARKS}{_YEAR}|©|\(c\){_MARKS}{_YEAR}){_REST}"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: (licence id, full text) of longer licences as published.
_FULL = tuple((k, t) for k, t in json.loads((Path(__file__).parent / "licenses.json").read_text("utf-8")))

#: (licence id, text or one-line notice) of licences as published. Fixed values.
KNOWN = (
    *_FULL,
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    ("0BSD", _0BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "The Unlicense\n\n" + _UNLICENSE),
    ("BSL-1.0", _BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BSL),
    ("Apache-2.0", _APACHE),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks kept."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, TERMS, "$1\n$2"), LINE_START, "$1")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_PHRASE, "\n"), COPYRIGHT_LINE, "$1")
    return F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")


def _spelled(words: Column) -> Column:
    for spelled, common in SPELLINGS:
        words = F.replace(words, F.lit(spelled), F.lit(common))
    return F.regexp_replace(words, r"\bhttp\b", "https")


def _whole(lines: Column) -> Column:
    return _spelled(F.trim(F.regexp_replace(lines, "[ \n]+", " ")))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts, one row per digest (the first id in order wins a clash); empty texts are not known."""
    known = list(known)
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("known_text")) for k, t in known)) if known else F.from_json(F.lit("[]"), "array<struct<license_id:string,known_text:string>>")
    texts = spark.range(1).select(F.inline(rows)).select(_whole(canonical_lines(F.col("known_text"))).alias("whole"), "license_id").where("whole <> ''")
    table = texts.groupBy(F.sha2("whole", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    return F.broadcast(table) if len(known) <= MAX_BROADCAST else table


def license_scan(df: DataFrame, id_col: str, text_col: str, known=KNOWN) -> DataFrame:
    """One row per input row: id, text_digest, license_id of the entire text, notices (sorted ids of lines that are a known text, comma-separated, or null)."""
    table = known_digests(df.sparkSession, known)
    texts = df.select(F.col(id_col).alias("_id"), canonical_lines(F.col(text_col)).alias("_lines"))
    lines = F.filter(F.transform(F.array_distinct(F.split("_lines", "\n")), lambda x: F.trim(x)), lambda x: x != "")
    own = F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(_spelled(x), 256).alias("digest")))
    every = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.sha2(_whole(F.col("_lines")), 256).alias("digest"))), own)
    # The canonical form is made once a text; what leaves it are digests. By id and text: rows that repeat both have the same notices.
    digests = texts.select("_id", F.xxhash64("_lines").alias("_key"), F.inline(every)).join(table, "digest", "left").where("whole or license_id is not null")
    whole = F.col("whole")
    found = digests.groupBy("_id", "_key").agg(
        F.count_if(whole).alias("_n"),
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.collect_set(F.when(~whole, F.col("license_id"))).alias("_notices"),
    )
    notices = F.when(F.size("_notices") > 0, F.array_join(F.array_sort("_notices"), ","))
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(F.col("_id").alias(id_col), "text_digest", "license_id", notices.alias("notices"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql(known=KNOWN) -> str:
    """DuckDB's form of license_scan over documents."""

    def lines(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '\\r\\n?', chr(10), 'g')"
        out = f"regexp_replace({out}, {_sql_text(TERMS)}, '\\1' || chr(10) || '\\2', 'g')"
        out = f"regexp_replace({out}, {_sql_text(LINE_START)}, '\\1', 'g')"
        out = f"regexp_replace(regexp_replace({out}, {_sql_text(COPYRIGHT_PHRASE)}, chr(10), 'g'), {_sql_text(COPYRIGHT_LINE)}, '\\1', 'g')"
        return f"regexp_replace(replace({out}, '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def spelled(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
        return f"regexp_replace({x}, '\\bhttp\\b', 'https', 'g')"

    def whole(x: str) -> str:
        return spelled(f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))")

    values = ", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in known)
    return f"""
    WITH known AS (SELECT sha256(w) AS digest, min(k) AS license_id FROM (SELECT {whole(lines("t"))} AS w, k FROM (VALUES {values}) v(k, t)) WHERE w <> '' GROUP BY 1),
    d AS (SELECT doc_id, {lines("text")} AS lines FROM documents),
    l AS (SELECT DISTINCT doc_id, sha256({spelled("trim(line)")}) AS digest FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
    n AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices
          FROM (SELECT DISTINCT doc_id, license_id FROM l JOIN known USING (digest)) GROUP BY doc_id)
    SELECT d.doc_id, sha256({whole("d.lines")}) AS text_digest, k.license_id, n.notices
    FROM d LEFT JOIN known k ON k.digest = sha256({whole("d.lines")}) LEFT JOIN n ON n.doc_id = d.doc_id"""
