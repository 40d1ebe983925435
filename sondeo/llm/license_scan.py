"""License scans (operator 9): canonical digest lookup of entire texts.

A text is put into canonical form - lower case, copyright statements removed, equivalent spellings
unified, punctuation and white space runs to one blank - and the sha256 of the whole canonical
text is hash-joined to the digests of the known licences. The units looked up are the entire
document and each of its lines, since short notices stand on lines of their own. The known texts are a fixed list
(``KNOWN``: notices and the full MIT, ISC, 0BSD, BSD, zlib and Unlicense texts), far below any broadcast bound, or a table of any size
with the columns license and text, which is put into canonical form and joined by Spark.

NULL and empty texts match nothing. Every input row with a match gives one row, also repeated rows and rows without a doc_id. Texts
of any length are looked up whole. Two known texts with one digest count as the licence that sorts last. Only doc_id and text are read, so
further columns of any name do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal when licence texts are compared.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder s", "copyright holders"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("whilst", "while"),
]

# The texts of known licences and notices.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
    "source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
    "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
    "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
KNOWN: list[tuple[str, str]] = [
    ("BSD-2-Clause", _BSD_2 + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License " + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MIT", _GRANT),
    ("MIT", "MIT License " + _GRANT),
    ("MIT", "The MIT License (MIT) " + _GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

# A copyright statement: from its begin on a line to the line's end, or to the words that begin a grant on the same line.
GRANT_BEGINS = r"(licen[cs]ed under|released under|permission is|permission to use|redistribution and use|this work is licen)"
COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
# Every canonical text in KNOWN holds one of these; they survive normalisation unchanged, so texts without any cannot match.
ANCHORS = r"licen[cs]e|permission|redistribution"


def canonical(text: str) -> str:
    """The canonical form, for the known texts (the data takes ``canonical_column``)."""
    s = re.sub(GRANT_BEGINS, r"\n\1", text.lower())
    s = re.sub(COPYRIGHT_LINE, " ", s)
    s = re.sub("[^a-z0-9]+", " ", s).strip(" ")
    for a, b in SPELLINGS:
        s = s.replace(a, b)
    return s


def canonical_column(text: Column) -> Column:
    """Canonical form of a text column."""
    s = F.regexp_replace(F.lower(text), GRANT_BEGINS, "\n$1")
    s = F.regexp_replace(s, COPYRIGHT_LINE, " ")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    for a, b in SPELLINGS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def known_digests(known: list[tuple[str, str]] = KNOWN) -> list[dict[str, str]]:
    """Distinct (digest, license) rows of the known texts."""
    rows = {hashlib.sha256(canonical(t).encode()).hexdigest(): name for name, t in known}
    bad = [name for name, t in known if not re.search(ANCHORS, canonical(t))]
    if bad:
        raise ValueError(f"known texts without an anchor word: {bad}")
    return [{"digest": d, "license": n} for d, n in sorted(rows.items())]


def _lookup(docs: DataFrame, known: list[tuple[str, str]] | DataFrame) -> tuple[DataFrame, str | None]:
    """The table of digests, and the words of which each known text holds one (None if nothing is known of them)."""
    if isinstance(known, DataFrame):
        digest = F.sha2(canonical_column(F.col("text")).cast("binary"), 256)
        return known.where("text IS NOT NULL").groupBy(digest.alias("digest")).agg(F.max("license").alias("license")), None
    table = F.from_json(F.lit(json.dumps(known_digests(known))), "array<struct<digest:string,license:string>>")
    return F.broadcast(docs.sparkSession.range(1).select(F.inline(table))), ANCHORS


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """One row per matching unit: doc_id, row (tells input rows apart), unit (0: entire text, else line number from 1), license."""
    lookup, anchors = _lookup(docs, known)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    possible = rows.where(F.lower(F.col("text")).rlike(anchors)) if anchors else rows.where("text IS NOT NULL")
    units = possible.select("doc_id", "row", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("unit", "part"))
    units = units.where(F.lower(F.col("part")).rlike(anchors)) if anchors else units
    form = canonical_column(F.col("part"))
    digests = units.select("doc_id", "row", "unit", form.alias("form")).where("form <> ''").select("doc_id", "row", "unit", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    return digests.join(lookup, "digest").select("doc_id", "row", "unit", "license")


def license_report(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """One row per input row with a match: doc_id, license (entire text, NULL if only lines match), licenses
    (distinct, ascending, joined by a comma) and n_lines (matching lines)."""
    hits = scan_licenses(docs, known)
    return hits.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("unit") == 0, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.sum((F.col("unit") > 0).cast("long")).alias("n_lines"),
    ).drop("row")
