"""Licence scans by canonical digests.

A text and each of its lines are brought to a canonical form: lower case,
copyright lines gone, equivalent spellings made one, everything but letters and
digits a single space. The digest of the whole canonical unit is looked up by a
hash join in a table of known licence digests. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, id_text

# Equivalent spellings, and notices and texts of public licences.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("whilst", "while"),
    ("merchantable", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("version", "v"),
]
COPYRIGHT_LINE = r"(?:copyright|\(c\)|all rights reserved)[^\n]*"
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
}
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZERO_BSD_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE_BODY = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_LINK = "For more information, please refer to <https://unlicense.org>"
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = {
    "MIT": [MIT_BODY, "MIT License\n" + MIT_BODY, "The MIT License (MIT)\n" + MIT_BODY, "The MIT License\n" + MIT_BODY],
    "ISC": [ISC_BODY, "ISC License\n" + ISC_BODY],
    "0BSD": [ZERO_BSD_BODY, "BSD Zero Clause License\n" + ZERO_BSD_BODY, "Zero-Clause BSD\n" + ZERO_BSD_BODY],
    "BSD-2-Clause": ["\n".join([*head, BSD_CONDITIONS, BSD_DISCLAIMER]) for head in ([], ["BSD 2-Clause License"], ["The 2-Clause BSD License"])],
    "BSD-3-Clause": ["\n".join([*head, BSD_CONDITIONS, BSD_ENDORSEMENT, BSD_DISCLAIMER]) for head in ([], ["BSD 3-Clause License"], ["The 3-Clause BSD License"])],
    "Zlib": [ZLIB_BODY, "zlib License\n" + ZLIB_BODY, "The zlib/libpng License\n" + ZLIB_BODY],
    "Unlicense": ["\n".join([*head, UNLICENSE_BODY, *tail]) for head in ([], ["The Unlicense"]) for tail in ([], [UNLICENSE_LINK], [UNLICENSE_LINK.replace("https", "http")], [UNLICENSE_LINK.replace(">", "/>")])],
    "Apache-2.0": [APACHE_HEADER, APACHE_HEADER.replace("http:", "https:")],
}


def canonical_text(text: str) -> str:
    """As ``canonical``, in Python, for the known texts; these are ASCII."""
    text = re.sub(r"(^|\n)[ \t]*" + COPYRIGHT_LINE, r"\1", text.lower())
    words = f" {re.sub('[^a-z0-9]+', ' ', text)} "
    for a, b in SPELLINGS:
        words = words.replace(f" {a} ", f" {b} ")
    return words.strip()


def canonical(c: Column) -> Column:
    text = F.regexp_replace(F.lower(c), r"(^|\n)[ \t]*" + COPYRIGHT_LINE, "$1")
    words = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(words)


def known_digests() -> list[tuple[str, str]]:
    """(digest, license_id) of the known notices and texts, in canonical form."""
    both = [(name, x) for table in (NOTICES, TEXTS) for name, texts in table.items() for x in texts]
    return sorted({(hashlib.sha256(canonical_text(x).encode()).hexdigest(), name) for name, x in both})


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, n, license_id): whole texts and lines that are a known licence or notice, counted for each document.

    ``unit`` is 'text' or 'line'; a text of a single line counts as both. Rows
    that share a doc_id, null included, count together. ``known`` is a list of
    (digest, license_id), sent to every task: its size is the caller's, not the
    corpus's. Null and empty texts have no licence.
    """
    table = docs.sparkSession.createDataFrame(known if known is not None else known_digests(), "digest string, license_id string")
    source = id_text(docs, id_col, text_col)
    whole = source.select("doc_id", F.lit("text").alias("unit"), F.col("text").alias("part"))
    lines = source.select("doc_id", F.lit("line").alias("unit"), F.explode(F.split("text", "\n")).alias("part"))
    # a canonical unit that is no known text costs one hash of its own bytes, in the scan's stage
    digests = whole.unionByName(lines).select("doc_id", "unit", F.sha2(canonical(F.col("part")), 256).alias("digest"))
    return digests.join(F.broadcast(table), "digest").groupBy("doc_id", "unit", "license_id").agg(F.count("*").alias("n"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def oracle() -> str:
    words = "' ' || regexp_replace(regexp_replace(lower(part), '(^|\\n)[ \\t]*" + COPYRIGHT_LINE.replace("\\n", "\\n") + "', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        words = f"replace({words}, ' {a} ', ' {b} ')"
    rows = ", ".join(f"('{d}', '{name}')" for d, name in known_digests())
    return f"""
WITH known(digest, license_id) AS (VALUES {rows}),
units AS (
  SELECT doc_id, 'text' AS unit, coalesce(text, '') AS part FROM documents
  UNION ALL SELECT doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
digests AS (SELECT doc_id, unit, sha256(trim({words})) AS digest FROM units)
SELECT doc_id, unit, license_id, count(*) AS n FROM digests JOIN known USING (digest) GROUP BY ALL"""
