"""Licence texts and notices, by lookup of canonical digests.

Texts are brought to a canonical form: lower case, copyright lines removed,
equivalent spellings made one, punctuation and white space folded into single
spaces. The digest of a document's entire text, of each of its sections (parts
between blank lines), of runs of as many sections as a known text has, and of each
of its lines is hash-joined with the digests of known licence texts and notices. A
run is a unit "section" at the position of its first. Only units whose canonical
length some known text has are hashed. All in DataFrame expressions.

Defined results: null and empty texts match nothing; a unit that is empty in
canonical form matches nothing. A document with one line matches as text,
section and line. Rows are independent: repeated rows give repeated matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_THIRD = tuple(f"Neither the name of {who} may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors", "the University nor the names of its contributors"))
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {whom} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_PARTIES = (
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
)
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _bsd() -> list[tuple[str, str]]:
    """(identifier, text) of the two- and three-clause licence, by marks of the items, blank lines, parties and titles."""
    out = []
    for by, whom in _BSD_PARTIES:
        for third in (None, *_BSD_THIRD):
            items = [*_BSD_ITEMS, *([third] if third else [])]
            name = "BSD-3-Clause" if third else "BSD-2-Clause"
            titles = ("", "BSD 3-Clause License", "The 3-Clause BSD License") if third else ("", "BSD 2-Clause License", "The 2-Clause BSD License")
            for marks in (("1.", "2.", "3."), ("*", "*", "*")):
                said = [f"{m} {item}" for m, item in zip(marks, items, strict=False)]
                for body in ((_BSD_START, *said), (f"{_BSD_START}\n{said[0]}", *said[1:]), ("\n".join([_BSD_START, *said]),), (_BSD_START, "\n".join(said))):
                    for title in titles:
                        # A copyright line that stands above the text is not a paragraph of the canonical form.
                        out.append((name, "\n\n".join(([title] if title else []) + [*body, _BSD_END.format(by=by, whom=whom)])))
                        if title:
                            out.append((name, f"{title}\n\nAll rights reserved.\n\n" + "\n\n".join([*body, _BSD_END.format(by=by, whom=whom)])))
                        else:
                            out.append((name, "All rights reserved.\n\n" + "\n\n".join([*body, _BSD_END.format(by=by, whom=whom)])))
    return out


#: Known licence texts, as (identifier, text).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License\n\n{_ISC}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("Unlicense", _UNLICENSE),
    *[("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <{at}>") for at in ("http://unlicense.org/", "http://unlicense.org", "https://unlicense.org/", "https://unlicense.org")],
    *_bsd(),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0-or-later", _GPL_NOTICE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: Fixed values: (identifier, digest, size, length of the first section, sections) of long licence texts as their
#: stewards publish them in plain text, whole, and up to the end of the terms, with and without that line.
KNOWN_DIGESTS: tuple[tuple[str, str, int, int, int], ...] = (
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847", 9821, 68, 32),
    ("Apache-2.0", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87", 8805, 68, 27),
    ("Apache-2.0", "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166", 8777, 68, 26),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117, 46, 59),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483, 46, 44),
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", 14455, 46, 43),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406, 49, 122),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968, 49, 109),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", 30940, 49, 108),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, 56, 37),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", 14271, 34, 83),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692, 27, 13),
)
#: Names by which notices call a licence, as (identifier, names).
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("the MIT License", "the MIT license (MIT)", "MIT")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0-only", ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0")),
    ("GPL-3.0-only", ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0")),
    ("LGPL-3.0-only", ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPL-3.0")),
    ("AGPL-3.0-only", ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause")),
    ("ISC", ("the ISC License",)),
    ("Unlicense", ("the Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0")),
    ("CC-BY-4.0", ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License")),
)
#: How notices begin.
LEADS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "This file is licensed under", "This code is released under")


def notices() -> list[tuple[str, str]]:
    """(identifier, notice) of every way to begin with every name, and of the identifier line."""
    said = [(i, f"{lead} {name}") for i, names in NAMES for name in names for lead in LEADS]
    return said + [(i, f"SPDX-License-Identifier: {i}") for i, _ in NAMES]


#: Spellings that count as the same, in lower case; the second stands for both.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("noninfringement", "non-infringement"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("https://", "http://"),
    ("&", " and "),
)
#: Lines that begin with the word inside a licence's wrapped sentence are not copyright lines.
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b(?![ \t]+(?:holders?|owners?|notices?|statements?|laws?|licenses?|interests?|permissions?|and|or|in|on|to|disclaimer)\b)|\(c\)|©)[^\n]*$"
_FOLD = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Canonical form, with line breaks kept: the forms of its parts are what is between them, trimmed."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.regexp_replace(out, _FOLD, " ")


def flat(text: Column) -> Column:
    """A canonical form on one line."""
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, size, layouts) of the known texts and notices: as many rows as there are.

    A layout is the length of a text's first section, and the number of its sections.
    """
    rows = spark.createDataFrame([*KNOWN, *notices()] if known is None else list(known), "license string, text string").select("license", canonical(F.col("text")).alias("c"))
    sections = F.expr(f"filter({_SECTIONS.format('c')}, x -> x <> '')")
    made = rows.select("license", flat(F.col("c")).alias("c"), sections.alias("s")).select("license", F.sha2("c", 256).alias("digest"), F.length("c").alias("size"), F.length(F.col("s")[0]).alias("first"), F.size("s").alias("sections"))
    if known is None:
        made = made.unionByName(spark.createDataFrame(list(KNOWN_DIGESTS), "license string, digest string, size int, first int, sections int"))
    return made.groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"), F.collect_set(F.struct("first", "sections")).alias("layouts"))


#: Sections of a canonical form, each on one line.
_SECTIONS = r"transform(split({}, '\\n[ \\n]*\\n'), x -> trim(regexp_replace(x, '[ \\n]+', ' ')))"


def scan(docs: DataFrame, known: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, position, license, digest) of each unit whose digest is known. position counts from 0."""
    known = known_digests(docs.sparkSession) if known is None else known
    sizes = [r[0] for r in known.select("size").distinct().limit(10_000).collect()]  # lengths of known texts, at most 10,000 numbers
    if len(sizes) == 10_000:
        sizes = []
    fits = f"length(x) > 0 AND length(x) IN ({', '.join(map(str, sizes))})" if sizes else "length(x) > 0"
    runs: dict[int, list[int]] = {}
    for r in known.select(F.explode("layouts").alias("l")).select("l.first", "l.sections").where("sections > 1").distinct().collect():  # a few numbers of each known text
        runs.setdefault(r["first"], []).append(r["sections"])
    form = docs.where(F.col(text).isNotNull()).select(F.col(key), canonical(F.col(text)).alias("__c"))
    parts = form.select(key, "__c", F.split("__c", "\n").alias("__lines"), F.expr(_SECTIONS.format("__c")).alias("__sections"))
    kept = f"u -> {fits.replace('length(x)', 'length(u.c)')}"
    unit = lambda name, array: f"filter(transform({array}, (x, i) -> struct('{name}' AS unit, i AS position, trim(regexp_replace(x, '[ \\n]+', ' ')) AS c)), {kept})"
    wanted = [unit("text", "array(__c)"), unit("section", "__sections"), unit("line", "__lines")]
    if runs:
        # As many sections as a known text has, from each section that is as long as its first.
        counts = "CASE length(h.c) " + " ".join(f"WHEN {first} THEN array({', '.join(map(str, sorted(n)))})" for first, n in sorted(runs.items())) + " END"
        heads = f"filter(transform(__sections, (x, i) -> struct(i, x AS c)), h -> length(h.c) IN ({', '.join(map(str, sorted(runs)))}))"
        every = f"flatten(transform({heads}, h -> transform({counts}, m -> struct('section' AS unit, h.i AS position, CASE WHEN h.i + m <= size(__sections) THEN array_join(slice(__sections, h.i + 1, m), ' ') ELSE '' END AS c))))"
        wanted.append(f"filter({every}, {kept})")
    each = parts.select(key, F.explode(F.expr(f"concat({', '.join(wanted)})")).alias("u")).select(key, "u.unit", "u.position", F.sha2("u.c", 256).alias("digest"))
    return each.join(known.select("digest", "license"), "digest").select(key, "unit", "position", "license", "digest")
