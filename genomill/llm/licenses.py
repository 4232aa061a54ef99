"""License scans by canonical digests, in DataFrame functions only.

A text is reduced to a canonical form: lower case, without copyright notices, one spelling of words
that licences spell in several ways, and one space for whatever is no letter or digit. Whole texts
are hash-joined with the digests of known licences; the lines of a text are looked up likewise.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright\b|\(c\)|©)[^\n]*$"
# A line is a copyright notice if it has a year, (c) or a holder: lines of licence bodies may begin with the word as well.
NO_HOLDER = "and|applicable|are|as|at|claims?|disclaimer|does|for|from|has|have|holders?|if|in|information|infringement|interests?|is|laws?|licen[cs]es?|licensed|may|must|not|notices?|of|on|or|owners?|ownership|permissions?|protection|provisions|rights?|shall|statements?|status|that|to|treaty|treaties|was|which|will|with|work|the software|the program|the library|the work|this software"
NOTICE_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n(©]*(?:©[^\n]*|\(c\)[^\n]*\b(?:19|20)\d\d\b[^\n]*|copyright\b(?:[^\n]*(?:\b(?:19|20)\d\d\b|\(c\)|©)[^\n]*|[^\p{{L}}\p{{N}}\n]+(?!(?:{NO_HOLDER})\b)[\p{{L}}\p{{N}}][^\n]*|[^\p{{L}}\p{{N}}\n]*))$"
RESERVED = r"\ball rights reserved\b"
OTHER = r"[^\p{L}\p{N}]+"
#: Known licences are a list on the driver, and so bounded; more than this is refused.
MOST_KNOWN = 10_000

# Spellings that count as the same, in canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_FEE = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

# Texts of licences and the notices that they ask for.
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ],
    "ISC": [f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_NO_FEE}"],
    "0BSD": [f"{_GRANT}. {_NO_FEE}"],
    "BSD-2-Clause": [f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}

# What licences are called in one-line statements.
CALLED = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0"],
    "Unlicense": ["Unlicense"],
}
SAID = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "Distributed under the {}"]


# Titles of licence files, and more names in one-line statements.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC", "Internet Systems Consortium license"],
    "0BSD": ["BSD Zero Clause License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD", "Zero-Clause BSD License", "The Zero-Clause BSD License", "0BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "The BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "The FreeBSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "The BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License", "zlib"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License - Version 1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License 1.0 (BSL-1.0)"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
ALSO_CALLED = {
    "MIT": ["MIT License (MIT)"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: Whole licences, as files. What follows these lines may be absent: it tells how to apply the terms.
FULL = os.path.join(os.path.dirname(__file__), "license_texts")
TERMS_END = {"Apache-2.0": "END OF TERMS AND CONDITIONS", "GPL-2.0": "END OF TERMS AND CONDITIONS", "GPL-3.0": "END OF TERMS AND CONDITIONS", "LGPL-2.1": "END OF TERMS AND CONDITIONS"}


def known() -> list[tuple[str, str]]:
    """(licence, text) of all texts and statements that this module knows."""
    out = [(k, t) for k, texts in TEXTS.items() for t in texts]
    return out + [(k, said.format(name)) for k, names in CALLED.items() for name in names for said in SAID]


def titled() -> list[tuple[str, str]]:
    """(licence, text) of licence files: with the usual titles, items without numbers or with letters, and whole licences."""
    out = []
    for k, titles in TITLES.items():
        texts = list(TEXTS.get(k, []))
        if k == "Unlicense":
            texts.append(_full(k))
        # BSD and zlib items are also marked by signs, which no canonical form has, or by letters
        texts += [t for text in texts if "1. " in text for t in (_marked(text, ("", "", "")), _marked(text, ("a) ", "b) ", "c) ")))]
        out += [(k, text) for text in texts] + [(k, f"{title}\n\n{text}") for title in titles for text in texts]
    for name in sorted(os.listdir(FULL)):
        k, text = name.removesuffix(".txt"), _full(name.removesuffix(".txt"))
        out.append((k, text))
        if k in TERMS_END:
            end = text.index(TERMS_END[k])
            out += [(k, text[:end]), (k, text[: end + len(TERMS_END[k])])]
    wtfpl = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\n"
    out.append(("WTFPL", wtfpl + TEXTS["WTFPL"][0]))
    return out + [(k, said.format(name)) for k, names in ALSO_CALLED.items() for name in names for said in SAID] + [(k, t) for k, titles in TITLES.items() for t in titles if k in ("ISC", "0BSD", "Zlib", "BSL-1.0")]


def _full(license_id: str) -> str:
    with open(os.path.join(FULL, f"{license_id}.txt"), encoding="utf-8") as file:
        return file.read().replace("\f", "\n")


def _marked(text: str, marks: tuple[str, ...]) -> str:
    for number, mark in zip(("1. ", "2. ", "3. "), marks, strict=True):
        text = text.replace(f" {number}", f" {mark}")
    return text


def _spaced(words: str) -> str:
    """Words with a space on each side of every one."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """The canonical form of a text; that of null is empty."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, NOTICE_LINE, " "), RESERVED, " ")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, OTHER, " ")), F.lit(" "))
    same = F.replace(text, F.lit(" "), F.lit("  "))  # each word has spaces of its own, so that equal words may follow one another
    for other, one in SPELLINGS.items():
        same = F.replace(same, F.lit(_spaced(other)), F.lit(_spaced(one)))
    same = F.replace(same, F.lit("  "), F.lit(" "))
    return F.trim(F.when(text.rlike(f" ({'|'.join(SPELLINGS)}) "), same).otherwise(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256, license_id, n_notices, notices.

    license_id: the known licence whose canonical form the whole text has, else null. notices:
    the known licences that single lines of the text are, distinct, in order, comma-joined; empty
    if there are none; n_notices: how many lines. A null or empty text, or one of copyright lines alone, has an empty canonical form and no
    licence. Where several licences have one canonical form the first by name stands. Repeated rows
    give repeated rows, an empty table an empty one; a null doc_id stays null.
    """
    spark = docs.sparkSession
    texts = known() + titled() if texts is None else texts
    if len(texts) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} known texts")
    table = spark.createDataFrame(texts, "license_id string, known string").select("license_id", digest(F.col("known")).alias("canonical_sha256"), canonical(F.col("known")).alias("form"))
    table = table.where("form <> ''").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    forms = table.collect()  # as many as there are known texts
    ids = F.create_map(*[F.lit(x) for r in forms for x in (r.canonical_sha256, r.license_id)]) if forms else F.create_map().cast("map<string,string>")
    digests = F.array(*[F.lit(r.canonical_sha256) for r in forms]) if forms else F.array().cast("array<string>")
    lines = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 0), digest)
    hits = F.filter(lines, lambda x: F.array_contains(digests, x))
    out = docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256"), hits.alias("hits"))
    out = out.join(F.broadcast(table), "canonical_sha256", "left")
    notices = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.element_at(ids, x))))
    return out.select("doc_id", "canonical_sha256", "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(notices, ",").alias("notices"))


def _sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace(regexp_replace({out}, {q(COPYRIGHT_LINE)}, ' ', 'g'), {q(RESERVED)}, ' ', 'g')"
    out = f"replace(' ' || trim(regexp_replace({out}, {q(OTHER)}, ' ', 'g')) || ' ', ' ', '  ')"
    for other, one in SPELLINGS.items():
        out = f"replace({out}, {q(_spaced(other))}, {q(_spaced(one))})"
    return f"trim(replace({out}, '  ', ' '))"


def oracle() -> str:
    """SQL of known() and of all lines that begin with copyright; it has neither titled() nor bodies with such lines."""
    rows = ", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, t in known())
    return f"""
with k as (select sha256(form) as h, min(id) as id from (select id, {_sql("t")} as form from (values {rows}) as v(id, t)) where form <> '' group by 1),
d as (select row_number() over () as r, doc_id, text, sha256({_sql("text")}) as h from documents),
l as (select r, k.id from (select r, unnest(string_split(coalesce(text, ''), chr(10))) as line from d) join k on sha256({_sql("line")}) = k.h),
n as (select r, count(*) as n, string_agg(distinct id, ',' order by id) as ids from l group by r)
select d.doc_id, d.h as canonical_sha256, k.id as license_id, coalesce(n.n, 0) as n_notices, coalesce(n.ids, '') as notices
from d left join k on d.h = k.h left join n on d.r = n.r
"""
