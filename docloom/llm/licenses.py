"""License scans by canonical digest, in DataFrame operations alone.

A text is brought to a canonical form (lower case, equivalent spellings united, copyright lines and
punctuation gone) and hashed; the digest is looked up among those of known licence texts and notices by
a hash join. The whole document is one such text and each of its lines another. Known are whole licences
(also those in `license_texts`), their usual file headers, short notices and SPDX lines, and what the
caller gives.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, small

# Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("http://", "https://"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"), ("merchantibility", "merchantability"), ("&", " and "),
)
COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©)[^\n]*[0-9]{4}"
#: After "copyright" at a line's start, these go on with a sentence of a licence and don't name a holder.
_PROSE = "notices?|holders?|owners?|laws?|licenses?|and|or|interests?|statements?|rights?|protection|in|on|the|to|is|as|of|if|treaty|permissions?|ownership|infringement|acts?|over|for|by the|disclaimers?|doctrines?|information|status|works?|that|with|from|under|may|shall|this|any|does|resulting|are|including"
_OPENING = "permission (?:is hereby granted|to use)|redistribution and use|(?:licensed|released|distributed|available) under|this (?:work|project|software|program|file|library|source|code|product|package|module) |use of this |spdx-license|(?:the )?(?:mit|isc|bsd|apache|gnu|mozilla|zlib|boost|eclipse) [^\\n]{0,40}license|apache license"
#: A copyright notice at the start of a line, behind comment marks, with a year or without, as far as it goes: to
#: the opening of a licence on the same line, to the end of a sentence that a long text follows, or to the line's end.
COPYRIGHT_NOTICE = (
    r"^[\s#*/;%!'\"<>|.+-]*(?:(?:rem|dnl|portions)\s+)?(?:copyright\s*(?:\(c\)|©)|©|(?:copyright(?! treaty)|\(c\))(?=[^\n]{0,100}[0-9]{4})|copyright:?\s+(?!(?:" + _PROSE + r")\b)\p{L})"
    r"[^\n]*?(?=\b(?:" + _OPENING + r")|(?<=\p{L}{3})\.\s+(?!all rights)\p{L}[^\n]{80}|$)"
)
PUNCTUATION = r"[^\p{L}\p{N}]+"


# Wordings of well-known licences, and short notices that name one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "MIT": ["MIT License"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"], "Unlicense": ["Unlicense"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_NOTICES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "Distributed under the {}.", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.")


_TEXTS = Path(__file__).with_name("license_texts")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_HEADER = """{it} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{either} version {version} of the License{any}
{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_GNU_ENDS = ("You should have received a copy of the {name} along with {that}. If not, see <https://www.gnu.org/licenses/>.", "You should have received a copy of the {name} along with {that}; if not, see <https://www.gnu.org/licenses/>.")
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}"
# Ids of the SPDX list that are these licences under another name, or licences that only SPDX lines name.
_SPDX = (
    "0BSD", "AFL-3.0", "Apache-1.1", "Artistic-2.0", "BSD-4-Clause", "BlueOak-1.0.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.2", "GFDL-1.3", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA",
    "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11",
)


def _names() -> dict[str, list[str]]:
    """The names that licences have in notices."""
    names = {k: list(v) for k, v in _NAMES.items()}
    for short, long in _GNU.items():
        for version in ("2", "2.1", "3"):
            at = f"{short}-{version if '.' in version else version + '.0'}"
            names[at] = [f"{long}, version {version}", f"{long} version {version}", f"{long} v{version}", f"{long}, version {version}.0"]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}"]
    names["CC0-1.0"] = ["CC0 1.0", "CC0"]
    return names


def _sql_licenses() -> list[tuple[str, str]]:
    """(licence, text) of the wordings that the query's SQL has."""
    names = _names()
    out = [("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("BSD-2-Clause", _BSD2 + _BSD_END), ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END)]
    out += [("Proprietary", "All rights reserved.")]
    return out + [(k, form.format(name)) for k, some in names.items() for name in some for form in _NOTICES]


def _file_headers() -> list[tuple[str, str]]:
    """(licence, text) of the headers that licences recommend for source files."""
    lead = 'Licensed under the Apache License, Version 2.0 (the "License");'
    out = [("Apache-2.0", lead), ("Apache-2.0", f"{lead} you may not use this file except in compliance with the License."), ("Apache-2.0", f"{lead}\n{_APACHE_HEADER}")]
    for url in ("http://mozilla.org/MPL/2.0/.", "http://www.mozilla.org/MPL/2.0/."):
        out.append(("MPL-2.0", _MPL_HEADER.format(url)))
    out.append(("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"))  # the line that names it where the header is wrapped
    out.append(("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"))
    out += [("BSL-1.0", out[-1][1].replace(x, y)) for x, y in (("http://www", "https://www"), ("copy at http://www.boost", "copy at http://boost"))]
    for short, version in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
        name, at = _GNU[short], f"{short}-{version if '.' in version else version + '.0'}"
        for it, that in (("This program", "this program"), ("This library", "this library"), ("This file", "this file")):
            for mark, either, tail in ((":", ", either", ", or (at your option) any later version."), (";", "; either", ", or (at your option) any later version."), (":", ", ", "."), (";", "; ", ".")):
                body = _GNU_HEADER.format(it=it, mark=mark, name=name, either=either, version=version, any=tail)
                out += [(at, body)] + [(at, f"{body}\n{end.format(name=name, that=that)}") for end in _GNU_ENDS]
    return out


def known_licenses() -> list[tuple[str, str]]:
    """(licence, text) of every known wording; notices and SPDX lines are made from the licences' names.

    SPDX ids that end in -only, -or-later or + name the licence without that.
    """
    out = _sql_licenses()
    for path in sorted(_TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        head = text.split("END OF TERMS AND CONDITIONS")[0]  # often without the appendix on how to apply it
        out += [(path.stem, text)] + ([(path.stem, head), (path.stem, head + "END OF TERMS AND CONDITIONS")] if head != text else [])
    out += [("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("BSL-1.0", _BSL), ("MIT", "The MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", "The ISC License\n" + _ISC)]
    bulleted = [(f"BSD-{n}-Clause", f"BSD {n}-Clause License", re.sub(r"\n[1-3]\. ", "\n* ", text) + _BSD_END) for n, text in ((2, _BSD2), (3, _BSD2 + _BSD3))]
    for k, title, text in (("BSD-2-Clause", "BSD 2-Clause License", _BSD2 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License", _BSD2 + _BSD3 + _BSD_END), *bulleted):
        out += [(k, text)] if "* " in text else []
        out += [(k, "All rights reserved.\n" + text), (k, f"{title}\n{text}"), (k, f"{title}\nAll rights reserved.\n{text}")]
    out += _file_headers()
    for k in [*_names(), *_SPDX]:
        gnu = k.split("-")[0] in _GNU
        out += [(k, f"SPDX-License-Identifier: {x}") for x in ([k, f"{k}-only", f"{k}-or-later"] if gnu else [k])]
    return out


def _canonical_lines(text: Column) -> Column:
    folded = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, F.lower(text))
    # the search for a notice is dear, and nearly all lines lack the words that every notice has
    bare = lambda line: F.when(line.rlike(r"copyright|\(c\)|©"), F.regexp_replace(line, COPYRIGHT_NOTICE, "")).otherwise(line)
    return F.transform(F.split(folded, "\n"), lambda line: F.trim(F.regexp_replace(bare(line), PUNCTUATION, " ")))


def _whole(lines: Column) -> Column:
    # the one spelling of two words can stand on two lines
    return F.replace(F.array_join(F.filter(lines, lambda x: x != ""), " "), F.lit("copyright holder"), F.lit("copyright owner"))


def _digests(rows: DataFrame) -> DataFrame:
    """(digest, license) of (license, text): a row for each canonical form that isn't empty."""
    forms = rows.select("license", _whole(_canonical_lines(F.col("text"))).alias("_form")).where("_form <> ''")
    return forms.groupBy(F.md5("_form").alias("digest")).agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license): a row for each known canonical form, some hundreds whatever the input."""
    return _digests(spark.createDataFrame(known_licenses(), "license string, text string"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row for each row of `df`: doc_id, license, line_licenses, n_license_lines.

    `license` is that of the whole text or null; `line_licenses` the distinct licences of single lines,
    sorted, joined by commas; `n_license_lines` (long) the lines that have one. A null text counts as
    empty and has none, as has a text of copyright lines alone. Null ids are ids like any other.
    Texts are neither shuffled nor sent on: only digests leave the scan.

    `known`: a table (license, text) of further wordings. It may be large (its digests are broadcast only
    while few), and its name for a wording goes before the one known here.
    """
    digests = F.broadcast(known_digests(df.sparkSession))
    if known is not None:
        own = _digests(known)
        digests = small(saved(own.unionByName(digests.join(own, "digest", "left_anti"))))
    known = digests
    body = F.coalesce(F.col(text), F.lit(""))
    lined = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_copy"), _canonical_lines(body).alias("_lines"))
    # place 0 is the whole text, the others are its lines; one pass makes the digests of both
    forms = F.concat(F.array(F.md5(_whole(F.col("_lines")))), F.transform("_lines", lambda x: F.when(x != "", F.md5(x))))
    looked_up = lined.select("doc_id", "_copy", F.posexplode(forms).alias("_line", "digest")).where("digest is not null").join(known, "digest", "left")
    whole, line = F.col("_line") == 0, F.struct("_line", "license")
    each = looked_up.where(whole | F.col("license").isNotNull()).groupBy("doc_id", "_copy").agg(
        F.count(F.when(whole, 1)).alias("_rows"), F.max(F.when(whole, F.col("license"))).alias("license"), F.collect_set(F.when(~whole, line)).alias("_found")
    )
    rows = each.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))))  # rows that repeat count their lines once
    licenses = F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["license"]))), ",")
    return rows.select("doc_id", "license", licenses.alias("line_licenses"), F.size("_found").cast("long").alias("n_license_lines"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_lines(text: str) -> str:
    quote = lambda s: s.replace("'", "''")
    folded = reduce(lambda x, pair: f"replace({x}, '{quote(pair[0])}', '{quote(pair[1])}')", SPELLINGS, f"lower(coalesce({text}, ''))")
    return f"list_transform(string_split({folded}, chr(10)), lambda x: case when regexp_matches(x, '{quote(COPYRIGHT_LINE)}') then '' else trim(regexp_replace(x, '{PUNCTUATION}', ' ', 'g')) end)"


_SQL_WHOLE = "md5(array_to_string(list_filter(lines, lambda x: x <> ''), ' '))"
ORACLE = f"""with raw(license, text) as (values {", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in _sql_licenses())}),
known as (select {_SQL_WHOLE} as digest, min(license) as license from (select license, {_sql_lines("text")} as lines from raw) group by 1),
d as (select doc_id, row_number() over () as copy, {_sql_lines("text")} as lines from documents),
l as (select doc_id, copy, unnest(lines) as form, unnest(range(len(lines))) as line from d),
found as (select copy, string_agg(distinct license, ',' order by license) as line_licenses, count(distinct line) as n from l join known on known.digest = md5(form) where form <> '' group by copy)
select d.doc_id, known.license as license, coalesce(line_licenses, '') as line_licenses, coalesce(n, 0) as n_license_lines
from d left join known on known.digest = {_SQL_WHOLE} left join found on found.copy = d.copy"""
