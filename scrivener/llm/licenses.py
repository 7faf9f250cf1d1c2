"""Licence scans: Dice coefficient over word bigrams, DataFrame functions only."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Keeps bounds that are whole numbers from being rounded past themselves.
ROUNDING = 1e-9
#: Texts of licences, and the headers and notices by which files name theirs.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_GNU_COPY = "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
)


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """The notices of a licence of the GNU family: one line, the header's first paragraph, the whole header."""
    parts = [p.format(name, version) for p in (_GNU, _GNU_REST, _GNU_COPY)]
    return (f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name}, version {version}.", parts[0], "\n\n".join(parts))


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE, "\n\n".join((_APACHE, _APACHE_REST))),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT, "\n\n".join((_MIT, _MIT_NOTICE, _WARRANTY))),
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "\n\n".join((_BSD, _BSD_1, _BSD_2, _BSD_WARRANTY))),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD, "\n\n".join((_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY))),
    "ISC": ("Released under the ISC License.", _ISC, "\n\n".join((_ISC, _ISC_WARRANTY))),
    "MPL-2.0": (_MPL, _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Zlib": ("\n\n".join(_ZLIB),),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "Unlicense": (_UNLICENSE[0], "\n\n".join(_UNLICENSE)),
}
#: A sentence ends at a mark that white space follows. Blank lines part blocks.
SENTENCE_END = r"([.;:!?])[\x20\t]+"
BLANK = r"\n[\x20\t\r]*\n"


def paragraphs(templates: dict[str, tuple[str, ...]]) -> int:
    """Blocks of the template that has most."""
    return max((len(re.split(BLANK, t)) for ts in templates.values() for t in ts), default=1)


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs of words, joined by a space; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def telling_words(templates: dict[str, tuple[str, ...]], dice: float) -> list[str]:
    """Words of which every text that reaches ``dice`` with some template has at least one.

    A match may miss only so many of a template's bigrams. Words are taken, those of other
    templates first, then long ones (so mostly rare) that are in many of the bigrams, then
    short ones without a vowel (which prose hardly has), until their bigrams are more than
    that: a text with none of the words misses all of them.
    """
    found: set[str] = set()
    texts = [re.findall(r"[^\W_]+", t.lower()) for ts in templates.values() for t in ts]
    for words in sorted(texts, key=lambda ws: (len(ws), ws)):
        grams = set(zip(words, words[1:]))
        least = math.ceil(len(grams) * dice / (2 - dice) - ROUNDING)
        may_miss = len(grams) - math.ceil(dice * (least + len(grams)) / 2 - ROUNDING)
        chosen: set[str] = set()
        while sum(a in chosen or b in chosen for a, b in grams) <= may_miss and chosen < set(words):
            new = {w: sum(w in g and not chosen & set(g) for g in grams) for w in set(words) - chosen}
            chosen.add(max(new, key=lambda w: (w in found and new[w] > 0, new[w] * max(len(w) - 3, 0), new[w] > 0 and w.isalpha() and not set(w) & set("aeiouy"), new[w], w)))
        found |= chosen
    return sorted(found)


def template_table(spark, templates: dict[str, tuple[str, ...]], dice: float) -> DataFrame:
    """One row: the templates as an array of (license, grams, n, least, most).

    A text with b bigrams can reach ``dice`` with a template of n only if
    n * dice / (2 - dice) <= b <= n * (2 - dice) / dice.
    """
    rows = [(k, t) for k in sorted(templates) for t in templates[k]]
    grams = spark.createDataFrame(rows or [("", "")], "license string, text string").select("license", bigrams(normal_words(F.col("text"))).alias("grams"))
    sized = grams.withColumn("n", F.size("grams")).where("n > 0").withColumn("least", F.ceil(F.col("n") * dice / (2 - dice) - ROUNDING)).withColumn("most", F.floor(F.col("n") * (2 - dice) / dice + ROUNDING))
    return sized.agg(F.sort_array(F.collect_list(F.struct("license", "grams", "n", "least", "most"))).alias("_templates"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Rows ``key, unit, license, dice`` for each unit of a document that matches a template.

    Units are, in this order and numbered from 1, the lines of a text, the sentences of
    lines with several, its blocks of two or more lines between blank ones, the runs of two
    or more blocks up to as many as a template has, and a text of more blocks as a whole.
    A unit's words are compared as sets of bigrams; only templates whose size bounds admit
    the unit are candidates, and units that no template admits are dropped before any
    comparison. A unit gets its best licence with a coefficient of at least ``dice``; of
    equals the first by name. Texts and units without any of :func:`telling_words` cannot
    match and are dropped first. Null and empty texts, and an empty list of templates,
    match nothing. A narrow plan: the templates are one broadcast row of fixed size, and
    documents are not shuffled.
    """
    wanted = template_table(docs.sparkSession, templates, dice)
    words = telling_words(templates, dice)
    # short words count as words only, long ones wherever they stand
    short = r"(?<![\p{L}\p{N}])(?:" + "|".join(w for w in words if len(w) < 4) + r")(?![\p{L}\p{N}])"
    told = lambda x: reduce(or_, [F.contains(x, F.lit(w)) for w in words if len(w) > 3], x.rlike(short) if any(len(w) < 4 for w in words) else F.lit(False))
    # an array of one, so that a text is put in lower case once
    may = lambda c: F.exists(F.array(F.lower(c)), told)
    docs = docs.select(F.col(key), F.col(text)).where(may(F.col(text)))
    lines = F.split("_text", "\n")
    none = F.array().cast("array<string>")
    parts = lambda x: F.split(F.regexp_replace(x, SENTENCE_END, "$1\n"), "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.when(F.size(parts(x)) > 1, parts(x)).otherwise(none)))
    most, pieces, n = paragraphs(templates), F.col("_blocks"), F.size("_blocks")
    blocks = F.filter(pieces, lambda b: F.contains(b, F.lit("\n")))
    # runs of blocks without a telling word keep their number but not their text
    one = lambda i, k: F.when(F.exists(F.slice("_tells", i, k), lambda x: x), F.array_join(F.slice(pieces, i, k), "\n"))
    joined = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: one(i, k))
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max(2, most))), lambda k: F.when((k <= n) & (k <= most), joined(k)).otherwise(none)))
    whole = F.when(n > most, F.array("_text")).otherwise(none)
    split = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.split(F.col(text), BLANK).alias("_blocks")).withColumn("_tells", F.transform("_blocks", may))
    units = split.select("_key", F.posexplode(F.concat(lines, sentences, blocks, runs, whole)).alias("_at", "_unit")).where(may(F.col("_unit")))
    worded = units.select("_key", (F.col("_at") + 1).alias("unit"), normal_words(F.col("_unit")).alias("_words"))
    worded = worded.where((F.size("_words") >= 2) & F.arrays_overlap("_words", F.array(*map(F.lit, words)).cast("array<string>")))
    paired = worded.crossJoin(F.broadcast(wanted))  # one row
    largest = F.array_max(F.transform("_templates", lambda t: t["most"]))
    paired = paired.where(F.size("_words") - 1 >= F.array_min(F.transform("_templates", lambda t: t["least"])))
    # a unit has at least as many distinct bigrams as distinct words less one
    graced = paired.where(F.size(F.array_distinct("_words")) - 1 <= largest).withColumn("_grams", bigrams(F.col("_words")))
    admitted = F.filter("_templates", lambda t: (F.size("_grams") >= t["least"]) & (F.size("_grams") <= t["most"]))
    scored = F.transform(
        admitted, lambda t: F.struct((2.0 * F.size(F.array_intersect(t["grams"], F.col("_grams"))) / (t["n"] + F.size("_grams"))).alias("dice"), t["license"].alias("license"))
    )
    best = F.aggregate(scored, F.lit(None).cast("struct<dice: double, license: string>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    return graced.withColumn("_best", best).where(F.col("_best.dice") >= dice).select(F.col("_key").alias(key), "unit", F.col("_best.license").alias("license"), F.col("_best.dice").alias("dice"))


def oracle(templates: dict[str, tuple[str, ...]] = TEMPLATES, dice: float = DICE) -> str:
    """The same over ``documents`` in DuckDB SQL."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k in sorted(templates) for t in templates[k])
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    most, parts = paragraphs(templates), f"string_split(regexp_replace(x, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))"
    return f"""
WITH t AS (SELECT license, {grams} AS grams FROM (SELECT license, {words.format('text')} AS words FROM (VALUES {values}) v(license, text))),
 p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '{BLANK}') AS bs FROM documents WHERE text IS NOT NULL),
 a AS (SELECT doc_id, list_concat(lines, flatten(list_transform(lines, lambda x: CASE WHEN len({parts}) > 1 THEN {parts} ELSE [] END)), list_filter(bs, lambda b: contains(b, chr(10))),
   flatten(list_transform(range(2, {most + 1}), lambda k: CASE WHEN k <= len(bs) THEN list_transform(range(1, len(bs) - k + 2), lambda i: array_to_string(list_slice(bs, i, i + k - 1), chr(10))) ELSE [] END)), CASE WHEN len(bs) > {most} THEN [text] ELSE [] END) AS us FROM p),
 u AS (SELECT doc_id, unnest(us) AS unit_text, generate_subscripts(us, 1) AS unit FROM a),
 g AS (SELECT doc_id, unit, {grams} AS grams FROM (SELECT doc_id, unit, {words.format('unit_text')} AS words FROM u)),
 s AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
   FROM g JOIN t ON len(g.grams) > 0 AND len(g.grams) <= len(t.grams) * {(2 - dice) / dice} + {ROUNDING} AND len(t.grams) <= len(g.grams) * {(2 - dice) / dice} + {ROUNDING})
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, dice FROM s WHERE dice >= {dice}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1"""
