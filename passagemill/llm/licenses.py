"""Licence scans: Dice coefficient over word bigrams against licence templates.

Every line, paragraph and whole text is a unit. A unit is normalised to lower-case words; its
set of word bigrams is compared with each template whose size can reach the threshold:
Dice >= t needs (2 - t) * min(a, b) >= t * max(a, b). What no unit shows, a notice inside other
prose or wrapped among other lines, is looked for in runs of words of about a template's length.
All of it is row-local.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import barrier
from .common import let, table

#: Least Dice coefficient, in hundredths: comparisons are of whole numbers.
PERCENT = 80

# Short notices as they stand in files, and the bodies of the brief licences.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
    "by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version."
)
_MIT_WHOLE = _MIT + (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_BSD_CLAUSE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_WHOLE = _ISC + (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
_GPL_WHOLE = _GPL + (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>."
)
TEMPLATES = [
    ("isc", _ISC_WHOLE),
    ("mpl-2.0", _MPL),
    ("gpl-3.0", _GPL_WHOLE),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE),
    ("bsd", _BSD),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _GPL),
    ("isc", _ISC),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _MIT),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", _MIT_WHOLE),
    ("bsd", _BSD + _BSD_DISCLAIMER),
    ("bsd", _BSD + _BSD_CLAUSE + _BSD_DISCLAIMER),
]


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _least(size: int, percent: int) -> int:
    """Bigrams that anything of the threshold's Dice shares with a template of ``size``, at least."""
    return -(-size * percent // (200 - percent))


def _longest(text: str, percent: int) -> int:
    """Bigrams, repeated ones too, of the longest run of words that is compared with a template."""
    return (len(_template_words(text)) - 1) * (200 - percent) // percent


def _literal(percent: int = PERCENT) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(i).alias("template"), F.array(*[F.lit(b) for b in _template_bigrams(text)]).alias("grams"),
                F.lit(_least(len(_template_bigrams(text)), percent)).alias("least"), F.lit(_longest(text, percent)).alias("longest"),
            )
            for i, (name, text) in enumerate(TEMPLATES)
        ]
    )


#: Words so common that a text is not looked at for having them, unless a template needs it.
_COMMON = set("a an and any are as at be but by for from in is it its may of on or other out that the this to under use with work you your".split())


def _keys(percent: int) -> list[str]:
    """Words of which every text with a notice has one.

    A notice shares ``_least`` bigrams with its template, so it has one of any set of more than
    the others; the set is that of all bigrams with one of the words. Words that other templates
    took come first, then long ones.
    """
    keys: set[str] = set()
    for _, text in sorted(TEMPLATES, key=lambda t: len(t[1])):
        grams = [b.split() for b in _template_bigrams(text)]
        for word in sorted({w for b in grams for w in b}, key=lambda w: (w not in keys, w in _COMMON, -len(w), w)):
            if sum(bool(keys.intersection(b)) for b in grams) > len(grams) - _least(len(grams), percent):
                break
            keys.add(word)
    return sorted(keys)


def _one_of(words: list[str]) -> str:
    """A regular expression for any of the words that reads each beginning that several share once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [c + written(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        rest = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{rest})?" if "" in node else rest

    return written(tree)


def _asked(docs: DataFrame, percent: int) -> DataFrame:
    """The rows that may have a notice: a cheap test, for most texts have none of the words."""
    return docs.where(F.lower("text").rlike(rf"(?<![a-z0-9]){_one_of(_keys(percent))}(?![a-z0-9])"))


def _normalised(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def _grams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(words[i], F.lit(" "), words[i + 1]))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _sized(percent: int) -> Callable[[Column], Column]:
    """A function from a unit's words to its best template, with whether it is ``enough``; null where no template is of its size."""
    sizes = [len(_template_bigrams(text)) for _, text in TEMPLATES]
    low = _least(min(sizes), percent)
    high = max(sizes) * (200 - percent) // percent

    def best(grams: Column) -> Column:
        def able(t: Column) -> Column:
            a, b = F.size(grams), F.size(t["grams"])
            return F.least(a, b) * (200 - percent) >= F.greatest(a, b) * percent

        return F.array_min(F.transform(F.filter(_literal(percent), able), lambda t: _dice(grams, t, percent)))

    def sized(words: Column) -> Column:
        # w words have at most w - 1 bigrams; more than ``high`` distinct ones are sorted out below.
        return F.when(F.size(words) - 1 >= low, let(_grams(words), lambda g: F.when(F.size(g).between(F.lit(low), F.lit(high)), best(g))))

    return sized


def _dice(grams: Column, t: Column, percent: int) -> Column:
    shared, both = F.size(F.array_intersect(grams, t["grams"])), F.size(grams) + F.size(t["grams"])
    enough = shared * 200 >= both * percent
    return F.struct((-2.0 * shared / both).alias("less"), t["template"].alias("template"), t["name"].alias("name"), enough.alias("enough"), shared.alias("shared"))


def scan_licenses(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What licence notices the rows of ``docs(doc_id, text)`` carry: one row per unit that matches.

    Returns doc_id, unit ("line", "paragraph" of several lines, or "text" of several paragraphs),
    unit_no (from 0, blank ones counted), license and dice (its best template's, ties by template
    order, rounded to 6 places). Null, empty and wordless texts have no match; repeated rows match
    each by themselves; other columns are ignored.
    """
    sizes = [len(_template_bigrams(text)) for _, text in TEMPLATES]
    low = _least(min(sizes), percent)
    text = F.coalesce("text", F.lit(""))

    def unit(kind: str, parts: Column, keep) -> Column:
        numbered = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("body")))
        return F.filter(numbered, keep)

    several = lambda x: F.contains(x["body"], F.lit("\n"))
    lines = unit("line", F.split(text, "\n", -1), lambda x: x["body"] != "")
    paragraphs = F.split(text, r"\n[\x20\t]*\n", -1)
    whole = F.when(F.size(paragraphs) > 1, unit("text", F.array(text), several)).otherwise(F.array().cast("array<struct<unit:string,unit_no:int,body:string>>"))
    units = _asked(docs, percent).select("doc_id", F.explode(F.concat(lines, unit("paragraph", paragraphs, several), whole)).alias("u")).select("doc_id", "u.*")
    units = units.where(F.length("body") >= 2 * low)  # w words are at least 2 w - 1 characters

    found = units.select("doc_id", "unit", "unit_no", let(_normalised(F.col("body")), _sized(percent)).alias("b"))
    return found.where("b.enough").select(
        "doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), F.col("b.name").alias("license"), F.round(-F.col("b.less"), 6).alias("dice")
    )


def embedded_notices(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The notices that are in none of the units of :func:`scan_licenses`, in the same columns.

    The unit is "notice", unit_no is the number of its first word in the text (from 0). Every run
    of words up to 1.5 times as long as a template (at 80 %) is compared with it, in what is left
    when units that match are blanked out; of the runs from one word the best counts, and of runs
    that overlap the one that shares most with its template (ties by Dice, place, length, template order).
    """
    sized = _sized(percent)
    grams = sorted({b for _, text in TEMPLATES for b in _template_bigrams(text)})
    fewest = min(_least(len(_template_bigrams(text)), percent) for _, text in TEMPLATES)
    asked = _asked(docs, percent)

    def left(body: Column, parts: Callable[[Column], Column]) -> Column:
        blanked = lambda ws: F.when(F.coalesce(sized(ws)["enough"], F.lit(False)), F.array_repeat(F.lit("|"), F.size(ws))).otherwise(parts(ws))
        return let(_normalised(body), blanked)

    def lines(p: Column) -> Column:
        return F.flatten(F.transform(F.split(p, "\n", -1), lambda x: left(x, lambda ws: ws)))

    paragraphs = F.transform(F.split("text", r"\n[\x20\t]*\n", -1), lambda p: left(p, lambda _: lines(p)))
    words = left(F.col("text"), lambda _: F.flatten(paragraphs))
    pairs = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat(ws[i], F.lit(" "), ws[i + 1]))
    asked = asked.select("doc_id", barrier(let(words, lambda ws: F.when(F.size(ws) >= 2, pairs(ws)))).alias("pairs"))
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.col("pairs")[i].isin(*grams))
    asked = asked.where(F.size("pairs") > 0).select("doc_id", "pairs", barrier(hits).alias("hits"))
    asked = asked.where(F.size("hits") >= fewest)

    def runs(t: Column) -> Column:
        # A best run begins and ends with a bigram of the template and has ``least`` of them.
        def from_hit(own: Column, k: Column) -> Column:
            def run(j: Column) -> Column:
                def scored(d: Column) -> Column:
                    return F.struct(d["less"].alias("less"), own[k].alias("start"), own[j].alias("stop"), t["template"].alias("template"), t["name"].alias("name"), d["enough"].alias("enough"), d["shared"].alias("shared"))

                return let(_dice(F.array_distinct(F.slice("pairs", own[k] + 1, own[j] - own[k] + 1)), t, percent), scored)

            ends = F.sequence(k + t["least"] - 1, F.least(k + t["longest"], F.size(own)) - 1)
            near = F.filter(ends, lambda j: own[j] - own[k] < t["longest"])
            return F.array_min(F.filter(F.transform(near, run), lambda r: r["enough"]))

        def from_hits(own: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(own) - t["least"]), lambda k: own[k + t["least"] - 1] - own[k] < t["longest"])
            return F.when(F.size(own) >= t["least"], F.filter(F.transform(starts, lambda k: from_hit(own, k)), lambda r: r.isNotNull()))

        return let(F.filter("hits", lambda i: F.array_contains(t["grams"], F.col("pairs")[i])), from_hits)

    every = F.flatten(F.filter(F.transform(_literal(percent), runs), lambda r: r.isNotNull()))
    every = F.array_sort(F.transform(every, lambda r: F.struct((-r["shared"]).alias("more"), *[r[x].alias(x) for x in ("less", "start", "stop", "template", "name")])))
    asked = asked.select("doc_id", barrier(every).alias("runs")).where(F.size("runs") > 0)
    # A run of bigrams start..stop has the words start..stop + 1.
    apart = lambda taken, r: F.forall(taken, lambda x: (r["start"] > x["stop"] + 1) | (x["start"] > r["stop"] + 1))
    zero = F.filter("runs", lambda r: F.lit(False))
    chosen = F.aggregate("runs", zero, lambda taken, r: F.when(apart(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
    return asked.select("doc_id", F.explode(chosen).alias("r")).select(
        "doc_id", F.lit("notice").alias("unit"), F.col("r.start").cast("long").alias("unit_no"), F.col("r.name").alias("license"), F.round(-F.col("r.less"), 6).alias("dice")
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs).unionAll(embedded_notices(docs))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, _template_bigrams(text)))}])" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH t(template, name, grams) AS (VALUES {rows}),
p AS (
  SELECT doc_id, coalesce(text, '') AS txt, string_split(coalesce(text, ''), chr(10)) AS ls,
         string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n') AS ps
  FROM documents),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(ls))) AS unit_no, unnest(ls) AS body FROM p
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))) AS unit_no, unnest(ps) AS body FROM p) WHERE contains(body, chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, txt FROM p WHERE len(ps) > 1),
w AS (
  SELECT doc_id, unit, unit_no, regexp_extract_all(lower(body), '[a-z0-9]+') AS ws FROM u),
g AS (
  SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams
  FROM w WHERE len(ws) >= 2),
d AS (
  SELECT g.doc_id, g.unit, g.unit_no, t.template, t.name,
         len(list_intersect(g.grams, t.grams)) AS i, len(g.grams) + len(t.grams) AS n, 2.0::DOUBLE * i / n AS dice
  FROM g JOIN t ON least(len(g.grams), len(t.grams)) * {200 - PERCENT} >= greatest(len(g.grams), len(t.grams)) * {PERCENT}),
b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, template) AS r FROM d)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, name AS license, round(dice, 6)::DOUBLE AS dice FROM b WHERE r = 1 AND i * 200 >= n * {PERCENT}
"""


QUERIES = {"op5_licenses": op5_licenses}
ORACLES = {"op5_licenses": _sql()}
