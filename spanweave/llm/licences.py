"""Licence scan by Dice coefficient over word bigrams, with DataFrame functions alone.

Units of a text are its lines and its blocks of lines between lines without letters or digits (the whole text, if there
is none). A unit and a template are
normalised to lower-case words; their similarity is 2 * common / (a + b) over sets of word bigrams. A template stays a
candidate only where the unit's size lies within t / (2 - t) and (2 - t) / t of its own, and where the unit holds one
of the bigrams of which any unit at the threshold must have one (those with the template's longest words, so the rarest
by far). A unit without any of these long words is dropped before bigrams are made. Common bigrams are counted for what
is left. The templates are few and fixed, so they travel in the plan; nothing is joined
or shuffled.

Further units are spans: runs of consecutive lines, blank ones between them too, that start and end in a line with words
and have at most (2 - t) / t times the template's words, and the whole text. A span counts for a template where no line
or block that it overlaps reaches the threshold with that template; of overlapping spans of one template the most
similar stays (then the shortest, then the first), and of overlapping spans, lines and blocks that reach the threshold
with several templates a span stays if it has the most bigrams in common. Their unit is the number of their first line. Only texts that hold as many of a template's bigrams
as any match must have are searched for spans of it.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; of equal scores the template
that comes first in the alphabet wins; each unit that matches gives a row, repeated lines too; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 80
#: Notices and licence texts as their publishers give them, names and years left out; excerpts are parts
#: that are often given alone.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-2-clause-excerpt": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "isc-excerpt": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-excerpt": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-notice": "Released under the MIT License.",
    "mit-licensed-notice": "Licensed under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>',
    "unlicense-excerpt": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, those with the longest words first."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}, key=lambda b: (-len(long_word(b)), -len(b), b))


def long_word(bigram: str) -> str:
    return max(bigram.split(" "), key=lambda w: (len(w), w))


def size_bounds(size: int, threshold: int) -> tuple[int, int]:
    """The least and greatest number of bigrams of a unit that may reach the threshold with a template of that size."""
    return -(-threshold * size // (200 - threshold)), (200 - threshold) * size // threshold


def needed_prefix(grams: list[str], threshold: int) -> list[str]:
    """Bigrams of which a unit at the threshold holds at least one: it lacks too few to lack them all."""
    low, _ = size_bounds(len(grams), threshold)
    least = -(-threshold * (low + len(grams)) // 200)
    return grams[: len(grams) - least + 1]


def let(value, body):
    """body(value), with value computed once in an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(found):
    """Of an array of structs in order of preference, those that overlap (first to last) none before them that stays."""
    overlaps = lambda x, y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])
    return F.aggregate(F.array_sort(found), F.slice(found, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def span_matches(docs: DataFrame, templates: dict[str, str], threshold: int) -> DataFrame:
    """id, unit (the first line), template and dice of spans; text of docs is normalised with its line ends left in."""
    known = {name: grams for name, text in sorted(templates.items()) if (grams := bigrams(text))}
    signs = sorted({b for g in known.values() for b in needed_prefix(g, threshold)})
    strings = lambda values: F.array(*[F.lit(v) for v in values])

    def template(name: str, grams: list[str]):
        least = len(grams) - len(needed_prefix(grams, threshold)) + 1
        most = (200 - threshold) * len(re.sub(r"[\W_]+", " ", templates[name]).split()) // threshold
        return F.struct(F.lit(name).alias("name"), strings(grams).alias("grams"), F.lit(least).alias("least"), F.lit(most).alias("most"))

    def once(df, name: str, value):
        """df with a column that is computed once for each row."""
        return df.select(*df.columns, F.inline(F.array(F.struct(value.alias(name)))))

    df = once(docs.where(F.col("text").contains("\n")), "t", F.split(F.trim(F.replace("text", F.lit("\n"), F.lit(" \n "))), " +")).drop("text")
    df = once(df, "w", F.filter("t", lambda x: ~x.isin("\n", "")))
    df = df.where((F.size("w") > 1) & F.arrays_overlap("w", strings(sorted({long_word(s) for s in signs}))))
    n = F.size("w")
    df = once(df, "b", F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    df = df.where(F.arrays_overlap("b", strings(signs)))
    held = F.filter(F.array(*[template(*x) for x in known.items()]), lambda t: F.size(F.array_intersect(t["grams"], "b")) >= t["least"])
    df = once(df, "held", held).where(F.size("held") > 0)
    # Words before each line: its line end's place less the line ends before it.
    ends = F.filter(F.transform("t", lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
    df = once(df, "c", F.concat(F.array(F.lit(0)), F.transform(ends, lambda p, k: p - k), F.array(n)))

    def line(k):
        a, z = F.get("c", k), F.get("c", k + 1)
        return F.struct(k.alias("line"), a.alias("a"), z.alias("z"), ((k == 0) | (F.get("c", k - 1) == a)).alias("opens"), ((k == F.size("c") - 2) | (F.get("c", k + 2) == z)).alias("closes"))

    df = once(df, "lines", F.filter(F.transform(F.sequence(F.lit(0), F.size("c") - 2), line), lambda x: x["z"] > x["a"])).drop("t", "w", "c")

    def run(x, y, whole):
        return F.struct(x["line"].alias("first"), y["line"].alias("last"), x["a"].alias("a"), y["z"].alias("z"), ((x["line"] == y["line"]) | (x["opens"] & y["closes"] & whole)).alias("unit"))

    def spans(t):
        def runs(hit):
            def from_line(x, i):
                near = F.transform(F.slice("lines", i + 1, t["most"]), lambda y, k: run(x, y, y["line"] - x["line"] == k))
                near = F.filter(near, lambda r: ((r["z"] - r["a"] <= t["most"]) | r["unit"]) & (F.size(F.filter(F.slice(hit, r["a"] + 1, r["z"] - r["a"] - 1), lambda h: h)) >= t["least"]))
                # A run without a bigram of the template in its first line is less similar than without that line.
                return F.when(x["opens"] | F.exists(F.slice(hit, x["a"] + 1, x["z"] - x["a"]), lambda h: h), near).otherwise(F.slice(near, 1, 0))

            x, y = F.get("lines", F.lit(0)), F.get("lines", F.size("lines") - 1)
            return F.concat(F.flatten(F.transform("lines", from_line)), F.array(run(x, y, y["line"] - x["line"] == F.size("lines") - 1)))

        def scored(r):
            def score(g):
                hits = F.size(F.array_intersect(g, t["grams"]))
                total = F.size(g) + F.size(t["grams"])
                minus = -F.floor(2000 * hits / total).cast("bigint")
                return F.when(200 * hits >= threshold * total, F.struct((~r["unit"]).alias("span"), minus.alias("minus"), (r["z"] - r["a"]).alias("words"), r["first"].alias("first"), r["last"].alias("last"), hits.alias("hits")))

            return let(F.array_distinct(F.slice("b", r["a"] + 1, F.greatest(r["z"] - r["a"] - 1, F.lit(0)))), score)

        found = let(F.transform("b", lambda g: F.array_contains(t["grams"], g)), runs)
        best = let(F.filter(F.transform(found, scored), lambda x: x.isNotNull()), apart)
        return F.transform(best, lambda x: F.struct((-x["hits"]).alias("hits"), x["span"].alias("span"), x["minus"].alias("minus"), t["name"].alias("template"), x["first"].alias("first"), x["last"].alias("last")))

    df = once(df, "found", F.flatten(F.transform("held", spans)))
    df = df.where(F.size("found") > 0).select("id", F.inline(apart(F.col("found")))).where("span")
    return df.select("id", F.col("first").cast("bigint").alias("unit"), "template", (-F.col("minus")).alias("dice"))


def matches(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, unit_kind, unit (number, from 0), template and dice (in thousandths, rounded down) of units that match."""
    known = {name: grams for name, text in sorted(templates.items()) if (grams := bigrams(text))}
    bounds = {name: size_bounds(len(g), threshold) for name, g in known.items()}
    low, high = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    signs = sorted({b for g in known.values() for b in needed_prefix(g, threshold)})
    # One pass over a text: normalised with its line ends left in, then taken apart.
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))

    def units(kind: str, parts):
        return F.transform(parts, lambda u, i: F.struct(F.lit(kind).alias("unit_kind"), i.alias("unit"), u.alias("u")))

    lines = units("line", F.split("text", "\n"))
    blocks = F.filter(units("block", F.split("text", r"\n *\n")), lambda x: x["u"].contains("\n"))
    rows = docs.select("id", F.inline(F.when(F.col("text").contains("\n"), F.concat(lines, blocks)).otherwise(lines)))

    def once(df, value, name: str):
        """A column that is computed once for each row: filters on it are not pushed to where it is made."""
        return df.select("id", "unit_kind", "unit", F.inline(F.array(F.struct(value.alias(name)))))

    words = once(rows, F.split(F.trim(F.translate("u", "\n", " ")), " +"), "w")
    words = words.where((F.size("w") > low) & F.arrays_overlap("w", F.array(*[F.lit(w) for w in sorted({long_word(s) for s in signs})])))
    n = F.size("w")
    grams = once(words, F.array_distinct(F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))), "g")
    near = grams.where(F.size("g").between(low, high) & F.arrays_overlap("g", F.array(*[F.lit(s) for s in signs])))

    def common(name: str):
        lo, hi = bounds[name]
        hits = F.size(F.array_intersect("g", F.array(*[F.lit(b) for b in known[name]])))
        score = F.floor(2000 * hits / (F.size("g") + len(known[name]))).cast("bigint")
        return F.when(F.size("g").between(lo, hi) & (200 * hits >= threshold * (F.size("g") + len(known[name]))), F.struct((-score).alias("minus"), F.lit(name).alias("template")))

    best = F.array_min(F.filter(F.array(*[common(name) for name in known]), lambda x: x.isNotNull()))
    whole = near.withColumn("best", best).where(F.col("best").isNotNull()).select(
        F.col("id").alias(id_col), "unit_kind", F.col("unit").cast("bigint").alias("unit"), F.col("best.template").alias("template"), (-F.col("best.minus")).alias("dice"),
    )
    spans = span_matches(docs, templates, threshold).select(F.col("id").alias(id_col), F.lit("span").alias("unit_kind"), "unit", "template", "dice")
    return whole.unionByName(spans)
