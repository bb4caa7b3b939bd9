"""Licence notices: normalised lines against templates by the Dice coefficient of their word bigrams.

A line is lower-cased and everything but letters and digits becomes a space. Its distinct word bigrams A meet a
template's B if 2 |A & B| >= t (|A| + |B|). As |A & B| <= min(|A|, |B|), that needs t |B| <= (2 - t) |A| and
t |A| <= (2 - t) |B|: those size bounds choose the templates a line is compared with, and most lines meet none. All of
it happens inside the row; there is no shuffle.

``passages`` looks at windows of the whole text's words, across line ends and inside lines. A window loses nothing by
being cut back to its first and last bigram of the template, so only windows between two such bigrams are scored, and
only from a start that has as many of them within reach as the bound on |A & B| needs. From each start one fold goes over
every end within reach, notices and full licences alike, with running counts of distinct bigrams: a bigram is new to a
window if it was last met before the window's start. A window that scores no more than a shorter one of the same start is
left out, as the shorter one is free wherever it is. ``scan`` is a plainer form that SQL can say: single lines. A text
without one of a few anchor words, without which no template can be reached, is passed over.

Defined cases: null and empty texts have no lines with two words and give nothing; of templates with equal scores the
first name wins; repeated rows each give their rows; a window has at most (2 - t) / t times a template's bigrams, counted
with repeats; texts of any length are read whole, the work growing with their words and, around template bigrams, with the
reach; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Short notices that projects put into files and pages, by public licence identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without the prior written permission of the copyright holder.",
}

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Beside the notices, for passages: the bare reservation and full texts of short licences.
PASSAGES = TEMPLATES | {
    "All-rights-reserved": "All rights reserved.",
    "0BSD-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSL-1.0-full": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "GPL-3.0-notice": TEMPLATES["GPL-3.0-header"] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-notice": TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-full": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause-full": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause-full": _BSD + _BSD_NAME + _BSD_WARRANTY,
    "ISC-full": TEMPLATES["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
}


_FOLD = "struct<shared:int,within:int,minus:double,less:int,found:array<struct<minus:double,less:int,b:int,within:int>>>"
_FOUND = "array<struct<minus:double,less:int,licence:string,first:int,last:int,within:int,size:int>>"


def _words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])))


def _anchors(bigrams: list[str], t: int) -> set[str]:
    """The template's longest words, as many as it takes that every line within reach has one of them."""
    left, chosen = list(bigrams), set()
    for word in sorted({w for b in bigrams for w in b.split(" ")}, key=lambda w: (-len(w), w)):
        if (200 - t) * len(left) < t * len(bigrams):
            break
        chosen.add(word)
        left = [b for b in left if word not in b.split(" ")]
    return chosen


def _known(docs: DataFrame, templates: dict[str, str]) -> list:
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "licence string, notice string")
    return known.select("licence", _bigrams(_words(F.col("notice"))).alias("b")).collect()  # as many rows as templates


def scan(docs: DataFrame, min_percent: int = 80, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, line_no (from 0), line, licence, n_shared, n_line, n_template, dice: the best template of every line that reaches one."""
    t, known = min_percent, _known(docs, templates)
    sizes = [len(r["b"]) for r in known]
    anchors = sorted(set().union(*(_anchors(r["b"], t) for r in known)))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    near = reduce(or_, (F.contains(F.lower("line"), F.lit(w)) for w in anchors))
    lines = lines.where(near).withColumn("w", _words(F.col("line")))
    # a line of k distinct words has at least k - 1 distinct bigrams: too many prune it before its bigrams are built
    least, most = min(sizes), max(sizes)
    lines = lines.where((F.size("w") >= 2) & ((200 - t) * (F.size("w") - 1) >= t * least))
    lines = lines.where(t * (F.size(F.array_distinct("w")) - 1) <= (200 - t) * most)
    lines = lines.select("doc_id", "line_no", "line", let(F.col("w"), _bigrams).alias("a")).where(F.size("a") >= 1)

    def against(a: Column) -> Column:
        found = []
        for row, size in zip(known, sizes, strict=True):
            fits = (t * size <= (200 - t) * F.size(a)) & (t * F.size(a) <= (200 - t) * size)
            shared = F.size(F.array_intersect(a, F.array(*map(F.lit, row["b"]))))
            found.append(F.struct(F.when(fits, shared).otherwise(0).cast("long").alias("n_shared"), F.lit(size).cast("long").alias("n_template"), F.lit(row["licence"]).alias("licence")))
        return F.array(*found)

    scored = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", F.size("a").cast("long").alias("n_line"), let(F.col("a"), against).alias("found"))
    close = lambda x: 200 * x["n_shared"] >= t * (F.col("n_line") + x["n_template"])
    scored = scored.withColumn("found", F.filter("found", close)).where(F.size("found") > 0)
    score = lambda x: 2.0 * x["n_shared"] / (F.col("n_line") + x["n_template"])
    ranked = F.transform("found", lambda x: F.struct((-score(x)).alias("minus"), x["licence"].alias("licence"), x["n_shared"].alias("n_shared"), x["n_template"].alias("n_template")))
    return scored.withColumn("best", F.array_min(ranked)).select("doc_id", "line_no", "line", "best.licence", "best.n_shared", "n_line", "best.n_template", (-F.col("best.minus")).alias("dice"))


def _chosen_anchors(known: list, t: int) -> list[str]:
    """Few words such that every window within reach of a template has one: those that stand in most bigrams go first."""
    left = {r["licence"]: list(r["b"]) for r in known}
    chosen: list[str] = []
    while open_ := {n: b for n, b in left.items() if (200 - t) * len(b) >= t * len(dict((r["licence"], r["b"]) for r in known)[n])}:
        weight: dict[str, float] = {}
        for b in open_.values():
            for x in b:
                for w in set(x.split(" ")):
                    if len(w) > 3:
                        weight[w] = weight.get(w, 0.0) + len(w) ** 2 / len(b)
        chosen.append(max(sorted(weight), key=weight.get) if weight else max(x.split(" ")[0] for b in open_.values() for x in b))
        left = {n: [x for x in b if chosen[-1] not in x.split(" ")] for n, b in left.items()}
    return sorted(chosen)


def _met_before(xs: Column | str) -> Column:
    """Of every element the place at which it was met before, else -1."""
    keyed = F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    last = lambda s: F.transform(s, lambda y, k: F.struct(y["i"].alias("i"), F.when((k > 0) & F.get(s, k - 1)["x"].eqNullSafe(y["x"]), F.get(s, k - 1)["i"]).otherwise(-1).alias("last")))
    return F.transform(F.array_sort(let(keyed, last)), lambda y: y["last"])


def _apart(found: Column, n_words: Column, widest: int) -> Column:
    """Of sorted windows those that overlap none kept before; kept ones lie in blocks of the widest window, so few are compared."""
    none = F.array().cast(_FOUND)
    blocks = F.array_repeat(none, F.floor(n_words / widest).cast("int") + 2)
    block = lambda p: F.floor(p / widest).cast("int")
    clash = lambda held, x: F.exists(held, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]))
    near = lambda kept, x: [F.coalesce(F.get(kept, block(x["first"]) + d), none) for d in (-1, 0, 1)]
    free = lambda kept, x: ~reduce(or_, (clash(held, x) for held in near(kept, x)))
    put = lambda kept, x: F.transform(kept, lambda held, i: F.when(i == block(x["first"]), F.concat(held, F.array(x))).otherwise(held))
    return F.aggregate(found, blocks, lambda kept, x: F.when(free(kept, x), put(kept, x)).otherwise(kept), F.flatten)


def passages(docs: DataFrame, min_percent: int = 80, templates: dict[str, str] = PASSAGES) -> DataFrame:
    """doc_id, line_no (where it begins, from 0), first_word, n_words, licence, n_shared, n_window, n_template, dice of the passages of whole texts.

    Passages of a document don't overlap: the highest score goes first, then more shared bigrams, the first name and place.
    """
    t = min_percent
    known = _known(docs, templates)
    every = sorted({b for r in known for b in r["b"]})
    anchors = _chosen_anchors(known, t)
    whole = "|".join(w for w in anchors if len(w) <= 3)  # as whole words, since they stand in many others

    def near(low: Column) -> Column:
        found = [F.contains(low, F.lit(w)) for w in anchors if len(w) > 3]
        return reduce(or_, found + [low.rlike(rf"(?<![\p{{L}}\p{{N}}])({whole})(?![\p{{L}}\p{{N}}])")] * bool(whole))

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """Adds a column that is worked out once: filters and other columns over a plain one would repeat it."""
        return df.withColumn(name, F.explode(F.array(value)))

    d = once(docs.select("doc_id", "text"), "low", F.lower("text")).where(near(F.col("low")))
    d = once(d.select("doc_id", "low"), "by_line", F.transform(F.split("low", "\n"), _words))
    d = once(d.select("doc_id", F.transform("by_line", F.size).alias("sizes"), "by_line"), "w", F.flatten("by_line")).drop("by_line").where(F.size("w") >= 2)
    d = once(d, "grams", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))).drop("w")  # the last is null
    d = once(d, "hits", F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("p"), g.alias("g"))), lambda x: x["g"].isin(every)))
    # shared bigrams that any window within reach of the smallest template has
    least = min(-(-t * len(r["b"]) // (200 - t)) for r in known)
    d = once(d, "met", F.array_distinct(F.transform("hits", lambda x: x["g"]))).where(F.size("met") >= least)

    def possible(row) -> Column:
        size = len(row["b"])
        need = -(-t * size // (200 - t))
        return F.struct(F.lit(row["licence"]).alias("licence"), F.array(*map(F.lit, row["b"])).alias("b"), F.lit(size).alias("size"), F.lit(need).alias("need"))

    rows = F.filter(F.array(*map(possible, known)), lambda r: F.size(F.array_intersect("met", r["b"])) >= r["need"])
    d = once(d, "near", rows).drop("met").where(F.size("near") > 0)

    d = once(d, "since", _met_before("grams"))

    def windows(r: Column) -> Column:
        reach = F.floor((200 - t) * r["size"] / t).cast("int")

        def of(h: Column, before: Column) -> Column:
            """h: the hits that are the template's, in order, before: where the same bigram was hit last."""
            at = lambda k: F.get(h, k)["p"]

            def ends(a: Column) -> Column:
                """The windows from hit a that score more than every shorter one."""
                first, start = at(a), F.lit(None).cast("double")

                def longer(s: Column, b: Column) -> Column:
                    # all bigrams since the last end, each new if it was met last before the window
                    step = F.slice("since", F.when(b > a, at(b - 1) + 2).otherwise(first + 1), F.when(b > a, at(b) - at(b - 1)).otherwise(1))
                    shared = s["shared"] + F.when(F.get(before, b) < a, 1).otherwise(0)
                    within = s["within"] + F.size(F.filter(step, lambda q: q < first))

                    def told(x: Column) -> Column:
                        better = (200 * x["shared"] >= t * (x["within"] + r["size"])) & (s["minus"].isNull() | (x["minus"] < s["minus"]) | ((x["minus"] == s["minus"]) & (-x["shared"] < s["less"])))
                        one = F.struct(x["minus"].alias("minus"), (-x["shared"]).alias("less"), b.alias("b"), x["within"].alias("within"))
                        keep = lambda new, old: F.when(better, new).otherwise(old)
                        return F.struct(x["shared"].alias("shared"), x["within"].alias("within"), keep(x["minus"], s["minus"]).alias("minus"), keep(-x["shared"], s["less"]).alias("less"), keep(F.concat(s["found"], F.array(one)), s["found"]).alias("found")).cast(_FOLD)

                    counted = let(F.struct(shared.alias("shared"), within.alias("within")), lambda c: F.struct(c["shared"].alias("shared"), c["within"].alias("within"), (-2.0 * c["shared"] / (c["within"] + r["size"])).alias("minus")))
                    return let(counted, told)

                near = F.filter(F.sequence(a, F.least(a + reach, F.size(h)) - 1), lambda b: at(b) - first < reach)
                empty = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("within"), start.alias("minus"), F.lit(None).cast("int").alias("less"), F.array().cast("array<struct<minus:double,less:int,b:int,within:int>>").alias("found")).cast(_FOLD)
                found = F.aggregate(near, empty, longer, lambda s: s["found"])
                return F.transform(found, lambda x: F.struct(x["minus"].alias("minus"), x["less"].alias("less"), r["licence"].alias("licence"), first.alias("first"), (at(x["b"]) + 1).alias("last"), x["within"].alias("within"), r["size"].alias("size")))

            starts = F.filter(F.sequence(F.lit(0), F.size(h) - r["need"]), lambda a: at(a + r["need"] - 1) - at(a) < reach)
            return F.flatten(F.transform(starts, ends)).cast(_FOUND)

        own = F.filter("hits", lambda x: F.array_contains(r["b"], x["g"]))
        none = F.array().cast(_FOUND)
        return let(own, lambda h: F.when(F.size(h) >= r["need"], let(_met_before(F.transform(h, lambda x: x["g"])), lambda before: of(h, before))).otherwise(none))

    d = once(d, "found", F.array_sort(F.flatten(F.transform("near", windows)))).select("doc_id", "sizes", "found").where(F.size("found") > 0)
    d = once(d, "kept", _apart(F.col("found"), F.aggregate("sizes", F.lit(0), lambda n, m: n + m), max(len(r["b"]) for r in known) * (200 - t) // t + 2))
    d = d.select("doc_id", "sizes", F.explode("kept").alias("x"))
    line = F.aggregate("sizes", F.struct(F.lit(0).alias("line"), F.lit(0).alias("words")), lambda a, n: F.struct((a["line"] + (a["words"] + n <= F.col("x.first")).cast("int")).alias("line"), (a["words"] + n).alias("words")))
    long = lambda c, name: c.cast("long").alias(name)
    x = lambda f: F.col(f"x.{f}")
    return d.select("doc_id", long(line["line"], "line_no"), long(x("first"), "first_word"), long(x("last") - x("first") + 1, "n_words"), x("licence").alias("licence"), long(-x("less"), "n_shared"), long(x("within"), "n_window"), long(x("size"), "n_template"), (-x("minus")).alias("dice"))
