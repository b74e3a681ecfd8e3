"""Licence scan: windows of a normalised text compared to licence templates by the Dice coefficient over word bigrams, in DataFrame functions alone.

A template is a notice, a standard header or a whole licence text.  A set of n different bigrams can
reach a coefficient t with a template of m only if t m / (2 - t) <= n <= m (2 - t) / t, and only if
they share t m / (2 - t) of them; a text that has fewer of a template's bigrams is not compared with
it.  For the others, every window of the template's number of words that begins with one of its
bigrams is compared, wherever it stands: in a line, over several, or in a long text.  Of the windows
that reach t the best is reported, then the best of those that do not overlap it, and so on; ties go
to the longer window, then to the earlier, then by name.  Licences of one family differ in a word or a
number out of many, which the coefficient hardly sees, so what tells them apart must agree besides: a
window has all of its template's bigrams with a version or a qualifying word (``lesser``, ``nc``), and no such
word that the template lacks.  All of it happens within a row: no join and
no shuffle.  Templates reach every task as constants; their size is checked.

Defined cases: a null text has no words; texts and templates without a bigram match nothing; notices
that repeat, and repeated rows, are reported each; texts of any length are scanned whole; an empty
table, or no templates, gives no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import WORD_BREAK, ascii_lower, let

# Notices, standard headers and short licences, in public use.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR '
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO '
    "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
#: Creative Commons licences: short forms, names, and versions with their names.
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CREATIVE_VERSIONS = {"4.0": " International", "3.0": " Unported", "2.5": "", "2.0": "", "1.0": ""}
_OLDER = {"GPL-1.0": ("General Public License", "1"), "LGPL-2.0": ("Library General Public License", "2"), "LGPL-2.1": ("Lesser General Public License", "2.1")}
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero General Public License")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in '
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License.", f"{_BSD} {_BSD_WARRANTY}"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.",
        f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", _GNU.format("General Public License").replace("version 3", "version 2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", _GNU.format("General Public License")),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser General Public License")),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        f"the Software. {_WARRANTY}",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    **{f"CC-{short}-{v}": (f"Licensed under CC {short} {v}.", f"This work is licensed under a Creative Commons {name} {v}{kind} License.") for short, name in _CREATIVE.items() for v, kind in _CREATIVE_VERSIONS.items()},
    **{key: (f"This work is licensed under the GNU {name}, version {v}.", f"Licensed under the GNU {name}, version {v}.", _GNU.format(name).replace("version 3", f"version {v}")) for key, (name, v) in _OLDER.items()},
}
#: Words that make another licence of one, and bigrams with these, with a version or with a number of clauses.
QUALIFIERS = "affero lesser library nc nd noncommercial noderivatives noderivs sa sharealike".split()
TELLING = rf"(^| )({'|'.join(QUALIFIERS)})( |$)|^(version|v|license|attribution|by|bsd) [0-9]+$|^[0-9]+ ([1-9][0-9]*|clause)$"
# End of fixed values.
THRESHOLD = 0.8
#: Bigrams of all templates that tasks get as constants at most.
MOST_BIGRAMS = 200_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), WORD_BREAK), ""), F.array().cast("array<string>"))


def template_table(spark: SparkSession) -> DataFrame:
    """(licence, text) of the templates that come with this module."""
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, texts in TEMPLATES.items() for text in texts])
    return spark.range(1).select(F.inline(rows))


def size_bounds(m: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """How many different bigrams a window has that can be like a template of ``m``: at least, and at most."""
    return math.ceil(threshold * m / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)


def bigram_codes(words: Column) -> Column:
    """A 64-bit hash of the words at each position and the next."""
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def _known(templates: DataFrame, threshold: float) -> list[dict]:
    rows = templates.where("licence is not null").select("licence", words_of(F.col("text")).alias("words"))
    pairs = F.transform("words", lambda w, i: F.struct(F.concat_ws(" ", w, F.get(F.col("words"), i + 1)).alias("pair"), F.xxhash64(w, F.get(F.col("words"), i + 1)).alias("code")))
    telling = F.transform(F.filter(F.slice(pairs, 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda p: p["pair"].rlike(TELLING)), lambda p: p["code"])
    qualified = F.array_intersect(F.array(*map(F.lit, QUALIFIERS)), F.col("words"))
    rows = rows.select("licence", F.size("words").alias("n"), F.array_sort(F.array_distinct(bigram_codes(F.col("words")))).alias("codes"), F.array_sort(F.array_distinct(telling)).alias("telling"), F.array_sort(qualified).alias("qualified")).where("size(codes) > 0").distinct()
    if rows.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] > MOST_BIGRAMS:
        raise ValueError(f"templates of over {MOST_BIGRAMS} bigrams do not fit into every task")
    return [{"name": r["licence"], "n": r["n"], "codes": r["codes"], "telling": r["telling"], "others": sorted(set(QUALIFIERS) - set(r["qualified"])), **dict(zip(("low", "high"), size_bounds(len(r["codes"]), threshold)))} for r in rows.orderBy("licence", "n", "codes").collect()]


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _bucketed(codes: Iterable[int]) -> Column:
    """A function of a code: whether it is one of ``codes``."""
    codes = set(codes)
    size = 1 << max(4, (2 * len(codes)).bit_length())
    slots: list[list[int]] = [[] for _ in range(size)]
    for c in sorted(codes):
        slots[c & size - 1].append(c)
    slots = _constant(slots, "array<array<bigint>>")
    return lambda code: F.array_contains(F.get(slots, code.bitwiseAND(F.lit(size - 1)).cast("int")), code)


def scanned(docs: DataFrame, text_col: str = "text", templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, first_word, n_words, licence, dice) for each licence that stands in a text; words count from 1.

    ``templates`` is a table (licence, text); without it the module's own are used.
    """
    rows = _known(template_table(docs.sparkSession) if templates is None else templates, threshold)
    if not rows:
        return docs.select(F.struct("*").alias("doc"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"), F.lit("").alias("licence"), F.lit(0.0).alias("dice")).where("false")
    known = _constant(rows, "array<struct<name:string,n:int,codes:array<bigint>,telling:array<bigint>,others:array<string>,low:int,high:int>>")
    in_any, fewest = _bucketed(c for r in rows for c in r["codes"]), min(r["low"] for r in rows)

    # Each value that is used more than once is bound by ``let``: a column would be computed anew inside the functions of arrays.
    window = "array<struct<minus:double,n:int,at:int,name:string>>"
    none = F.array().cast(window)

    def told(words: Column, codes: Column, t: Column, w: Column) -> Column:
        """What tells licences apart agrees in a window and its template."""
        n, at = -w["n"], w["at"] + 1
        has = F.size(F.array_intersect(F.slice(codes, at, n - 1), t["telling"])) == F.size(t["telling"])
        return has & ~F.arrays_overlap(F.slice(words, at, n), t["others"])

    def like(codes: Column, t: Column, h: Column) -> Column:
        """The window of a template's length that begins at a hit, as (minus dice, minus words, at, name)."""

        def compared(own: Column) -> Column:
            dice = 2.0 * F.size(F.array_intersect(own, t["codes"])) / (F.size(own) + F.size(t["codes"]))
            fits = (F.size(own) >= t["low"]) & (F.size(own) <= t["high"])
            return F.struct(F.when(fits, -dice).otherwise(0.0).alias("minus"), (-F.least(t["n"], F.size(codes) + 1 - h["at"])).alias("n"), h["at"].alias("at"), t["name"].alias("name"))

        return let(F.array_distinct(F.slice(codes, h["at"] + 1, t["n"] - 1)), compared)

    def alike(words: Column, codes: Column, hits: Column, own: Column) -> Column:
        """All windows that reach the threshold."""
        shares = F.filter(known, lambda t: (F.size(own) >= t["low"]) & (F.size(F.array_intersect(own, t["codes"])) >= t["low"]))

        def of_template(t: Column) -> Column:
            starts = F.filter(hits, lambda h: F.array_contains(t["codes"], h["code"]))
            near = F.filter(F.transform(starts, lambda h: like(codes, t, h)), lambda w: w["minus"] <= -threshold)
            return F.filter(near, lambda w: told(words, codes, t, w))

        return F.flatten(F.transform(shares, of_template)).cast(window)

    def apart(kept: Column, w: Column) -> Column:
        over = F.exists(kept, lambda k: (k["at"] < w["at"] - w["n"]) & (w["at"] < k["at"] - k["n"]))
        return F.when(over, kept).otherwise(F.concat(kept, F.array(w)))

    def best(words: Column, codes: Column, hits: Column) -> Column:
        found = let(F.array_distinct(F.transform(hits, lambda h: h["code"])), lambda own: F.aggregate(F.array_sort(alike(words, codes, hits, own)), none, apart))
        return F.when(F.size(hits) >= fewest, found)

    def of_codes(words: Column, codes: Column) -> Column:
        hits = F.array_compact(F.transform(codes, lambda c, i: F.when(in_any(c), F.struct(i.alias("at"), c.alias("code")))))
        return let(hits, lambda hits: best(words, codes, hits))

    windows = let(words_of(F.col(text_col)), lambda words: let(bigram_codes(words), lambda codes: of_codes(words, codes)))
    found = docs.select(F.struct("*").alias("doc"), F.explode(windows).alias("w"))
    return found.select("doc", (F.col("w.at") + 1).alias("first_word"), (-F.col("w.n")).alias("n_words"), F.col("w.name").alias("licence"), (-F.col("w.minus")).alias("dice"))
