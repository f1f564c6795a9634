"""Licence scan: Dice coefficient over word bigrams of spans, with size bounds. DataFrame functions only.

Texts and templates are normalised alike: lower case, words are runs of letters and digits. A template of ``n`` bigrams is
compared with spans of ``n`` bigrams (fewer where the text ends) anywhere in a text, so a licence is found whatever stands before and
after it, in its line or beyond. With bags of ``a`` and ``b`` bigrams and ``s`` of them shared, Dice is ``2 s / (a + b)``.

The text's bigrams that a template holds are its hits, found by a join with the templates' bigrams, broadcast in
blocks of at most ``BLOCK`` rows (by hash). Dice can reach ``t`` only with ``s >= t (a + b) / 2``, which bounds sizes twice: a text
meets only templates that its length and its number of hits allow, and a span is looked at only if it opens with
a hit and holds hits enough, counted by a window over the hits. (A span that opens with no hit is no
better than the next one.) Bags are then compared exactly. Of spans of one template that overlap, the best counts; of
the spans left, one is dropped where another that shares more bigrams overlaps it.

Defined cases: null and empty texts, and texts or templates of fewer than two words, match nothing; a null id is kept as a
group of its own; rows that repeat an id and a span are reported once; ties go to the higher Dice, then the first licence name, then the
smallest start; very long texts are scanned whole; empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge.session import materialize

BLOCK = 500_000

UNIT = 1 << 30  # the length of a template, in whole-number places that one window frame fits
PLACES = 256  # words of a block in which spans of several templates are compared

# ---- fixed values: licence names of the SPDX tags looked for ----
TAGS = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]

# ---- fixed values: common licence notices, standard headers and full texts ----
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. " + BSD_DISCLAIMER,
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    *[(tag, f"SPDX-License-Identifier: {tag}") for tag in TAGS],
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))


def scan_licenses(docs: DataFrame, known: DataFrame, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, n_words, license, shared, dice``: the licences of each text with the words they span (``start`` from 0)."""
    known = known.select("license", bigrams(words(F.col("text"))).alias("b")).where(F.size("b") > 0).distinct()
    known = known.withColumn("template", F.xxhash64("license", "b")).withColumn("n_t", F.size("b"))
    n_grams = known.agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
    parts = known.select("license", "template", "n_t", F.explode("b").alias("g"))
    parts = parts.groupBy("license", "template", "n_t", "g").agg(F.count(F.lit(1)).alias("c_t"))
    enough = lambda s, a: s >= F.lit(dice / 2) * (a + F.col("n_t")) - 1e-9

    # hits: row, p and gram of the bigrams that a template holds, where the text's length allows it
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    grams = texts.select("id", "row", (F.size("w") - 1).alias("n_d"), F.posexplode(bigrams(F.col("w"))).alias("p", "gram"))
    blocks, hits = max(1, math.ceil(n_grams / BLOCK)), None
    for block in range(blocks):
        part = parts.where(F.pmod("g", F.lit(blocks)) == block)
        met = grams.join(F.broadcast(part), (F.col("gram") == F.col("g")) & enough(F.least("n_d", "n_t"), F.least("n_d", "n_t"))).drop("g")
        hits = met if hits is None else hits.unionByName(met)
    # spans that open with a hit and hold enough of them; places in units of the template's length, so that one frame fits all
    of = ["row", "template"]
    ahead = W.partitionBy(*of).orderBy("x").rangeBetween(0, UNIT - 1)
    block_of = F.expr(f"x div {UNIT}L")
    hits = hits.withColumn("x", F.expr(f"(p * {UNIT}L) div n_t")).withColumn("held", F.count(F.lit(1)).over(ahead))
    hits = materialize(hits, "licence-hits")  # read twice below: texts are read once, and rows keep their numbers
    size = F.least("n_t", F.col("n_d") - F.col("p"))
    spans = hits.withColumn("n_s", size).where(enough(F.col("held"), F.col("n_s"))).select("id", *of, "license", "n_t", F.col("p").alias("s"), "n_s", "x")
    # their bags, span and hits brought together by blocks of the template's length
    near = spans.select("row", "template", "s", "n_s", F.explode(F.array(block_of, block_of + 1)).alias("block"))
    inside = near.join(hits.select("row", "template", block_of.alias("block"), "p", "gram", "c_t"), [*of, "block"])
    inside = inside.where(F.col("p").between(F.col("s"), F.col("s") + F.col("n_s") - 1))
    bags = inside.groupBy(*of, "s", "gram", "c_t").agg(F.count(F.lit(1)).alias("c_s"))
    bags = bags.groupBy(*of, "s").agg(F.sum(F.least("c_s", "c_t")).alias("shared"))
    scored = spans.join(bags, [*of, "s"]).withColumn("dice", F.lit(2) * F.col("shared") / (F.col("n_s") + F.col("n_t"))).where(enough(F.col("shared"), F.col("n_s")))
    # the best of overlapping spans of one template, then of several
    around = W.partitionBy(*of).orderBy("x").rangeBetween(1 - UNIT, UNIT - 1)
    best = F.max(F.struct("dice", (-F.col("s")).alias("o"))).over(around)
    single = scored.withColumn("best", best).where((F.col("best.dice") == F.col("dice")) & (F.col("best.o") == -F.col("s"))).drop("best", "x")
    single = materialize(single, "licence-spans")
    order = F.struct((-F.col("shared")).alias("a"), (-F.col("dice")).alias("b"), "license", "s", "template").alias("order")
    # a span of n bigrams covers n + 1 words
    placed = single.withColumn("order", order).withColumn("place", F.explode(F.sequence(F.floor(F.col("s") / PLACES), F.floor((F.col("s") + F.col("n_s")) / PLACES))))
    other = placed.select("row", "place", F.col("s").alias("s2"), F.col("n_s").alias("n2"), F.col("template").alias("t2"), F.col("order").alias("order2"))
    meet = (F.col("s2") <= F.col("s") + F.col("n_s")) & (F.col("s") <= F.col("s2") + F.col("n2"))
    worse = placed.join(other, ["row", "place"]).where((F.col("t2") != F.col("template")) & meet & (F.col("order2") < F.col("order")))
    kept = single.join(worse.select(*of, "s").distinct(), [*of, "s"], "left_anti")
    return kept.select(F.col("id").alias(id_col), F.col("s").alias("start"), (F.col("n_s") + 1).alias("n_words"), "license", "shared", "dice").distinct()
