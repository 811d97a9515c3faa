"""Licence scan: MinHash bands over text windows find templates, exact containment confirms.

DataFrame and SQL functions only.  Words are the parts of the lower-cased
text between runs of ASCII signs and white space; a shingle is the 64-bit
hash of three consecutive words (notices have three to twenty words, hence
three and not five).

1. Templates are cut into parts of at most ``PART`` shingles.  A window is
   ``WINDOW`` consecutive shingles; windows start at every shingle of the
   text and of the parts.  Each of ``BANDS`` bands has ``ROWS`` MinHash values
   of a window, the least seeded hashes of its shingles.  A text window of
   similarity s to a template window shares a band with probability
   ``collision(s)`` = 1 - (1 - s^ROWS)^BANDS: 1 for equal windows, 0.68 where
   two of four shingles in all are common, 0.15 for one of five.  Whatever
   fifth of its shingles a part of three shingles or more has lost, three in a
   row are left, so one window is equal and found for certain; the exception
   is a part of five in two halves, with four windows of similarity 1/2: 0.99.
   (More bands make the scan's compiled method too long for the JIT compiler:
   five take seven times as long as four.)
   Parts of one or two shingles have windows of one shingle, whose only
   MinHash value is equal if and only if the shingle is.
2. A shingle of the part in a window found asks for its region: texts are laid
   out in tiles as long as the part, and a region is a tile with its two
   neighbours and ``slack`` shingles on both sides.  The distinct shingles of
   the part that occur in the region are counted exactly.  A template's containment is the sum of its
   parts' largest counts over the number of its shingles; ``containment`` or
   more is a match.

Result: a row for each document id and template matched: ``doc_id, license,
containment, first_word`` (place of the first word of the first shingle that
matched, from 0).

Edge cases: null and empty texts, and texts of fewer than three words, match
nothing; repeated rows, and all rows of one id, are one document; rows with a
null id are one document of that id; templates need three words or more; an
empty table of documents or templates gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import stored

# Short public licence notices, by SPDX-like name.
LICENSE_NOTICES = {
    "AGPL-3.0": "This program is free software licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Whole licence texts and file headers.
LICENSE_TEXTS = {
    "Apache-2.0-file-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        'of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the '
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        'language governing permissions and limitations under the License.'
    ),
    "BSD-2-Clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT '
        'SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, '
        'BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY '
        'THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS '
        'SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "BSD-3-Clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
        'promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR '
        'BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
        'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "GPL-3.0-file-header": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free '
        'Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be '
        'useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public '
        'License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see '
        'http://www.gnu.org/licenses/.'
    ),
    "ISC-text": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above '
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        'TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        'INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE '
        'OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        'deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
        'sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
        'copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
        'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
}
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, BANDS, ROWS, PART = 3, 4, 2, 32
CONTAINMENT, SLACK = 0.8, 4
#: Up to so many bands of template windows are literals of the scan's filter, up to so many are broadcast (50 bytes each); beyond, places are shuffled to them.
INLINE_MOST, BROADCAST_MOST = 40_000, 500_000


def collision(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that two windows of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _words(text: Column) -> Column:
    return F.split(F.lower(text), SIGNS)


def _shingles(words: str) -> Column:
    """Hashes of three words from each position; empty if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def band(k: int, window: list[Column]) -> Column:
    """Band ``k`` of a window of shingles: a hash of its MinHash values."""
    return F.xxhash64(F.lit(k), *[F.least(*[F.xxhash64(F.lit(1 + k * ROWS + r), x) for x in window]) for r in range(ROWS)])


def _single(x: Column) -> Column:
    """The one MinHash value of a window of one shingle, as band ``BANDS``."""
    return F.xxhash64(F.lit(BANDS), x)


def _at(array: str, place: Column) -> list[Column]:
    """The window at a place; at the end the last shingle stands again for those beyond."""
    return [F.get(array, F.least(place + i, F.size(array) - 1)) for i in range(WINDOW)]


def template_parts(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, part, seq`` (shingles in order), ``t`` (distinct ones), ``of`` (distinct ones of all parts, each part by itself); signs at the ends are left out."""
    rows = [(name, re.sub(rf"^{SIGNS}|{SIGNS}$", "", text.lower())) for name, text in templates.items()]
    out = spark.createDataFrame(rows, "license string, text string").withColumn("w", _words(F.col("text"))).filter(F.size("w") >= 3).select("license", _shingles("w").alias("all"))
    out = out.select("license", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(PART)), lambda i: F.slice("all", i + 1, PART))).alias("part", "seq")).withColumn("t", F.array_distinct("seq"))
    return out.join(out.groupBy("license").agg(F.sum(F.size("t")).alias("of")), "license")


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, *, containment: float = CONTAINMENT, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    known = template_parts(spark, LICENSE_NOTICES | LICENSE_TEXTS if templates is None else templates)
    starts = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("seq") - WINDOW)))
    windows = known.filter(F.size("seq") >= WINDOW).select("license", "part", "seq", starts.alias("_", "p"))
    keys = windows.select("license", "part", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), band(k, _at("seq", F.col("p"))).alias("m")) for k in range(BANDS)])).alias("b"))
    keys = keys.unionByName(known.filter(F.size("seq") < WINDOW).select("license", "part", F.explode("seq").alias("x")).select("license", "part", F.struct(F.lit(BANDS).alias("k"), _single(F.col("x")).alias("m")).alias("b")))
    known, keys = stored(spark, known, "parts", 1), stored(spark, keys.select("license", "part", "b.k", "b.m").distinct(), "bands", 1)
    n_keys = keys.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w"))
    texts = rows.filter(F.size("w") >= 3).select("doc_id", _shingles("w").alias("sh"))
    rows = texts.select("doc_id", "sh", F.explode(F.sequence(F.lit(0), F.size("sh") - 1)).alias("p"))
    values = [*(band(k, _at("sh", F.col("p"))) for k in range(BANDS)), _single(F.get("sh", F.col("p")))]
    if n_keys <= INLINE_MOST:
        sets: list[list[int]] = [[] for _ in values]
        for r in keys.select("k", "m").distinct().collect():
            sets[r["k"]].append(r["m"])
        hit = F.lit(False)
        for value, found in zip(values, sets):
            hit = hit | value.isin(sorted(found)) if found else hit
        rows = rows.filter(hit)
    bands_of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("m")) for k, v in enumerate(values)])).alias("b")
    reach = 2 * PART + slack
    if n_keys <= BROADCAST_MOST:
        # a window found takes along as many shingles around it as the longest part asks for, not the whole text
        first = F.greatest(F.lit(0), F.col("p") - reach)
        near = rows.select("doc_id", "p", first.alias("first"), F.slice("sh", first + 1, 2 * reach + WINDOW).alias("sh"), bands_of).select("doc_id", "p", "first", "sh", "b.k", "b.m")
        found = near.join(F.broadcast(keys), ["k", "m"]).join(F.broadcast(known), ["license", "part"])
    else:
        # only places and bands are shuffled; texts with a window found are met again by id
        places = rows.select("doc_id", "p", bands_of).select("doc_id", "p", "b.k", "b.m").join(keys, ["k", "m"]).select(F.col("doc_id").alias("_id"), "p", "license", "part").distinct()
        found = places.join(texts, F.col("_id").eqNullSafe(F.col("doc_id"))).drop("_id").withColumn("first", F.lit(0)).join(known, ["license", "part"])
    # the tiles of the window's first and last shingle that the part has
    size = F.size("seq")
    has = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda i: F.when(F.array_contains("t", F.get("sh", F.col("p") - F.col("first") + i)), F.floor((F.col("p") + i) / size)))
    found = found.withColumn("tile", F.explode(F.array_distinct(F.array(F.array_min(has), F.array_max(has))))).filter("tile is not null")
    start = F.greatest(F.lit(0), ((F.col("tile") - 1) * size).cast("int") - slack)
    end = ((F.col("tile") + 2) * size).cast("int") + slack
    found = found.select("doc_id", "license", "part", "of", "t", start.alias("start"), F.slice("sh", start - F.col("first") + 1, end - start).alias("region"))
    checked = found.select("doc_id", "license", "part", "of", F.size(F.array_intersect("region", "t")).alias("n"), (F.col("start") + F.array_position(F.transform("region", lambda x: F.array_contains("t", x)), True) - 1).cast("int").alias("first_word"))
    best = checked.filter("n > 0").groupBy("doc_id", "license", "of", "part").agg(F.max("n").alias("n"), F.min("first_word").alias("first_word"))
    return best.groupBy("doc_id", "license", "of").agg(F.sum("n").alias("n"), F.min("first_word").alias("first_word")).select("doc_id", "license", (F.col("n") / F.col("of")).alias("containment"), "first_word").filter(F.col("containment") >= containment)
