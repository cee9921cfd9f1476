"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Templates are license notices and whole license texts. Words are lower-cased runs of letters and
digits, shingles are five words. A template of L words belongs to the class of the least width W, a
power of two, with L <= W/2; windows of W words start every W/2 words, so an occurrence lies whole in one of them.

A window's set is its shingles that any template of its class has (no other shingle can
count for a match, and a window without one is no candidate). Its signature is the least value of
that set under each of a class's hash functions; each value is a band, and a template is retrieved by a window
that shares a band with it. Of a window that holds a match of a template, at least `least` of n shingles are
shared, and the union is at most what fits in the window and what it lacks: that bounds
the similarity J from below, also where other templates fill the rest, and a class has so many bands b
that (1 - J)^b, the chance that all of them differ, is at most `MISS`. Candidates are then verified:
a template matches where at least 80 % of its shingles are in the window's full set.

Everything is DataFrame functions. A document's shingles become rows and meet the table of the templates'
shingles in a join; only those that meet any go on, to one row a window. The templates' tables come from the driver and don't
depend on the documents; up to `BROADCAST_ROWS` rows they are broadcast, larger ones are joined by a shuffle.

Defined results: a null or empty text, or one with fewer than five words, matches nothing;
ids may be null or repeat (rows of one id and text share a result); a template found twice
in a document counts once; ties go by the template's name; extra columns are ignored. A template
needs five words; none is too long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm.common import table

SHINGLE = 5
CONTAINMENT = 80  # hundredths
NARROWEST = 16
# Chance that no band of a window and of a template that it holds agree, at the lowest similarity that a match can have.
MISS = 0.001
# Rows of some thirty bytes.
BROADCAST_ROWS = 1_000_000

# Notices as the licenses' authors give them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "reserved": "Copyright notice. All rights reserved. No part of this work may be reproduced without permission.",
    # Whole texts.
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a "
        "source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON- "
        "INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        "this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing "
        "it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS "
        "FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without "
        "fee, and without a written agreement is hereby granted, provided that the above copyright notice and this "
        "paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA "
        "BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST "
        "PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS "
        "BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS "
        "NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."),
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hash of the five words from each position."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(SHINGLE)])))


def width_of(words: int) -> int:
    """The class of a template of so many words."""
    return max(NARROWEST, 1 << (2 * words - 1).bit_length())


def least_similarity(n: int, width: int, known: int, containment: int = CONTAINMENT) -> float:
    """Lowest Jaccard similarity of a template of n shingles and a window of its class that holds a match,
    where the window's set are shingles of the class's `known` ones."""
    least = max(1, -(-containment * n // 100))
    held = min(width - SHINGLE + 1, known)
    return least / (max(held, least) + n - least)


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one value each of which at least one agrees with a chance of 1 - miss."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def signature(shingles: Column, bands: Column) -> Column:
    """The least value of a set under each of `bands` hash functions."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


class Templates:
    """Templates as tables: `shingles` (width, hash), `sets` (template, width, shingles) and `bands` (width, band, value, template).

    `settings`: for each width the number of bands.
    """

    def __init__(self, spark: SparkSession, texts: dict[str, str] = TEMPLATES, containment: int = CONTAINMENT, miss: float = MISS):
        rows = spark.createDataFrame(list(texts.items()), "template string, text string")
        rows = rows.select("template", words_of(F.col("text")).alias("words"))
        found = rows.select("template", F.size("words").alias("n"), F.array_distinct(shingle_hashes(F.col("words"))).alias("shingles")).collect()
        short = [r["template"] for r in found if r["n"] < SHINGLE]
        if short:
            raise ValueError(f"templates need {SHINGLE} words: {short}")
        sets = [(r["template"], width_of(r["n"]), r["shingles"]) for r in found]
        known: dict[int, set[int]] = {}
        for _, width, own in sets:
            known.setdefault(width, set()).update(own)
        self.settings: dict[int, int] = {}
        for _, width, own in sets:
            b = bands_for(least_similarity(len(own), width, len(known[width]), containment), miss)
            self.settings[width] = max(b, self.settings.get(width, 1))
        self.containment = containment
        one = [(w, h) for w, hs in known.items() for h in sorted(hs)]
        several = sum(self.settings[width] for _, width, _ in sets)
        plain = spark.createDataFrame(sets, "template string, width int, shingles array<long>")
        self.shingles = _sized(spark.createDataFrame(one, "width int, hash long"), len(one))
        self.sets = _sized(plain, sum(len(own) for *_, own in sets))
        self.bands = _sized(banded(plain, self.settings).select("width", "band", "value", "template"), several)


def _sized(rows: DataFrame, number: int) -> DataFrame:
    """`rows`, to be broadcast if their number (known to the driver) allows it."""
    return F.broadcast(rows) if number <= BROADCAST_ROWS else rows


def banded(rows: DataFrame, settings: dict[int, int]) -> DataFrame:
    """`rows` (width, shingles), one for each band of their class: band, value."""
    count = F.coalesce(*[F.when(F.col("width") == w, F.lit(b)) for w, b in settings.items()], F.lit(1))
    return rows.select("*", F.posexplode(signature(F.col("shingles"), count)).alias("band", "value"))


def windows(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, text_key, width, window and shingles (distinct) of every window that holds a known shingle."""
    # Each step is a column of its own: a lambda that holds an expression computes it for every element.
    rows = docs.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_key", F.posexplode(shingle_hashes(F.col("words"))).alias("at", "hash"))
    hits = rows.join(templates.shingles, "hash")
    step = F.col("width") / 2
    number = F.floor(F.col("at") / step).cast("int")
    # A window that starts one step earlier holds the shingle too, if it does not reach over its end.
    both = F.array(F.when(F.col("at") + SHINGLE <= number * step + F.col("width"), number),
                   F.when((number > 0) & (F.col("at") + SHINGLE <= (number - 1) * step + F.col("width")), number - 1))
    placed = hits.select("doc_id", "text_key", "width", "hash", F.explode(both).alias("window")).where("window is not null")
    return placed.groupBy("doc_id", "text_key", "width", "window").agg(F.collect_set("hash").alias("shingles"))


def matches(docs: DataFrame, templates: Templates) -> DataFrame:
    """doc_id, text_key, template, start (word from which its window counts) and share of its shingles."""
    found = banded(windows(docs, templates), templates.settings)
    candidates = found.join(templates.bands, ["width", "band", "value"]).groupBy("doc_id", "text_key", "width", "window", "template").agg(
        F.first("shingles").alias("found"))
    pairs = candidates.join(templates.sets, ["template", "width"])
    shared = F.size(F.array_intersect("shingles", "found"))
    good = pairs.select("*", shared.alias("shared")).where(100 * F.col("shared") >= templates.containment * F.size("shingles"))
    return good.groupBy("doc_id", "text_key", "template").agg(
        F.min(F.col("window") * (F.col("width") / 2).cast("int")).alias("start"),
        F.max(F.col("shared") / F.size("shingles")).alias("share"))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: Templates | None = None) -> DataFrame:
    """One row a document: n_templates and found (template, start, share by name)."""
    templates = templates or Templates(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    found = matches(rows, templates).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("template", "start", "share"))).alias("found"))
    found = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    out = rows.select("doc_id", "text_key").join(found, same, "left")
    none = F.array().cast("array<struct<template:string,start:int,share:double>>")
    out = out.select("doc_id", F.coalesce("found", none).alias("found"))
    return out.select("doc_id", F.size("found").cast("bigint").alias("n_templates"), "found")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_templates", F.array_join("found.template", ",").alias("templates"),
                        F.coalesce(F.array_min("found.start"), F.lit(-1)).cast("bigint").alias("first_window"))
