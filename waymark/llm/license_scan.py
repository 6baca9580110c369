"""License scans: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only.

Templates and texts become lower-case words `[a-z0-9]+` and five-word shingles (a shorter template is one
shingle).  For each template length n, windows of n + s words start every s words (s is an eighth of n; long
templates of about one length share the largest n of them), so some window holds a whole occurrence and not
much else: at the containment asked for, its Jaccard similarity to the template is at least 0.4, and 24 bands
of one MinHash each miss it with a probability below 1e-5.  Only windows with an anchor word are hashed: so many of a
template's shingles have one that a window without can't hold the containment asked for.  A window and a template that meet in a band are then
compared on their shingles.

Defined results: null and empty texts have no licenses; repeated rows give a row each; a template without
words finds nothing; an empty table gives an empty result; of matches of one template in one text the
first start and the highest containment are reported; texts of any length are scanned whole; other columns
are dropped.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 24
#: Characters of all template shingles up to which the templates are broadcast.
BROADCAST_CHARS = 4 << 20
#: Words of a template from which on it shares its windows with templates of about its length.
SHARED_FROM = 60
# Public licence wording to find, as (license, text): short statements, notices and whole texts.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit-terms", "Released under the terms of the MIT License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd-3-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
]


def window_sizes(lengths: list[int]) -> dict[int, int]:
    """The window size for each template length: its own if short; long ones share the largest within half as much again."""
    out: dict[int, int] = {}
    for n in sorted(lengths, reverse=True):
        near = [s for s in out.values() if n >= SHARED_FROM and 2 * s <= 3 * n]
        out[n] = max(near, default=n)
    return out


def words_in(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def shingles_in(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}) if words else []


def anchors_of(templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> list[str]:
    """Words, long ones first, that no match can do without.

    A match holds `containment` of a template's shingles or more, so at least one of any larger set of them:
    the shingles with an anchor word must be more than the rest that may be missing.
    """
    chosen: list[str] = []
    for _, text in templates:
        shingles = shingles_in(words_in(text))
        may_lack = math.ceil(containment * len(shingles) - 1e-9) - 1
        while sum(not set(s.split()) & set(chosen) for s in shingles) > may_lack:
            left = [s for s in shingles if not set(s.split()) & set(chosen)]
            chosen.append(min({w for s in left for w in s.split()}, key=lambda w: (-min(len(w), 7), -sum(w in s.split() for s in left), w)))
    return sorted(chosen)


def _shingles(words: Column) -> Column:
    """The distinct shingles of an array of words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (SHINGLE - 1))), lambda k: F.array_join(F.slice(words, k, SHINGLE), " ")))


def _signature(shingles: Column, bands: int) -> Column:
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return let(hashed, lambda hs: F.array(*[F.array_min(F.transform(hs, lambda h: F.xxhash64(h, F.lit(b)))) for b in range(bands)]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, matches (array of license, containment, start word) for every row of docs."""
    spark = docs.sparkSession
    size_of = window_sizes([len(words) for _, text in templates if (words := words_in(text))])
    known = [(name, size_of[len(words)], shingles_in(words)) for name, text in templates if (words := words_in(text))]
    anchors = anchors_of(templates, containment)
    sizes = sorted({n for _, n, _ in known})
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = base.withColumn("words", F.when(F.col("text").rlike("(?i)(?:" + "|".join(anchors) + ")") if anchors else F.lit(False), F.filter(F.split(lower, "[^a-z0-9]+", -1), lambda w: w != "")))

    def starts(ws: Column, n: int) -> Column:
        """Starts of the windows for templates of n words that hold an anchor word."""
        step = max(1, n // 8)
        at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
        first = lambda p: F.ceil(F.greatest(p - (n + step - 1), F.lit(0)) / step).cast("int") * step
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(first(p), (p - p % step).cast("int"), F.lit(step)))))

    def windows(ws: Column) -> Column:
        return F.concat(*[_named(starts(ws, n), n) for n in sizes])

    if not sizes:
        return base.select("doc_id", F.expr("cast(array() as array<struct<license:string,containment:double,start:int>>)").alias("matches"))
    # every row goes on, with no window or with several: its number is made once and never again
    spans = found.select("row", "doc_id", "words", F.explode_outer(let(F.col("words"), windows)).alias("at"))
    length = F.col("at.size") + F.greatest(F.lit(1), F.floor(F.col("at.size") / 8).cast("int"))
    shingled = F.when(F.col("at").isNotNull(), let(F.slice("words", F.col("at.start") + 1, length), _shingles))
    spans = spans.select("row", "doc_id", F.col("at.size").alias("size"), F.col("at.start").alias("start"), shingled.alias("shingles"))
    banded = spans.select("row", "doc_id", "size", "start", "shingles", F.posexplode_outer(F.when(F.col("shingles").isNotNull(), _signature(F.col("shingles"), bands))).alias("band", "value"))
    template = spark.createDataFrame(known, "license string, size int, template array<string>")
    buckets = template.select("license", "size", "template", F.posexplode(_signature(F.col("template"), bands)).alias("band", "value"))
    if sum(len(x) for _, _, xs in known for x in xs) <= BROADCAST_CHARS:  # else Spark chooses the join
        buckets = F.broadcast(buckets)
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    met = banded.join(buckets, ["size", "band", "value"], "left").select("row", "doc_id", "start", "license", F.when(F.col("license").isNotNull(), share).alias("containment"))
    best = met.groupBy("row", "doc_id", F.when(F.col("containment") >= containment, F.col("license")).alias("license")).agg(F.max("containment").alias("containment"), F.min("start").alias("start"))
    return best.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("license").isNotNull(), F.struct("license", "containment", "start")))).alias("matches")).select("doc_id", "matches")


def _named(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("size"), i.cast("int").alias("start")))


def report(found: DataFrame) -> DataFrame:
    names = F.transform("matches", lambda m: m["license"])
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_min(F.transform("matches", lambda m: m["start"])), F.lit(-1)).alias("first_start"))
