"""Operator 1, license scans, in DataFrame functions only.

Texts are read as lower-case runs of a-z and 0-9 in 5-word shingles. Templates are put into classes by size, powers of two. For a
class of up to L shingles, windows of L + max(1, L / 4) shingles start every max(1, L / 4), so an occurrence lies whole in one of
them. Each window gets one MinHash value a band; the number of bands follows from the smallest Jaccard similarity that a match of
the needed containment can have with its window, so that a match collides with probability 1 - MISS at least. Windows that collide
with a template are verified by exact containment of its shingles.

A template of fewer than K words is one shingle, its whole sequence of words. A window of one shingle has that shingle's hash as its
MinHash in every band, so such templates are met by equal shingles.

A band can only collide if window and template share the shingle with the smallest hash, so windows without any shingle of any
template are left out before their MinHash is computed; this loses nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm._work import shared_dir

K = 5
CONTAINMENT = 0.8
MISS = 1e-6
CHUNK = 2048

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Notices of common licenses, as they are published.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "apache-line", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "apache-grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "apache-spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "mit-line", "Released under the MIT License"),
    ("MIT", "mit-licensed", "Licensed under the MIT License"),
    ("MIT", "mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MIT", "mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "mit-as-is", _AS_IS),
    ("MIT", "mit-spdx", "SPDX-License-Identifier: MIT"),
    ("MIT", "mit-name", "MIT License"),
    ("BSD", "bsd-clauses", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "bsd3-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "bsd-as-is", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "bsd2-spdx", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "bsd3-spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("GPL-3.0", "gpl3-line", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0+", "gpl-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPL", "lgpl-header", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "agpl-header", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "mpl2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "epl2-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "boost-line", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "zlib-grant", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("CC-BY-NC-4.0", "cc-by-nc-line", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "cc-by-line", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc-by-sa-line", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-3.0", "cc-by-sa-3-line", "Licensed under CC BY-SA 3.0"),
    ("CC-BY-4.0", "cc-by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "cc0-work", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "all-rights", "All rights reserved"),
)


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_table(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """license, template, k (words of a shingle: fewer in shorter templates), n (shingles), shingles; one row a template."""
    if not all(_words(x) for _, _, x in templates):
        raise ValueError("templates without words")
    rows = spark.createDataFrame([(a, b, w, min(k, len(w))) for a, b, x in templates for w in [_words(x)]], "license string, template string, w array<string>, k int")

    def grams(m: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: shingle(F.col("w"), i, m))

    got = F.array().cast("array<bigint>")
    for m in range(1, k + 1):
        got = F.when(F.col("k") == m, grams(m)).otherwise(got)
    return rows.select("license", "template", "k", F.array_distinct(got).alias("shingles")).withColumn("n", F.size("shingles"))


def shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def bands_of(shingles: Column, bands: int) -> Column:
    """(band, value): the smallest hash of the shingles, for each band's hash function."""

    def least(b: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(bands)])


def classes(sizes: list[int], containment: float = CONTAINMENT, miss: float = MISS) -> list[tuple[int, int, int, int]]:
    """(L, window, stride, bands) of each class of template sizes."""
    out = []
    for top in sorted({1 << math.ceil(math.log2(n)) for n in sizes}):
        stride = max(1, top // 4)
        window = top + stride
        own = [n for n in sizes if 1 << math.ceil(math.log2(n)) == top]
        least = min((need := math.ceil(containment * n - 1e-9)) / (window + n - need) for n in own)
        out.append((top, window, stride, max(1, math.ceil(math.log(miss) / math.log(1 - least))) if least < 1 else 1))
    return out


def bands_by_class(shingles: Column, sizes) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<struct<band:int,value:bigint>>"))
    for top, _, _, bands in sizes:
        out = out.when(F.col("top") == top, bands_of(shingles, bands))
    return out


def windows(top: int, window: int, stride: int, k: int, hits: str = "hits") -> Column:
    """The windows of a class, as shingle ranges of w, that hold one of hits; window number x starts at x * stride."""

    def over(h: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((h - window + 1) / F.lit(stride))).cast("int"), F.floor(h / F.lit(stride)).cast("int"))

    def span(x: Column) -> Column:
        return F.struct(F.lit(top).alias("top"), (x * stride).alias("start"), F.least(x * stride + window, F.size("w") - (k - 1)).alias("end"))

    return F.transform(F.array_distinct(F.flatten(F.transform(hits, over))), span)


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS, k: int = K) -> DataFrame:
    """doc_id, license, template, containment (of the best window), n_windows that match, word_start of the first: one row for each
    doc_id and template found in a text.

    Texts that are null or empty match nothing, those of fewer than k words only templates as short. Repeated rows count once for each
    doc_id; rows without doc_id come together under null. Empty table: no rows. Very long texts are cut into chunks that overlap by
    the longest window. Other columns are not read. The templates are parameters of the program, so their tables have a fixed size
    and are broadcast.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    t = template_table(spark, templates, k)
    known = [(r["k"], r["n"], r["shingles"]) for r in t.collect()]
    sizes = classes([n for m, n, _ in known if m == k], containment, miss)
    lap = max([k, *(w + s + k for _, w, s, _ in sizes)])
    words = docs.where("text is not null").select("doc_id", F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "").alias("w"))
    chunks = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHUNK)), lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, CHUNK + lap).alias("w")))
    chunk = words.select("doc_id", F.explode(F.when(F.size("w") > 0, chunks)).alias("c")).select("doc_id", "c.at", "c.w")

    def hits(m: int) -> Column:
        """Where a shingle of m words is one of a template; looked for only in texts with the longest word of one of them."""
        wanted = sorted({s for l_, _, x in known if l_ == m for s in x})
        at = F.when(F.size("w") >= m, F.filter(F.sequence(F.lit(0), F.size("w") - m), lambda i: shingle(F.col("w"), i, m).isin(wanted))).otherwise(F.array().cast("array<int>"))
        if m == k:
            return at
        rare = sorted({max(w, key=len) for _, _, x in templates for w in [_words(x)] if len(w) == m})
        return F.when(F.exists("w", lambda x: x.isin(rare)), at).otherwise(F.array().cast("array<int>"))

    # Short templates are classes of their own, of windows of one shingle, so all templates are looked for in one scan.
    lengths = sorted({m for m, _, _ in known})
    kinds = [(m, (-m, 1, 1, 1)) for m in lengths if m < k] + [(k, x) for x in sizes]
    found = chunk.select("*", *[hits(m).alias(f"hits_{m}") for m in lengths]).where(" or ".join(f"size(hits_{m}) > 0" for m in lengths))
    wins = found.select("doc_id", "at", "w", F.explode(F.flatten(F.array(*[windows(*x[:3], m, f"hits_{m}") for m, x in kinds]))).alias("s"))

    def inside(m: int) -> Column:
        return F.array_distinct(F.transform(F.sequence("s.start", F.col("s.end") - 1), lambda i: shingle(F.col("w"), i, m)))

    made = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for m in lengths:
        made = made.when(F.col("s.top") == -m if m < k else F.col("s.top") > 0, inside(m))
    wins = wins.select("doc_id", "s.top", (F.col("at") + F.col("s.start")).alias("word_start"), made.alias("set"))
    bands = [x for _, x in kinds]
    wins = wins.select("doc_id", "top", "word_start", "set", F.explode(bands_by_class(F.col("set"), bands)).alias("b")).select("doc_id", "top", "word_start", "set", "b.*")
    own = t.withColumn("top", F.when(F.col("k") < k, -F.col("k")).otherwise(F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")))
    own = own.select("license", "template", "n", "shingles", "top", F.explode(bands_by_class(F.col("shingles"), bands)).alias("b")).select("license", "template", "n", "shingles", "top", "b.*")
    pairs = wins.join(F.broadcast(own), ["top", "band", "value"])
    pairs = pairs.withColumn("share", F.size(F.array_intersect("set", "shingles")) / F.col("n")).where(F.col("share") >= containment - 1e-12)
    one = pairs.groupBy("doc_id", "license", "template", "word_start").agg(F.max("share").alias("share"))
    return one.groupBy("doc_id", "license", "template").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("word_start").cast("long").alias("word_start"))
