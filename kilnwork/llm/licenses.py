"""Op 9: licence scan by MinHash bands over overlapping windows. DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five words, or all words of a
shorter template. For each template length n, windows of n words at a stride of about n / 8 are
banded: BANDS bands of ROWS rows. A region that contains 0.8 of a template has a window of Jaccard
similarity of about 0.5 or more, which collides in some band with a probability of at least
1 - (1 - 0.5 ** ROWS) ** BANDS > 0.9998. Each retrieved template is then held exactly against the
window and a stride beside it. Windows without any shingle of a template have similarity zero to
all, share no band and are not built; nor are those of a text without a template's anchor words,
chosen so that 0.8 of a template can't do without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import saved

SHINGLE, BANDS, ROWS = 5, 32, 2

#: Notices and short licence texts as they are commonly worded.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

#: Whole bodies, of the notices above and what stands between and after them.
TEMPLATES |= {
    "BSD-2-Clause": f"{TEMPLATES['BSD-clauses']} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {TEMPLATES['BSD-disclaimer']} IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT-body": f"{TEMPLATES['MIT-permission']} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {TEMPLATES['MIT-warranty']} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
_DISCLAIMER = TEMPLATES["BSD-disclaimer"]
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(_DISCLAIMER, f"3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}")


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words, size: int):
    """Hash of each run of ``size`` words; the array is bound once by the outer transform."""
    def inside(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, size), " ")))
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), inside)[0]


def _bands(shingles):
    """Hashes of BANDS bands, each of ROWS smallest hash values of the shingles."""
    def smallest(b, row):
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b * ROWS + row)))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *(smallest(b, r) for r in range(ROWS))))


def _anchor_words(words: list[str], size: int, least: float) -> set[str]:
    """Words such that any share of ``least`` of the distinct shingles has one of them in it; those
    of more runs and longer ones first. The share without any stays below ``least``."""
    open_runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    total, chosen = len(open_runs), set()
    while len(open_runs) >= least * total:
        best = max({w for r in open_runs for w in r}, key=lambda w: (min(len(w), 8), sum(w in r for r in open_runs), len(w), w))
        chosen.add(best)
        open_runs = {r for r in open_runs if best not in r}
    return chosen


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per doc_id and template found: doc_id, license, containment, first_word.

    containment: share of the template's distinct shingles in the matched stretch, at least
    ``least``; of several places the best one, then the first, counts, and first_word is where its
    window begins (in words from 0). A template whose best place overlaps that of one of higher
    containment is left out, as versions of a licence share most of their words. Null and empty texts
    match nothing; texts of any length are read whole. Each row is judged by its own text, whether
    its doc_id is null, repeated or neither; of rows with one doc_id (null too) that hold a template
    the best place is given. Extra columns are left out. An empty table, or one of
    no templates, gives an empty result. ``templates``: a small fixed set; with several of one
    wording each is reported.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, body string")
    known = known.withColumn("words", _words(F.col("body")))
    spelled = {r.license: r.words for r in known.collect() if r.words}  # the templates only
    sizes = {name: min(SHINGLE, len(w)) for name, w in spelled.items()}
    none = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word int")
    if not spelled:
        return none
    anchors = sorted(set().union(*(_anchor_words(w, sizes[name], least) for name, w in spelled.items())))

    # the templates' shingles and bands, by the same expressions as the texts'
    table = {}
    for k in sorted(set(sizes.values())):
        part = known.withColumn("sh", F.array_distinct(_shingles(F.col("words"), k))).select("license", "sh", _bands(F.col("sh")).alias("bands"))
        table |= {r.license: (r.sh, r.bands) for r in part.collect() if sizes.get(r.license) == k}
    banded = spark.createDataFrame([(name, len(spelled[name]), list(sh), b, h) for name, (sh, bands) in table.items() for b, h in enumerate(bands)], "license string, n int, template array<bigint>, band int, hash long")

    def has_anchor(low):
        maybe = F.lit(False)
        for a in anchors:
            maybe |= F.contains(low, F.lit(a))
        return maybe & low.rlike(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(anchors)})(?![\p{{L}}\p{{N}}])")

    # exists binds the lower-cased text, which a plain filter would compute for every anchor
    maybe = F.exists(F.array(F.lower(F.col("text").cast("string"))), has_anchor)
    lengths = sorted({len(w) for w in spelled.values()})
    shingle_sizes = sorted(set(sizes.values()))
    hashed = docs.filter(maybe).select("doc_id", F.monotonically_increasing_id().alias("_row"), *(_shingles(_words(F.col("text").cast("string")), k).alias(f"h{k}") for k in shingle_sizes))
    own = {k: sorted({x for name, (sh, _) in table.items() if sizes[name] == k for x in sh}) for k in shingle_sizes}
    touched = F.lit(False)
    for k in shingle_sizes:
        touched |= F.exists(f"h{k}", lambda x: x.isin(own[k]))
    hashed = saved(hashed.filter(touched), "shingles")

    windows = None
    for n in lengths:
        k = min(SHINGLE, n)
        stride, span = max(1, n // 8), n - k + 1
        mine = sorted({x for name, (sh, _) in table.items() if len(spelled[name]) == n for x in sh})
        h = F.col(f"h{k}")
        # windows on the grid that hold a shingle of one of these templates
        spots = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(mine))
        starts = F.array_distinct(F.flatten(F.transform(spots, lambda p: F.transform(F.sequence((F.greatest(p - span + 1, F.lit(0)) / stride).cast("int"), (p / stride).cast("int")), lambda g: g * stride))))
        rows = hashed.filter((F.size(h) > 0) & F.exists(h, lambda x: x.isin(mine))).select(
            "doc_id",
            "_row",
            F.lit(n).alias("n"),
            F.explode(
                F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_distinct(F.slice(h, s + 1, span)).alias("window"), F.slice(h, F.greatest(s - stride, F.lit(0)) + 1, span + 2 * stride).alias("region")))
            ).alias("w"),
        ).select("doc_id", "_row", "n", "w.*")
        windows = rows if windows is None else windows.union(rows)
    keyed = windows.select("doc_id", "_row", "n", "start", "region", F.posexplode(_bands(F.col("window"))).alias("band", "hash"))
    found = keyed.join(F.broadcast(banded), ["n", "band", "hash"])  # the templates' bands: fixed
    share = F.size(F.array_intersect("region", "template")) / F.size("template")
    matched = found.select("doc_id", "_row", "license", "n", "start", share.alias("containment")).filter(F.col("containment") >= least)
    best = matched.groupBy("_row", "license", "n").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("containment", (-F.col("start")).alias("at"))).alias("best"))
    placed = best.select("_row", "doc_id", F.struct("license", "best.containment", (-F.col("best.at")).cast("int").alias("first_word"), "n").alias("x"))
    listed = placed.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("x").alias("all"))  # at most one a template

    def beaten(x):
        return F.exists("all", lambda y: (y["containment"] > x["containment"]) & (y["first_word"] < x["first_word"] + x["n"]) & (x["first_word"] < y["first_word"] + y["n"]))

    found = listed.select("doc_id", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x"))
    best = found.groupBy("doc_id", "x.license").agg(F.max(F.struct("x.containment", (-F.col("x.first_word")).alias("at"))).alias("best"))
    return best.select("doc_id", "license", "best.containment", (-F.col("best.at")).alias("first_word"))
