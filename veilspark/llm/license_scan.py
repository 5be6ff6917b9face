"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Templates are cut into classes by length (8, 16, 32 ... words). For a class of up to L words,
windows of ``L + L / 4`` words begin every ``L / 4`` words, so any stretch of L words lies
whole in one of them. A window retrieves the templates of its class that share one of its
``bands`` minhashes (bands of one row). The number of bands follows from the smallest Jaccard
similarity that a matching window can have, so that a match is missed with a probability below
``miss``. Retrieved templates are verified: the window must hold at least ``share`` of the
template's distinct shingles.

A minhash of a window can only equal one of a template if the smallest shingle is common to
both; windows without any shingle of a template of their class are therefore never formed.

Where spans of several licences overlap by more than half of the shorter one, the one that has
the most shingles of its template in common is named, so that a notice that differs from another
in a word counts as itself, and a whole notice as more than its opening. Equal ones are all named.

Defined results: null and empty texts match nothing; a template without words never matches;
a template shorter than a shingle is one shingle of all its words. Repeated rows each get the
result of their text. Extra columns pass through; columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.shingle_postings import plain, postings, shingle_hashes, split_words
from veilspark.llm.storage import free_names, kept, small_side, text_key

SHINGLE = 5
RESULTS = ("licenses", "best", "spans")


@dataclass(frozen=True)
class Template:
    license: str
    text: str


# Public licence notices, by SPDX name.
NOTICES = (
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Licensed under the MIT License."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("Unlicense", "This is free and unencumbered software released into the public domain"),
)

_GNU = (
    ("GPL-1.0", "", "1"),
    ("GPL-2.0", "", "2"),
    ("GPL-3.0", "", "3"),
    ("LGPL-2.0", "Library ", "2"),
    ("LGPL-2.1", "Lesser ", "2.1"),
    ("LGPL-3.0", "Lesser ", "3"),
    ("AGPL-1.0", "Affero ", "1"),
    ("AGPL-3.0", "Affero ", "3"),
)
_GNU_FORMS = (
    "This work is licensed under the GNU {0}General Public License, version {1}.",
    "Licensed under the GNU {0}General Public License, version {1}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation",
)
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
FURTHER = (
    *(Template(name, form.format(kind, version)) for name, kind, version in _GNU for form in _GNU_FORMS),
    Template("BSD-2-Clause", _BSD_2 + _BSD_END),
    Template("BSD-3-Clause", f"{_BSD_2}3. {_BSD_NAMES}{_BSD_END}"),
    Template("BSD-3-Clause", _BSD_NAMES),
    Template("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    Template("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("MIT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    Template("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    Template("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    Template("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
)
"""More notices, among them some that differ from others in a word only; the SQL twin does not know these."""


def word_list(text: str) -> list[str]:
    """Words of a template, as the documents are split."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]


def length_class(n: int) -> int:
    return max(8, 1 << (n - 1).bit_length())


def class_bands(length: int, size: int, share: float, miss: float) -> int:
    """Bands of one row that miss a matching window with a probability below ``miss``."""
    window = length + length // 4 - size + 1
    shortest = 1 if length == 8 else length // 2 + 1
    sizes = [max(1, n - size + 1) for n in range(shortest, length + 1)] if size == SHINGLE else [1]
    jaccard = min(math.ceil(share * t) / (window + t - math.ceil(share * t)) for t in sizes)
    return math.ceil(math.log(miss) / math.log(1 - jaccard)) if jaccard < 1 else 1


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``(tid, license, class, size, shingles)`` of templates that have words; hashes as documents have them."""
    rows = [
        F.struct(
            F.lit(i).alias("tid"),
            F.lit(t.license).alias("license"),
            F.lit(length_class(len(w))).alias("class"),
            F.lit(min(len(w), SHINGLE)).alias("size"),
            F.array(*map(F.lit, w)).alias("words"),
        )
        for i, t in enumerate(templates)
        if (w := word_list(t.text))
    ]
    sizes = sorted({min(len(w), SHINGLE) for t in templates if (w := word_list(t.text))})
    table = spark.range(1).select(F.inline(F.array(*rows)))
    hashes = None
    for s in sizes:
        own = F.slice(shingle_hashes("words", s), 1, F.size("words") - s + 1)
        hashes = F.when(F.col("size") == s, own) if hashes is None else hashes.when(F.col("size") == s, own)
    return table.select("tid", "license", "class", "size", F.array_distinct(hashes).alias("shingles"))


def minhashes(shingles: str, bands: str, kind: str):
    """Keys of the bands of an array column of shingle hashes."""
    return F.expr(
        f"transform(sequence(1, {bands}), j -> xxhash64({kind}, j, array_min(transform({shingles}, h -> xxhash64(h, j)))))"
    )


def _outdone(x: Column, y: Column) -> Column:
    """Another licence has more in common with much the same stretch."""
    both = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
    shorter = F.least(x["end"] - x["start"], y["end"] - y["start"])
    return (x["license"] != y["license"]) & (y["common"] > x["common"]) & (2 * both > shorter)


def license_notices(
    docs: DataFrame, templates: Sequence[Template] = NOTICES, share: float = 0.75, miss: float = 1e-6
) -> DataFrame:
    """``docs`` without ``text``, with ``licenses`` (sorted names), ``best`` (largest containment) and ``spans``.

    ``spans`` are ``(start, end, license)`` in words of the text, end exclusive, sorted; a
    span inside a longer one of the same licence is left out.
    """
    docs = docs.drop(*RESULTS)
    k1, k2 = text_key(F.col("text"))
    none = F.array().cast("array<struct<start:int,end:int,license:string>>")
    if not any(word_list(t.text) for t in templates):
        return docs.drop("text").withColumns({"licenses": F.array().cast("array<string>"), "best": F.lit(0.0), "spans": none})
    table = kept(template_table(docs.sparkSession, templates), "license-templates")
    kinds = [(r[0], r[1]) for r in table.select("class", "size").distinct().orderBy("class", "size").collect()]
    classes = docs.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("class"),
                        F.lit(z).alias("size"),
                        F.lit(c + c // 4 - z + 1).alias("width"),
                        F.lit(c // 4).alias("step"),
                        F.lit(class_bands(c, z, share, miss)).alias("bands"),
                    )
                    for c, z in kinds
                ]
            )
        )
    )
    table = kept(table.join(F.broadcast(classes), ["class", "size"]), "license-classes")
    tiles = small_side(kept(table.select("class", "size", "width", "step", "bands", F.explode("shingles").alias("h")).distinct(), "license-shingles"), 64)
    found = postings(docs, tiles, "text", sorted({z for _, z in kinds}))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("width") + 1) / F.col("step"))).cast("int")
    last = F.floor(F.col("pos") / F.col("step")).cast("int")
    windows = (
        found.join(tiles, ["h", "size"])
        .select("k1", "k2", "class", "size", "width", "step", "bands", F.explode(F.sequence(first, last)).alias("at"))
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("class", "size", "width", "step", "bands", "at")).alias("windows"))
    )
    windows = kept(windows, "license-windows")
    rows = windows.agg(F.count("*"), F.sum(F.size("windows"))).first()
    small = rows[0] * 64 + (rows[1] or 0) * 48 <= 32 << 20
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    texts = texts.join(F.broadcast(windows) if small else windows, ["k1", "k2"])
    texts = texts.select("k1", "k2", "windows", split_words(plain(F.col("text"))).alias("words"))
    for z in sorted({z for _, z in kinds}):
        texts = texts.withColumn(f"h{z}", shingle_hashes("words", z))
    pieces = texts.drop("words").select("*", F.explode("windows").alias("w")).select("*", "w.*").withColumn("from", F.col("at") * F.col("step"))
    held = None
    for z in sorted({z for _, z in kinds}):
        own = F.slice(f"h{z}", F.col("from") + 1, F.greatest(F.lit(0), F.least(F.col("width"), F.size(f"h{z}") - z + 1 - F.col("from"))))
        held = F.when(F.col("size") == z, own) if held is None else held.when(F.col("size") == z, own)
    pieces = pieces.select("k1", "k2", "class", "from", "bands", held.alias("held")).filter("size(held) > 0")
    keyed = pieces.select("k1", "k2", "from", "held", F.explode(minhashes("held", "bands", "class")).alias("key"))
    filed = table.select("tid", "license", "size", "shingles", F.explode(minhashes("shingles", "bands", "class")).alias("key"))
    candidates = keyed.join(small_side(kept(filed, "license-bands"), 2000), "key")
    common = F.array_intersect("held", "shingles")
    inside = F.transform("held", lambda h: F.array_contains("shingles", h))
    matches = (
        candidates.withColumn("containment", F.size(common) / F.size("shingles"))
        .filter(F.col("containment") >= share)
        .select(
            "k1",
            "k2",
            "tid",
            "license",
            "containment",
            F.size(common).alias("common"),
            (F.col("from") + F.array_position(inside, True) - 1).cast("int").alias("start"),
            (F.col("from") + F.size("held") - F.array_position(F.reverse(inside), True) + F.col("size")).cast("int").alias("end"),
        )
        .distinct()
    )
    per_license = matches.groupBy("k1", "k2", "license").agg(
        F.collect_set(F.struct("common", "containment", "start", "end", "license")).alias("all"), F.max("containment").alias("most")
    )
    # A licence counts with its largest containment, also where that span lies inside a longer one.
    fields = ("start", "end", "license")
    settled = F.transform("all", lambda x: F.struct(x["common"].alias("common"), F.col("most").alias("containment"), *[x[c].alias(c) for c in fields]))
    per_license = per_license.withColumn("all", settled)
    largest = F.filter(
        "all",
        lambda x: ~F.exists("all", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["start"] != x["start"]) | (y["end"] != x["end"]))),
    )
    per_text = per_license.withColumn("all", largest).groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("all")), asc=False).alias("all"))
    named = F.aggregate("all", F.expr("slice(all, 1, 0)"), lambda taken, x: F.when(F.exists(taken, lambda y: _outdone(x, y)), taken).otherwise(F.concat(taken, F.array(x))))
    found_in = kept(
        per_text.withColumn("all", named).select(
            "k1",
            "k2",
            F.array_sort(F.array_distinct("all.license")).alias("licenses"),
            F.array_max("all.containment").alias("best"),
            F.array_sort(F.array_distinct(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["license"].alias("license"))))).alias("spans"),
        ),
        "license-matches",
    )
    n1, n2 = free_names(docs, "k1", "k2")
    side = found_in.withColumnsRenamed({"k1": n1, "k2": n2})
    return (
        docs.withColumns({n1: k1, n2: k2})
        .drop("text")
        .join(small_side(side, 1000), [n1, n2], "left")
        .withColumns(
            {
                "licenses": F.coalesce("licenses", F.array().cast("array<string>")),
                "best": F.coalesce("best", F.lit(0.0)),
                "spans": F.coalesce("spans", none),
            }
        )
        .drop(n1, n2)
    )
