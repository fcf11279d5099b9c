"""License scans: MinHash bands of text windows retrieve templates, containment verifies.

Text is lower-cased and split into runs of letters and digits; a shingle is the hash of five
of them. Windows of ``WINDOW`` shingles, each starting ``STRIDE`` after the last, are sketched
with ``BANDS`` MinHash functions, one row a band. A template's windows are sketched alike, at
every start, and a text window that shares a band with one retrieves the template. The text is cut in
stretches as long as a retrieved template; a stretch with such a window is verified once, by the
part of the template's shingles that it and the stretches beside it hold.

A window that lies wholly in a template's text has similarity 1 with one of its windows and
never misses. A template of so few shingles that all of them are needed has its first one as
a band of its own, of windows one shingle wide, and never misses either. A longer template
reaches the containment only if runs of its shingles are whole; a window that shares half of
its shingles with a template's misses all bands with probability 0.5 ** 16.

Built-in functions only. Windows meet templates by number; the texts of documents with a hit are
read once more. Templates of up to ``BROADCAST_SHINGLES`` shingles are broadcast, so only windows
that share a band ever leave their task; with more, every window's bands are shuffled. Edge cases: a null text or one of fewer
than five words matches nothing; repeated passages of a document count in ``passages``; rows
of one doc_id and text are one document, different texts under one doc_id (or none) are
documents of their own; a null doc_id is kept as such; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch

SHINGLE = 5
WINDOW, STRIDE, BANDS = 4, 2, 16
CONTAINMENT = 0.8
MASK = (1 << 31) - 1
#: A table of templates of up to this many shingles is broadcast; a larger one is joined by shuffles.
BROADCAST_SHINGLES = 50_000

# Public license notices and their SPDX identifiers.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of five words from each word on; empty for shorter texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))
    each = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(SHINGLE))))
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, each(w)).otherwise(F.array().cast("array<bigint>")))


def _sketch(w: str) -> list[Column]:
    """The least of a window's shingles under each function, ``(a * x + b) mod 2 ** 31`` with odd
    ``a``, and the function's number in the last five bits: the keys of the bands.

    Short arithmetic on purpose: the generated code stays small enough for the JVM to compile.
    """
    draw = random.Random(31)
    low = [F.coalesce(F.col(f"{w}.s{i}"), F.col(f"{w}.s0"), F.lit(0)).bitwiseAND(MASK) for i in range(WINDOW)]
    factors = [(draw.randrange(1, MASK, 2), draw.randrange(MASK)) for _ in range(BANDS)]
    return [F.shiftleft(F.least(*((x * F.lit(a).cast("long") + F.lit(b).cast("long")).bitwiseAND(MASK) for x in low)), 5).bitwiseOR(F.lit(k).cast("long")) for k, (a, b) in enumerate(factors)]


def _single(shingle: Column) -> Column:
    """The band of a window one shingle wide."""
    return F.shiftleft(shingle.bitwiseAND(MASK), 5).bitwiseOR(F.lit(BANDS).cast("long"))


def _windows(sh: Column, stride: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(sh), F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), *(F.get(sh, i - 1 + k).alias(f"s{k}") for k in range(WINDOW))))


def templates(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """``(license, sh, n)``: the distinct shingles of every template of ``texts(license, text)``."""
    if texts is None:
        texts = spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")
    df = texts.select("license", shingles(texts["text"]).alias("sh")).withColumn("n", F.size(F.array_distinct("sh")))
    return df.where("n > 0")


def scan_licenses(spark: SparkSession, docs: DataFrame, containment: float = CONTAINMENT, texts: DataFrame | None = None) -> DataFrame:
    """Per document and license found: doc_id, license, containment, at_word, passages, text_key.

    ``texts(license, text)`` are the templates, by default those above.
    """
    known = templates(spark, texts)
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = F.broadcast if total <= BROADCAST_SHINGLES else lambda df: df
    cut = known.select("license", "n", F.explode(_windows(F.col("sh"), 1)).alias("w"))
    short = known.where(F.col("n") - 1 < F.col("n") * containment).select("license", "n", _single(F.col("sh")[0]).alias("band"))
    bands = cut.select("license", "n", F.explode(F.array(*_sketch("w"))).alias("band")).union(short).distinct()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"), docs["text"].alias("text"))
    # explode_outer: for explode the optimizer would compute the array once more, to look for empty ones.
    each = rows.select("doc_id", "text_key", F.explode_outer(_let(shingles(F.col("text")), lambda x: _windows(x, STRIDE))).alias("w"))
    if total <= BROADCAST_SHINGLES:  # a band is only shared by a window that holds a shingle of a template
        low = [r.x for r in known.select(F.explode("sh").alias("x")).select(F.col("x").bitwiseAND(MASK).alias("x")).distinct().collect()]
        held = [F.coalesce(F.col(f"w.s{k}").bitwiseAND(MASK).isin(low), F.lit(False)) for k in range(WINDOW)]
        each = each.where(reduce(or_, held))
    singles = [_single(F.coalesce(F.col(f"w.s{k}"), F.lit(0))) for k in range(STRIDE)]
    sketched = each.select("doc_id", "text_key", F.col("w.at").alias("at"), F.explode_outer(F.array(*_sketch("w"), *singles)).alias("band"))
    # Only numbers of windows meet templates; a stretch as long as a template is verified once, however many of its windows do.
    width = F.col("n") + WINDOW
    met = sketched.join(near(bands), "band").groupBy("doc_id", "text_key", "license", "n", F.floor(F.col("at") / width).alias("stretch")).agg(F.min("at").alias("at"))
    lists = met.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_list(F.struct("license", "n", "stretch", "at")).alias("met"))
    lists = scratch.save(spark, lists, "licenses")  # its size decides whether texts must move to meet it
    one = rows.join(lists, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["text_key"] == F.col("key"))).select("doc_id", "text_key", shingles(F.col("text")).alias("all"), F.explode("met").alias("x"))
    around = F.slice("all", F.greatest((F.col("x.stretch") - 1) * (F.col("x.n") + WINDOW), F.lit(1)).cast("int"), (3 * (F.col("x.n") + WINDOW)).cast("int"))
    stretches = one.select("doc_id", "text_key", "x.license", "x.stretch", "x.at", around.alias("near"))
    part = F.size(F.array_intersect("near", "sh")) / F.col("n")
    checked = stretches.join(near(known), "license").withColumn("containment", part).where(F.col("containment") >= containment)
    out = checked.groupBy("doc_id", "text_key", "license").agg(F.max("containment").alias("containment"), (F.min("at") - 1).cast("long").alias("at_word"), F.count_distinct("stretch").alias("passages"))
    return out.select("doc_id", "license", "containment", "at_word", "passages", "text_key")
