"""License scans by diagonal voting.

Every run of K words of every text is hashed and joined to the positions of the same run in the templates, by its hash and its words. Matches vote
for a diagonal, the offset between document and template; votes are gathered by diagonal, neighbouring diagonals (a few words put in or left out) are merged as
long as the template goes on (where it starts again, another span begins), and a merged span is verified: it must hold enough
of the template's positions, each counted once, within little more than the template's length.

Besides, the base phrases are looked for word by word. DataFrame functions only; the templates are a constant of this module or a list given, so broadcasting them is
bounded by its size, and nothing of the texts is shuffled but matches. Templates are notices and paragraphs of licenses: each is found by itself, so a
whole license is found by any of its paragraphs. Longer lists can be given.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals this far apart still belong together.
SHIFT = 4
#: Share of a template's runs that a span must hold.
COVERAGE = 0.6
#: Times the template's words that a span may have.
STRETCH = 1.4

# Phrases of the base and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices and paragraphs of public licenses.
_AS_IS = "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "THIS SOFTWARE " + _AS_IS),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)

#: A run can only be one of a template's if its bit is set in a constant of 2**BITS bits.
BITS = 16
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _lowered(text: Column) -> Column:
    """A-Z in lower case. `lower` is faster and does no other letter to ASCII but these two."""
    odd = (F.instr(text, "\u212a") > 0) | (F.instr(text, "\u0130") > 0)
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _templates(docs: DataFrame, templates: tuple) -> tuple[DataFrame, Column]:
    """(hash, gram, template, label, of, length): the position `of` of every run of K words in every template; and the bitmap of the hashes as a constant."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = re.findall(r"[0-9a-z]+", text.lower())
        rows += [(t, label, i, len(w), *w[i : i + K]) for i in range(len(w) - K + 1)]
    names = [f"w{i}" for i in range(K)]
    df = docs.sparkSession.createDataFrame(rows, "template int, label string, of int, length int, " + ", ".join(f"{n} string" for n in names))
    df = df.select(F.xxhash64(*names).alias("hash"), F.concat_ws(" ", *names).alias("gram"), "template", "label", "of", "length")
    bits = [0] * (1 << (BITS - 6))
    for r in df.select("hash").collect():
        slot = r["hash"] & ((1 << BITS) - 1)
        bits[slot >> 6] |= 1 << (slot & 63)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    return df, F.from_json(F.lit(json.dumps(signed)), "array<bigint>")


def spans(rows: DataFrame, key: str, text: str, templates: tuple = TEMPLATES) -> DataFrame:
    """(key, label, template, start, end, coverage): verified spans of templates, word positions, end exclusive. Templates of fewer than K words are never found."""
    places, bits = _templates(rows, templates)
    grams = rows.select(key, F.array_remove(F.split(_lowered(F.col(text)), _GAP), "").alias("_w")).where(F.size("_w") >= K)
    here = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(K)])
    known = lambda h: F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(F.lit((1 << BITS) - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    grams = grams.withColumn("_g", F.transform(F.sequence(F.lit(0), F.size("_w") - K), here))
    grams = grams.withColumn("_at", F.filter(F.transform("_g", lambda h, i: F.when(known(h), i)), lambda i: i.isNotNull()))
    found = F.transform("_at", lambda i: F.struct(i.alias("pos"), F.get("_g", i).alias("hash"), F.array_join(F.slice("_w", i + 1, K), " ").alias("gram")))
    votes = grams.select(key, F.inline(found)).join(F.broadcast(places), ["hash", "gram"]).withColumn("diagonal", F.col("pos") - F.col("of"))
    lines = votes.groupBy(key, "template", "label", "length", "diagonal").agg(F.collect_list("of").alias("ofs"), F.min("of").alias("first"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    order = Window.partitionBy(key, "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT).cast("int")
    lines = lines.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("island", F.sum("fresh").over(order))
    going = Window.partitionBy(key, "template", "island").orderBy("start", "diagonal")
    again = (F.col("first") <= F.lag("first").over(going)).cast("int")
    lines = lines.withColumn("again", F.coalesce(again, F.lit(0))).withColumn("part", F.sum("again").over(going))
    merged = lines.groupBy(key, "template", "label", "length", "island", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ofs")))).alias("held"), F.min("start").alias("start"), (F.max("end") + K).alias("end"))
    merged = merged.withColumn("coverage", F.col("held") / (F.col("length") - K + 1))
    held = (F.col("coverage") >= COVERAGE) & (F.col("end") - F.col("start") <= STRETCH * F.col("length") + SHIFT)
    best = merged.where(held).select(key, "label", "template", "start", "end", "coverage")
    # of spans that overlap, those with the largest coverage stay: licenses share much of their wording
    along = Window.partitionBy(key).orderBy("start", "end", "template")
    apart = F.col("start") >= F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("_place", F.sum("_new").over(along))
    most = F.max("coverage").over(Window.partitionBy(key, "_place"))
    return best.withColumn("_most", most).where(F.col("coverage") >= F.col("_most")).drop("_new", "_place", "_most")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest coverage of a verified span, and at least 0.8 with a base phrase; 0 without either. Null and
    empty texts have no words. Rows that repeat are scanned apart. `docs` must be the same when it is read again, as
    a scan of files is. Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    maybe = F.col("_text").rlike("(?i)license")
    base = rows.withColumn("n_words", F.regexp_count("_text", F.lit(_WORD)).cast("long")).withColumn("_w", F.when(maybe, _words(_lowered(F.col("_text")))).otherwise(F.array().cast("array<string>")))
    for phrase, label in PHRASES:
        base = base.withColumn(f"_{label}", _starts(F.col("_w"), phrase))
    at = [F.col(f"_{label}") for _, label in PHRASES]
    own = F.array_sort(F.array_compact(F.array(*[F.when(F.size(a) > 0, label) for a, (_, label) in zip(at, PHRASES, strict=True)])))
    base = base.select(
        "_row", "_id", "n_words",
        sum((F.size(a) for a in at[1:]), F.size(at[0])).cast("long").alias("n_base"),
        F.least(*[F.array_min(a) for a in at]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(a) for a in at]).cast("long").alias("last_word"),
        own.alias("_own"),
    )
    found = spans(rows, "_row", "_text", templates).groupBy("_row").agg(F.collect_set("label").alias("_found"), F.max("coverage").alias("_coverage"))
    out = base.join(found, "_row", "left")
    every = F.array_sort(F.array_union("_own", F.coalesce("_found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("_coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0))
    return out.select(F.col("_id").alias(id), "n_words", "n_base", "first_word", "last_word", F.array_join("_own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
