"""License scanning by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import ascii_lower, cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and the public wording of licence notices.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

# Public licences as a whole, without their copyright lines.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
NOTICES += (
    ("mit", f"{NOTICES[2][1]}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("bsd", f"{NOTICES[9][1]}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("isc", f"{NOTICES[10][1]}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", f"{NOTICES[7][1]}, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)

#: Words of a gram, and how far two diagonals may lie apart to be one alignment with words put in or left out.
GRAM, GAP = 4, 8
#: Part of a template's grams that must be met.
LEAST = 0.5
#: Grams under which a template must be met in full.
SHORT = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def grams(sequence: Column, size: int) -> Column:
    """64-bit hashes of all runs of `size` words, by start."""

    def rolled(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))

    # the outer transform binds the words once; named twice, they would be split again for each gram
    return F.get(F.transform(F.array(sequence), rolled), F.lit(0))


def template_grams(spark: SparkSession, notices: tuple[tuple[str, str], ...], size: int) -> DataFrame:
    """(hash, template, label, place, grams): the grams of the notices; some hundreds of rows, whatever the corpus."""
    rows = [(i, label, notice, max(1, len(re.findall(WORD, notice.lower())) - size + 1)) for i, (label, notice) in enumerate(notices)]
    frame = spark.createDataFrame(rows, "template int, label string, notice string, grams int")
    return frame.select("template", "label", "grams", F.posexplode(grams(words(F.col("notice")), size)).alias("place", "hash"))


def known_grams(sequence: Column, templates: DataFrame, size: int = GRAM) -> Column:
    """(at, hash) of a document's rolling grams that any template has, by start: few of a text's grams leave its row."""
    hashes = [r["hash"] for r in templates.select("hash").distinct().collect()]  # some hundreds, whatever the corpus
    every = F.transform(grams(sequence, size), lambda h, i: F.struct(i.alias("at"), h.alias("hash")))
    return F.filter(every, lambda g: g["hash"].isin(hashes))


def find_notices(docs: DataFrame, least: float = LEAST, notices: tuple[tuple[str, str], ...] = NOTICES, size: int = GRAM, gap: int = GAP) -> DataFrame:
    """(doc_id, print, label, coverage, first_word, last_word) of notices found in docs (doc_id, text); print is the text's hash. See aligned."""
    templates = template_grams(docs.sparkSession, notices, size)
    met = docs.select("doc_id", F.xxhash64("text").alias("print"), known_grams(words(F.col("text")), templates, size).alias("met"))
    return aligned(met, templates, least, size, gap)


def aligned(docs: DataFrame, templates: DataFrame, least: float = LEAST, size: int = GRAM, gap: int = GAP) -> DataFrame:
    """Notices found from documents' grams (doc_id, print, met).

    The grams meet the templates' grams in a broadcast join (the templates are fixed
    and small). Each meeting votes for the diagonal start in the document minus place
    in the template. Diagonals of one template within `gap` of the next are merged; a
    merged span is verified: it must hold `least` of the template's grams at distinct
    places (all of a template of under SHORT grams, since short forms differ by a
    word), and be at most 1.5 times as long.
    """
    met = docs.select("doc_id", "print", F.explode("met").alias("g")).select("doc_id", "print", "g.at", "g.hash")
    met = met.join(F.broadcast(templates), "hash")
    votes = met.groupBy("doc_id", "print", "template", "label", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places")
    )
    order = W.partitionBy("doc_id", "print", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True)).cast("int")
    merged = votes.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    spans = merged.groupBy("doc_id", "print", "template", "label", "grams", "island").agg(
        F.min("low").alias("first_word"), (F.max("high") + size - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes")
    )
    length = F.col("last_word") - F.col("first_word") + 1
    needed = F.when(F.col("grams") < SHORT, 1.0).otherwise(least) * F.col("grams")
    verified = spans.filter((F.col("votes") >= needed) & (length <= 1.5 * (F.col("grams") + size - 1)))
    return verified.select("doc_id", "print", "label", (F.col("votes") / F.col("grams")).alias("coverage"), "first_word", "last_word")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: places of the base phrases, and the labels of phrases and notices.

    Words are runs of WORD after lower-casing A-Z, counted from 0. n_base counts
    all places of the base phrases; first_word and last_word are their least and
    greatest start, null if there is none. labels adds what diagonal voting finds.
    score is 1 with a base phrase, else the best coverage of a notice, else 0.

    A text is split into words once: what leaves that pass are counts, and the grams
    that a template has.

    Edge cases: null and empty texts have no words and empty labels; the whole text
    is read, however long; a table without rows gives none; rows that share a doc_id, or have none, are told apart by
    their texts; repeated rows repeat their result; other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
    none = F.array().cast("array<int>")

    def places(phrase: tuple[str, ...]) -> Column:
        # every phrase holds "license": a cheap exact test spares the other texts
        def here(i: Column) -> Column:
            out = F.get(w, i) == phrase[0]
            for j in range(1, len(phrase)):
                out = out & (F.get(w, i + j) == phrase[j])
            return F.coalesce(out, F.lit(False))

        return F.when(F.array_contains(w, "license"), F.filter(starts, here)).otherwise(none)

    base = rows.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("w"))
    templates = template_grams(docs.sparkSession, NOTICES, GRAM)
    base = cut(base.select("doc_id", "print", F.size(w).cast("long").alias("n_words"), *[places(phrase).alias(label) for label, phrase in PHRASES], known_grams(w, templates).alias("met")))
    found = aligned(base.filter(F.size("met") > 0), templates)
    every = F.concat(*[F.col(label) for label, _ in PHRASES])
    has = F.array_compact(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label, _ in PHRASES]))
    base = base.select(
        "doc_id", "print", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(has).alias("base")
    )
    found = found.groupBy("doc_id", "print").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    found = found.withColumnsRenamed({"doc_id": "__doc_id", "print": "__print"})
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("print") == F.col("__print")), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score")
    )
