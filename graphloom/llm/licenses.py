"""License scan by diagonal voting.

Rolling hashes of k words of every document are joined in Spark with the positions of the
same hashes in license templates. Hits with the same document, template and offset (diagonal)
are votes for one occurrence; neighbouring diagonals are merged, so that an inserted or missing
word does not split it, and the merged span is verified by the share of the template it covers and by
the version: where a template names one, so must the text, in or closely after a gram of the span.

The templates are fixed text, so the broadcast side has a fixed size.

Defined cases: a null or empty text has no words, no labels and score 0; texts shorter than k
words get base labels only; rows that share id and text get the same result each; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx

# Phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices by which licenses are usually named.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2.0": "this work is licensed under the gnu general public license version 2",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
}

# Long texts, without copyright lines and the numbers of lists: MIT, ISC, BSD 2 and zlib whole, BSL and Unlicense without their disclaimers,
# the third clause of BSD 3, and the long notices of Apache and GPL (without its version). A text that another holds is found with it.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.""",
}

K = 3
#: Offsets up to so far apart are one occurrence.
NEAR_DIAGONALS = 3
#: Share of a template's k-grams that a span must have.
MIN_COVER = 0.6
#: Words after a gram within which a version belongs to it.
AFTER = 4
#: The versions of templates (their first numerals); a version's bit stands in the low bits of grams.
VERSIONS = sorted({w for t in (TEMPLATES | TEXTS).values() for w in re.findall(r"\d+", t)[:1]})
GRAM_BITS = -(1 << len(VERSIONS))


def _hashes(text: str) -> np.ndarray:
    raw = tx.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends, _ = tx.spans(raw, np.array([0, len(raw)]), tx.ALNUM)
    return tx.word_hashes(raw, starts, ends)


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(gram, template, t_pos, t_size, version): where each k-gram stands in the templates, and their versions' bits."""
    version = {name: sum(1 << VERSIONS.index(w) for w in re.findall(r"\d+", words)[:1]) for name, words in (TEMPLATES | TEXTS).items()}
    rows = [(int(h) & GRAM_BITS, name, i, len(g), version[name]) for name, words in (TEMPLATES | TEXTS).items() for g in [tx.grams(_hashes(words), k).view(np.int64)] for i, h in enumerate(g)]
    return spark.createDataFrame(rows, "gram long, template string, t_pos int, t_size int, version long")


def _near_versions(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word, the bits of the versions within the k-gram from it on or ``AFTER`` words more of its text."""
    near = np.zeros(len(h), np.int64)
    for i, version in enumerate(VERSIONS):
        at = np.flatnonzero(np.isin(h, _hashes(f"{version} v{version}")))
        start = first[np.searchsorted(first, at, "right") - 1]
        for j in range(k + AFTER):
            near[(at - j)[at - j >= start]] |= 1 << i
    return near


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of a slice of the batch's texts, and the first word of each text."""
    raw, at = tx.utf8(batch.column("text"))
    for lo, hi in tx.slices(at):
        part, own = tx.LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        starts, ends, first = tx.spans(part, own, tx.ALNUM)
        yield tx.word_hashes(part, starts, ends), first


def _rolling(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for h, first in _words(batch):
                grams = tx.grams(h, k).view(np.int64)
                grams = (grams & GRAM_BITS) | _near_versions(h, first, k)[: len(grams)]
                n = np.maximum(np.diff(first) - k + 1, 0)
                at = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(grams[at], pa.int64()))
                rows = batch.slice(done, len(n))
                done += len(n)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), lists], ["doc_id", "text_hash", "grams"])

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(label, _hashes(p)) for p, label in PHRASES.items()]
    for batch in batches:
        done = 0
        for h, first in _words(batch):
            size = len(first) - 1
            n_base = np.zeros(size, np.int64)
            lows, highs = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
            labels: list[set[str]] = [set() for _ in range(size)]
            for label, p in phrases:
                hit = np.ones(max(0, len(h) - len(p) + 1), dtype=bool)
                for j, w in enumerate(p):
                    hit &= h[j : len(hit) + j] == w
                where = np.flatnonzero(hit)
                doc = np.searchsorted(first, where, "right") - 1
                inside = where + len(p) <= first[doc + 1]
                where, doc = where[inside], doc[inside]
                np.add.at(n_base, doc, 1)
                np.minimum.at(lows, doc, where - first[doc])
                np.maximum.at(highs, doc, where - first[doc])
                for d in set(doc.tolist()):
                    labels[d].add(label)
            rows = batch.slice(done, size)
            done += size
            none = n_base == 0
            columns = [rows.column("doc_id"), rows.column("text_hash"), pa.array(np.diff(first), pa.int64()), pa.array(n_base), pa.array(lows, pa.int64(), mask=none), pa.array(highs, pa.int64(), mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"])


def occurrences(spark: SparkSession, docs: DataFrame, k: int = K, near: int = NEAR_DIAGONALS, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified template spans: doc_id, text_hash, template, first_word, end_word, cover."""
    grams = docs.mapInArrow(_rolling(k), "doc_id long, text_hash long, grams array<long>")
    grams = grams.select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "both"))
    grams = grams.withColumns({"gram": F.col("both").bitwiseAND(F.lit(GRAM_BITS)), "near": F.col("both").bitwiseAND(F.lit(~GRAM_BITS))}).drop("both")
    hits = grams.join(F.broadcast(template_grams(spark, k)), "gram")
    key = ["doc_id", "text_hash", "template"]
    votes = hits.groupBy(*key, "t_size", "version", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("seen"), F.bit_or("near").alias("near"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"), F.lit(1))
    merged = votes.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order))
    spans = merged.groupBy(*key, "t_size", "version", "group").agg(
        F.bit_or("near").alias("near"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first_word"),
        (F.max(F.col("diagonal") + F.array_max("seen")) + k).alias("end_word"),
    )
    cover = F.size("seen") / F.col("t_size")
    spans = spans.where(F.col("near").bitwiseAND(F.col("version")) == F.col("version"))
    return spans.select(*key, "first_word", "end_word", cover.alias("cover")).where((F.col("cover") >= min_cover) & (F.col("end_word") - F.col("first_word") <= F.lit(1.5) * (F.col("t_size") + k)))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: words, base places, first and last of them, base labels, all labels, score."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    base = rows.mapInArrow(_phrases, "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = occurrences(spark, rows).groupBy("doc_id", "text_hash").agg(F.collect_set("template").alias("found"), F.max("cover").alias("cover")).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("found", none)))).alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
