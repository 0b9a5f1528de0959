"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file is cut into sentences (ended by a line break, or a period and a blank) and into blocks (lines up to one without a word, so
that wrapped headers hold together, whatever marks their comments). Both, and the file as a whole, are held against templates:
statements and SPDX lines, the paragraphs of usual headers and licences, and whole short licences.

The vector space has all words; document frequencies of the templates' words come from all files, and every other word weighs as
the rarest of these. A unit's cosine is at most the root of the share of its squared weight that template words have, so units
below ``LEAST`` are left out before any product. A mere claim of rights counts less, so that a licence beside it wins. A file's own licence is that of its best sentence (from ``SENTENCE`` on) or block (from
``BLOCK`` on). A file licenses its directory if it is named like a licence file and has a unit of ``NAMED_FROM`` or more, or if the whole
of it is a whole licence (``WHOLE`` or more); a file that merely has or is a statement doesn't. Of several in a directory the nearest
counts, then the first path. Each directory takes the licence of its nearest ancestor, itself included, by joins of paths; a file
without an own licence inherits its directory's.

Cases: null or empty texts match nothing but inherit; a null path has no directory; ties go to the first template; repeated rows
are scanned each; cosines below ``LEAST`` are null; with no files there are no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, byte_class, slices, stored, table, tidy, utf8, words

SENTENCE, BLOCK, NAMED_FROM, WHOLE, LEAST = 0.85, 0.75, 0.75, 0.8, 0.5
OTHER = np.uint64(1 << 35)
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: What the cosine to a mere claim counts, so that a licence beside it wins.
CLAIM = 0.86
#: Names of licence files.
NAMED = "(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
#: Directories up to which their licences are broadcast; beyond, they are dealt to this many parts each, so that a large directory is no one task's.
BROADCAST, SALTS = 100_000, 16

#: Statements and SPDX names.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistributed under the three clause BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
]
SPDX = [
    ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"),
    ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("ISC", "ISC"), ("BSL-1.0", "BSL-1.0"), ("Zlib", "Zlib"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
]
CLAIMS = [("Proprietary", "All rights reserved.")]
#: Public standard texts, a paragraph each; a whole licence where "whole" is set.
MIT_TEXT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_TEXT = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]
UNLICENSE_TEXT = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
]
APACHE_HEADER = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
PARAGRAPHS = [
    *[("MIT", x) for x in MIT_TEXT],
    ("BSD-3-Clause", BSD_THREE), ("BSD-2-Clause", BSD_TWO), ("BSD-2-Clause", BSD_START), ("BSD-2-Clause", BSD_END),  # the third clause wins
    *[("ISC", x) for x in ISC_TEXT], *[("Unlicense", x) for x in UNLICENSE_TEXT],
    ("Apache-2.0", APACHE_HEADER[0]), ("Apache-2.0", APACHE_HEADER[0] + " http://www.apache.org/licenses/LICENSE-2.0"), ("Apache-2.0", APACHE_HEADER[1]), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", GNU_HEADER.format("General Public License", "2")), ("GPL-3.0", GNU_HEADER.format("General Public License", "3")), ("AGPL-3.0", GNU_HEADER.format("Affero General Public License", "3")),
    ("LGPL-2.1", GNU_HEADER.format("Lesser General Public License", "2.1")), ("LGPL-3.0", GNU_HEADER.format("Lesser General Public License", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
]
WHOLES = [
    ("MIT", " ".join(["MIT License Copyright (c)", *MIT_TEXT])),
    ("BSD-2-Clause", " ".join(["BSD 2-Clause License Copyright (c)", BSD_START, BSD_ONE, BSD_TWO, BSD_END])),
    ("BSD-3-Clause", " ".join(["BSD 3-Clause License Copyright (c)", BSD_START, BSD_ONE, BSD_TWO, BSD_THREE, BSD_END])),
    ("ISC", " ".join(["ISC License Copyright (c)", *ISC_TEXT])),
    ("Unlicense", " ".join(UNLICENSE_TEXT)),
]
#: Licence, kind (part, whole or claim) and text of each template.
TEMPLATES = [(x, "claim", t) for x, t in CLAIMS] + [(x, "part", t) for x, t in STATEMENTS] + [(x, "part", "SPDX-License-Identifier: " + t) for x, t in SPDX] + [(x, "part", t) for x, t in PARAGRAPHS] + [(x, "whole", t) for x, t in WHOLES]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, and the sentence, the block and the row of each."""
    data = LOWER[data]
    s, e, first = words(data, offs, WORD)
    if not len(s):
        return np.zeros(0, np.uint64), s, s, s
    line = data == 0x0A
    stop = line.copy()
    stop[:-1] |= (data[:-1] == 0x2E) & (data[1:] == 0x20)
    cuts = np.unique(np.concatenate([np.flatnonzero(stop), offs[1:-1] - 1]))
    row = np.searchsorted(first, np.arange(len(s)), "right") - 1
    lines = np.cumsum(line)[s]
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(lines) > 1) | (np.diff(row) != 0)
    return RangeHash(data)(s, e), np.searchsorted(cuts, s), np.cumsum(new) - 1, row


class Templates:
    """The templates' words and, once document frequencies are known, their weighted vectors."""

    def __init__(self, given: list[tuple[str, str, str]] = TEMPLATES):
        self.names = [n for n, _, _ in given]
        self.whole = np.array([kind == "whole" for _, kind, _ in given])
        self.scale = np.array([CLAIM if kind == "claim" else 1.0 for _, kind, _ in given])
        data, offs = utf8(pa.array([t for _, _, t in given], pa.string()))
        h, _, _, row = tokens(data, offs)
        self.words = np.unique(h)
        self.counts = np.zeros((len(given), len(self.words)))
        np.add.at(self.counts, (row, np.searchsorted(self.words, h)), 1)

    def place(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def weigh(self, files: int, frequency: np.ndarray) -> None:
        self.idf = np.log((1 + files) / (1 + frequency)) + 1
        self.other = float(self.idf.max())
        v = self.counts * self.idf
        self.vectors = self.scale[:, None] * v / np.sqrt((v * v).sum(1, keepdims=True))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Numbers below 1 << 36 for words: a template word's place, or 35 bits of hash and a mark."""
        at = self.place(h)
        return np.where(at >= 0, at.astype(np.uint64), OTHER | (h >> np.uint64(29)))

    def best(self, keys: np.ndarray, unit: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of a cosine of LEAST or more, and the best template (a part, or a whole licence) and its cosine for each."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(keys):
            return none
        both = np.sort(unit.astype(np.uint64) << np.uint64(36) | keys)
        begin = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        tf = np.diff(np.append(begin, len(both)))
        both = both[begin]
        unit, key = (both >> np.uint64(36)).astype(np.int64), both & np.uint64((1 << 36) - 1)
        known = key < OTHER
        at = np.where(known, key, 0).astype(np.int64)
        w = tf * np.where(known, self.idf[at], self.other)
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        norm, met = np.add.reduceat(w * w, first), np.add.reduceat(np.where(known, w * w, 0.0), first)
        fit = met >= LEAST * LEAST * norm  # a cosine is at most the root of the share of the squared weight that template words have
        keep = np.repeat(fit, np.diff(np.append(first, len(unit)))) & known
        unit, at, w, norm = unit[keep], at[keep], w[keep], np.sqrt(norm[fit])
        if not len(unit):
            return none
        of = np.flatnonzero(self.whole == whole)
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        cosine = np.round(np.add.reduceat(w[:, None] * self.vectors[np.ix_(of, at)].T, first, axis=0) / norm[:, None], 9)  # ties are ties
        top = cosine.argmax(1)
        best = cosine[np.arange(len(first)), top]
        ok = best >= LEAST
        return unit[first][ok], of[top[ok]], best[ok]


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        files, seen = 0, np.zeros(len(t.words), np.int64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs):
                h, _, _, row = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = t.place(h)
                known = at >= 0
                pairs = np.unique(row[known] * len(t.words) + at[known])
                seen += np.bincount(pairs % len(t.words), minlength=len(t.words))
            files += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(seen)), pa.int64()), pa.array(np.append(files, seen), pa.int64())], names=["word", "n"])

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for i, j in slices(offs):
                h, sentence, block, row = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = j - i
                keys = t.keys(h)
                out = []
                for unit, whole in ((sentence, False), (block, False), (row, True)):
                    u, top, cosine = t.best(keys, unit, whole)
                    license_, best = np.full(n, -1), np.full(n, np.nan)
                    of = row[np.searchsorted(unit, u)] if len(u) else u
                    order = np.lexsort((-top, cosine))  # the last that is written stays: the highest cosine, then the first template
                    license_[of[order]], best[of[order]] = top[order], cosine[order]
                    out += [pa.array([t.names[x] if x >= 0 else None for x in license_], pa.string()), pa.array(best, from_pandas=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), *out], names=["key", "path", *FOUND])

    return run


#: Best template and cosine by sentence, by block and as a whole.
FOUND = ["line_license", "line_cosine", "block_license", "block_cosine", "file_license", "file_cosine"]


def _by_dir(rows: DataFrame, dirs: DataFrame, on: str) -> DataFrame:
    """rows with the one row of dirs for their directory: dirs is broadcast if it has few rows, else dealt out to several parts a directory."""
    if dirs.count() <= BROADCAST:
        return rows.join(F.broadcast(dirs), on, "left")
    salted = dirs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"], "left").drop("__salt")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """key, path, license, cosine, origin (own, inherited or none), from_dir of each file."""
    spark = files.sparkSession
    kind = files.schema[key].dataType.simpleString()
    t = Templates(templates)
    counted = files.select(text).mapInArrow(tidy(_frequencies(spark.sparkContext.broadcast(t))), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = dict(counted.collect())  # a row for each template word
    t.weigh(n.get(-1, 0), np.array([n.get(i, 0) for i in range(len(t.words))], float))
    given = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    schema = f"key {kind}, path string, " + ", ".join(f"{x} {'string' if x.endswith('license') else 'double'}" for x in FOUND)
    found = given.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(t))), schema)
    line, block = F.coalesce("line_cosine", F.lit(0.0)), F.coalesce("block_cosine", F.lit(0.0))
    # a sentence that is all of its block is one unit, not two
    own = F.when((line >= SENTENCE) & ((line >= block) | (block < BLOCK)), F.struct(F.col("line_license").alias("license"), F.col("line_cosine").alias("cosine"))).when(block >= BLOCK, F.struct(F.col("block_license").alias("license"), F.col("block_cosine").alias("cosine")))
    unit = F.when(line >= block, F.struct(F.col("line_license").alias("license"), line.alias("cosine"))).otherwise(F.struct(F.col("block_license").alias("license"), block.alias("cosine")))
    found = found.select("key", "path", own["license"].alias("license"), F.greatest("line_cosine", "block_cosine").alias("cosine"), unit.alias("unit"), "file_license", "file_cosine", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    found = stored(found, "licenses")

    # directories with a licence file, and the nearest of these above each directory
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False)) & (F.col("unit.cosine") >= NAMED_FROM)
    whole = F.coalesce(F.col("file_cosine") >= WHOLE, F.lit(False))
    of_dir = F.when(whole, F.struct(F.col("file_license").alias("license"), F.col("file_cosine").alias("cosine"))).when(named, F.col("unit"))
    files_ = found.select("dir", "path", of_dir.alias("m")).where("dir IS NOT NULL AND m IS NOT NULL")
    given_dirs = files_.groupBy("dir").agg(F.min(F.struct((-F.col("m.cosine")).alias("c"), "path", F.col("m.license").alias("license"))).alias("m")).select(F.col("dir").alias("ancestor"), F.col("m.license").alias("dir_license"))
    given_dirs = stored(given_dirs, "license-dirs")
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "ancestor"))
    nearest = _by_dir(above, given_dirs, "ancestor").where("dir_license IS NOT NULL").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("m"))
    nearest = stored(nearest.select("dir", F.col("m.ancestor").alias("from_dir"), F.col("m.dir_license").alias("dir_license")), "license-nearest")
    out = _by_dir(found, nearest, "dir")
    has = F.col("license").isNotNull()
    return out.select(
        F.col("key").alias(key), "path", F.coalesce("license", "dir_license").alias("license"), "cosine",
        F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, as a file in a directory for its language below one for its source."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def _op2_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(k)}, {quoted(t)})" for i, (n, k, t) in enumerate(TEMPLATES))
    best = lambda kind, x: f"(SELECT f, min_by(name, (-c, t)) AS {x}_license, max(c) AS {x}_cosine FROM scored WHERE kind = '{kind}' GROUP BY f)"
    return f"""
WITH templates(t, name, sort_, text) AS (VALUES {rows}),
files AS (SELECT row_number() OVER () AS f, doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir, coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS name, {low("coalesce(text, '')")} AS text FROM documents),
of_template AS MATERIALIZED (SELECT t, name, sort_, w, count(*) AS n FROM (SELECT t, name, sort_, unnest(regexp_extract_all({low('text')}, '{word}+')) AS w FROM templates) GROUP BY ALL),
units AS (
  SELECT f, 'line' AS kind, unnest(string_split_regex(text, '\n|[.] ')) AS text FROM files
  UNION ALL SELECT f, 'block', unnest(string_split_regex(text, '\n([\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\n)+')) FROM files
  UNION ALL SELECT f, 'whole', text FROM files),
numbered AS (SELECT row_number() OVER () AS u, * FROM units),
of_unit AS MATERIALIZED (SELECT f, kind, u, w, count(*) AS n FROM (SELECT f, kind, u, unnest(regexp_extract_all(text, '{word}+')) AS w FROM numbered) GROUP BY ALL),
seen AS (SELECT w, count(*) AS n FROM of_unit WHERE kind = 'whole' GROUP BY w),
idf AS MATERIALIZED (SELECT w, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(max(seen.n), 0))::DOUBLE) + 1 AS x FROM (SELECT DISTINCT w FROM of_template) LEFT JOIN seen USING (w) GROUP BY w),
vectors AS (SELECT t, name, sort_, w, n * x / sqrt(sum(n * x * n * x) OVER (PARTITION BY t)) * CASE WHEN sort_ = 'claim' THEN {CLAIM} ELSE 1 END AS v FROM of_template JOIN idf USING (w)),
norms AS (SELECT u, sqrt(sum(pow(n * coalesce(x, (SELECT max(x) FROM idf)), 2))) AS size FROM of_unit LEFT JOIN idf USING (w) GROUP BY u),
dots AS (SELECT f, kind, u, t, name, sum(n * x * v) AS dot FROM of_unit JOIN idf USING (w) JOIN vectors USING (w) WHERE (kind = 'whole') = (sort_ = 'whole') GROUP BY ALL),
scored AS MATERIALIZED (SELECT f, kind, t, name, round(dot / size, 9) AS c FROM dots JOIN norms USING (u) WHERE round(dot / size, 9) >= {LEAST}),
found AS (SELECT *, greatest(line_cosine, block_cosine) AS cosine,
  CASE WHEN coalesce(line_cosine, 0) >= {SENTENCE} AND (line_cosine >= coalesce(block_cosine, 0) OR coalesce(block_cosine, 0) < {BLOCK}) THEN line_license WHEN block_cosine >= {BLOCK} THEN block_license END AS own
  FROM files LEFT JOIN {best('line', 'line')} USING (f) LEFT JOIN {best('block', 'block')} USING (f) LEFT JOIN {best('whole', 'file')} USING (f)),
dirs AS (SELECT dir, min_by(file_license, (-file_cosine, dir || '/' || name)) AS dir_license FROM found WHERE file_cosine >= {WHOLE} GROUP BY dir)
SELECT doc_id, dir || '/' || name AS path, coalesce(own, dir_license) AS license, cosine, CASE WHEN own IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL AND dir_license IS NOT NULL THEN dir END AS from_dir
FROM found LEFT JOIN dirs USING (dir)
"""


#: For files without a licence file's name, as those of the query are.
OP2_SQL = _op2_sql()
