"""Licence scan by Dice coefficient over word bigrams. Native: DataFrame functions only.

A unit is a line of a document, the whole document (unit 0), or a window of words (unit -1), wherever it lies in lines
and paragraphs. Units and templates are normalised alike: A-Z lower-cased,
everything but a-z and 0-9 is a separator. The Dice coefficient of two bigram sets A and B is 2|A & B| / (|A| + |B|), so
it can reach ``t`` only if |A| lies between |B| t / (2 - t) and |B| (2 - t) / t; units outside the bounds of every
template are gone before a bigram is made, and the bounds of each template prune the rest at the join. Bigrams probe a
broadcast table of the templates' bigrams, by 64-bit hashes (its size is that of the template list, which is checked), and units meet
templates only through a bigram they share.

First of all one pass drops documents that hold none of a few rare bigrams of any template (prefix filtering).

Windows. A window that reaches ``t`` shares at least |B| t / (2 - t) distinct bigrams with its template, so only documents
that share so many with it, wherever they stand, are looked into. There a window as long as the template begins at every
place where a bigram of the document, set on its first place in the template, says that the template would begin; the
best window of each document and template counts, of equals the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either "
    "version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
)

#: Public licence notices, as people write them into texts, and whole licences or headers of files.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-text": _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause-text": (
        _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. " + _BSD_WARRANTY
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this '
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to '
        "whom the Software is furnished to do so, all subject to the following"
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "GPL-3.0-header": _GNU.format("General Public License", "3"),
    "GPL-2.0-header": _GNU.format("General Public License", "2"),
    "LGPL-3.0-header": _GNU.format("Lesser General Public License", "3"),
    "AGPL-3.0-header": _GNU.format("Affero General Public License", "3"),
}

#: More template bigrams than this are joined by shuffle.
BROADCAST_BIGRAMS = 500_000
#: So many bigrams may stand in the plan itself.
LITERAL_BIGRAMS = 20_000


def unit_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, common.ASCII_UPPER, common.ASCII_LOWER), "[^a-z0-9]+"), "")


def _bigrams(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add 64-bit hashes of the distinct word bigrams; texts of fewer than two words have none.

    Where a text ends, the last word meets nothing; that pair is dropped by its place before repeats are.
    """
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(out, pairs)
    return df.withColumn(out, F.array_distinct(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))))


def _size_bounds(n: Column, threshold: float) -> tuple[Column, Column]:
    return F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9)


def scan(docs: DataFrame, notices: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, license_id, dice: the best template of each unit that reaches the threshold.

    Unit 0 is the whole document, unit n its n-th line. Of equal coefficients the template first by name is reported.
    Unit -1 is a window of words: each template that reaches the threshold in some window is reported once with the best
    one, unless the whole document or a line reports it. So a long licence and a notice that it contains may both be.
    Null, empty and one-word texts match nothing. Rows that repeat an id are scanned each; equal rows give equal results.
    An empty table, or no template, gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    listed = spark.createDataFrame(sorted(notices.items()), "license_id string, notice string").select("license_id", unit_words(F.col("notice")).alias("ws"))
    listed = _bigrams(listed, "ws", "grams").withColumn("m", F.size("grams")).where("m > 0")
    places = listed.select("license_id", "m", "ws", F.size("ws").alias("w"), F.posexplode(_pairs("ws")).alias("at", "gram"))
    long = F.length(F.get("ws", F.col("at"))) + F.length(F.get("ws", F.col("at") + 1))
    places = places.withColumn("long", long).groupBy("license_id", "m", "w", "gram").agg(F.min("at").alias("at"), F.max("long").alias("long"))
    lo, hi = _size_bounds(F.col("m"), threshold)
    whole = listed.select("license_id", "grams")
    listed = listed.select("license_id", "grams", "m", lo.alias("lo"), hi.alias("hi"))
    limits = listed.agg(F.min("lo"), F.max("hi"), F.sum("m")).first()
    templates = listed.select("license_id", "m", "lo", "hi", F.explode("grams").alias("gram"))
    if (limits[2] or 0) <= BROADCAST_BIGRAMS:
        templates = F.broadcast(templates)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = _likely_documents(base, places, threshold).withColumn("text_hash", F.xxhash64("text"))
    base = common.materialise(base, "licence-documents")
    texts = base
    base = base.withColumn("lines", F.split("text", "\n"))
    # No filter stands above a costly column and generators are outer ones: Catalyst would push a filter (or one that it
    # infers) below the column and compute it twice. Units out of bounds become null arrays instead.
    # The whole text, and the lines if there are several; a single line would be the whole text again.
    base = base.withColumn("units", F.when(F.size("lines") > 1, F.concat(F.array("text"), "lines")).otherwise(F.array("text")))
    least, most = limits[0] or 1, limits[1] or 0
    units = base.select("doc_id", "text_hash", F.posexplode_outer("units").alias("unit", "line"))
    # A unit of m distinct bigrams has more than m words, of one character and a separator at least.
    units = units.where(F.length("line") >= 2 * least).select("doc_id", "text_hash", "unit", unit_words(F.col("line")).alias("ws"))
    units = _bigrams(units.withColumn("ws", F.when(F.size("ws") > least, F.col("ws"))), "ws", "grams")
    units = units.select("doc_id", "text_hash", "unit", F.coalesce(F.size("grams"), F.lit(0)).alias("n"), "grams")
    units = units.withColumn("grams", F.when(F.col("n").between(least, most), F.col("grams")))
    hits = units.select("doc_id", "text_hash", "unit", "n", F.explode_outer("grams").alias("gram")).join(templates, "gram").where("n between lo and hi")
    # A unit lies in one task, so it is counted before the shuffle. Rows alike in id and text are counted as ``times``.
    both, dice = F.size(F.collect_set("gram")), 2 * F.col("both") / (F.col("n") + F.col("m"))
    scored = hits.groupBy("doc_id", "text_hash", "unit", "n", "license_id", "m").agg(both.alias("both"), (F.count("*") / both).cast("int").alias("times"))
    scored = scored.withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "text_hash", "unit").agg(F.min_by(F.struct("license_id", "dice", "times"), F.struct(-F.col("dice"), "license_id")).alias("b"))
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit("|"), F.col("text_hash").cast("string"))
    best = common.materialise(best.select("doc_id", key.alias("key"), "unit", "b.*"), "licence-units")
    windows = _windows(texts.select("doc_id", key.alias("key"), "text"), places, whole, threshold)
    found = best.unionByName(windows.join(best.select("key", "license_id").distinct(), ["key", "license_id"], "left_anti"))
    return found.select("doc_id", "unit", "license_id", "dice", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def _likely_documents(docs: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """The documents that may hold a unit or window alike to some template; no other can.

    Whatever reaches the threshold shares ``need`` of a template's m distinct bigrams, so it holds one at least of any
    m - need + 1 of them. These are taken from the longest, which ordinary prose hardly has; a document without any is
    gone after one pass over its own bigrams.
    """
    need = _size_bounds(F.col("m"), threshold)[0]
    order = Window.partitionBy("license_id").orderBy(F.desc("long"), "gram")
    rare = places.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("m") - need + 1).select("gram").distinct()
    pairs = docs.withColumn("ws", unit_words(F.col("text"))).withColumn("pairs", _pairs("ws"))
    if rare.count() <= LITERAL_BIGRAMS:
        listed = [r.gram for r in rare.collect()]
        found = F.exists("pairs", lambda g: g.isin(*listed)) if listed else F.lit(False)
        # An outer generator, or the filter would be moved below the columns that it is made of.
        return pairs.select("doc_id", "text", F.explode_outer(F.array(found)).alias("found")).where("found").drop("found")
    pairs = common.materialise(pairs.withColumn("mark", F.monotonically_increasing_id()).drop("ws"), "licence-pairs")
    marks = pairs.select("mark", F.explode_outer("pairs").alias("gram")).join(rare, "gram").select("mark").distinct()
    return pairs.join(marks, "mark", "left_semi").select("doc_id", "text")


def _pairs(words: str) -> Column:
    """64-bit hashes of the word bigrams, in order."""
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))


def _windows(texts: DataFrame, places: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key, unit (-1), license_id, dice, times: the best window of each template in each text.

    ``places``: (license_id, m, w, at, gram), the first place of each bigram of a template of w words. Only pairs that
    share enough bigrams, wherever they stand, are looked into.
    """
    places = places.withColumn("need", _size_bounds(F.col("m"), threshold)[0])
    few = places.count() <= BROADCAST_BIGRAMS
    if few:
        places = F.broadcast(places)
    own = texts.withColumn("ws", unit_words(F.col("text"))).select("doc_id", "key", _pairs("ws").alias("pairs"))
    own = own.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("pairs").alias("pairs"), F.count("*").cast("int").alias("times"))
    own = common.materialise(own, "licence-texts")
    counted = own.select("key", F.explode(F.array_distinct("pairs")).alias("gram")).join(places, "gram").groupBy("key", "license_id", "need").agg(F.count("*").alias("both"))
    likely = common.materialise(counted.where("both >= need").select("key", "license_id").join(own, "key"), "licence-likely")
    keys = ["key", "license_id"]
    hits = likely.select("key", "license_id", F.posexplode("pairs").alias("pos", "gram")).join(places, ["license_id", "gram"])
    begins = hits.groupBy(*keys, "w", "m").agg(F.collect_set(F.greatest(F.col("pos") - F.col("at"), F.lit(0))).alias("begins"))
    ready = begins.join(likely, keys).join(F.broadcast(templates) if few else templates, "license_id")

    def dice(start: Column) -> Column:
        inside = F.array_distinct(F.slice("pairs", start + 1, F.col("w") - 1))
        return 2 * F.size(F.array_intersect(inside, F.col("grams"))) / (F.size(inside) + F.col("m"))

    best = F.array_max(F.transform("begins", lambda start: F.struct(dice(start).alias("dice"), (-start).alias("first"))))["dice"]
    return ready.select("doc_id", *keys, F.lit(-1).alias("unit"), best.alias("dice"), "times").where(F.col("dice") >= threshold)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every line, whole text and window of ``documents``."""
    return scan(common.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH notices(license_id, notice) AS (VALUES %s),
t_words AS (SELECT license_id, regexp_extract_all(translate(notice, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM notices),
t_pairs AS (SELECT license_id, len(ws) AS w, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS ps FROM t_words),
t_grams AS (SELECT license_id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM t_words),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
units AS (
  SELECT r, doc_id, unnest(us) AS line, unnest(range(len(us)))::INTEGER AS unit
  FROM (SELECT r, doc_id, CASE WHEN len(lines) > 1 THEN list_concat([text], lines) ELSE [text] END AS us FROM docs)),
u_words AS (SELECT r, doc_id, unit, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM units),
u_grams AS (SELECT r, doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM u_words),
pairs AS (
  SELECT u.r, u.doc_id, u.unit, t.license_id, u.n, t.m, count(*) AS shared
  FROM (SELECT r, doc_id, unit, len(grams) AS n, unnest(grams) AS gram FROM u_grams) u
  JOIN (SELECT license_id, len(grams) AS m, unnest(grams) AS gram FROM t_grams) t USING (gram) GROUP BY ALL),
whole_units AS (
  SELECT r, doc_id, unit, license_id, 2 * shared / (n + m) AS dice FROM pairs WHERE 2 * shared / (n + m) >= 0.8
  QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY 2 * shared / (n + m) DESC, license_id) = 1),
places AS (
  SELECT license_id, w, len(list_distinct(ps)) AS m, gram, list_position(ps, gram) - 1 AS first_at, ceil(len(list_distinct(ps)) * 0.8 / 1.2 - 1e-9) AS need
  FROM (SELECT license_id, w, ps, unnest(list_distinct(ps)) AS gram FROM t_pairs)),
d_words AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM docs),
d_grams AS (SELECT r, doc_id, unnest(range(0, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM d_words WHERE len(ws) > 1),
d_hits AS (SELECT r, doc_id, pos, license_id, w, m, gram, first_at, need FROM d_grams JOIN places USING (gram)),
likely AS (SELECT r, license_id FROM d_hits GROUP BY r, license_id, need HAVING count(DISTINCT gram) >= need),
begins AS (SELECT DISTINCT r, doc_id, license_id, w, m, greatest(pos - first_at, 0) AS start FROM d_hits JOIN likely USING (r, license_id)),
measured AS (
  SELECT b.r, b.doc_id, b.license_id, b.start, b.m, count(DISTINCT g.gram) AS n, count(DISTINCT g.gram) FILTER (p.gram IS NOT NULL) AS shared
  FROM begins b JOIN d_grams g ON g.r = b.r AND g.pos BETWEEN b.start AND b.start + b.w - 2 LEFT JOIN places p ON p.license_id = b.license_id AND p.gram = g.gram GROUP BY ALL),
windows AS (SELECT r, doc_id, license_id, max(2 * shared / (n + m)) AS dice FROM measured GROUP BY ALL)
SELECT doc_id, unit, license_id, dice FROM whole_units
UNION ALL
SELECT doc_id, -1, license_id, dice FROM windows WHERE dice >= 0.8 AND NOT EXISTS (SELECT 1 FROM whole_units u WHERE u.r = windows.r AND u.license_id = windows.license_id)
""" % ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())  # noqa: UP031
