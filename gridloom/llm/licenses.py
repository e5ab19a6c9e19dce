"""License scans: TF-IDF cosine of notices to templates, and inheritance along directories.

DataFrame functions only.  Three kinds of units are compared with the templates: sentences
that speak of licensing, header blocks (the lines before the first empty one) that do, and
whole licence files.  Distinct units are compared once each, however many files carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Tables

#: Public sentences, titles, headers and texts of common licences.
TEMPLATES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Released under the ISC License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: A sentence or header with one of these speaks of licensing.
CUES = ("licen", "copyright", "spdx", "cc by", "cc0", "permission is hereby", "redistribution", "public domain", "all rights reserved", "free software")
CUE = "|".join(CUES)
#: Names of licence files.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
#: Share of all units from which a unit counts as frequent: there are at most as many as its inverse.
FREQUENT = 1 / 1000


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")


def header(text: Column) -> Column:
    """The lines before the first empty one, if they are several."""
    block = F.split(F.regexp_replace(text, r"\A\s+", ""), r"\n\s*\n", 2)[0]
    return F.when(block.contains("\n"), block)


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case; those of one unit or template."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def match_units(units: DataFrame, least_cosine: float, tables: Tables) -> DataFrame:
    """(key, license, cosine, n): the best template of each distinct unit that has one.

    ``units`` has distinct units with their keys and counts n; their texts go no further
    than to their terms.  Document frequencies count every unit as often as it occurs, and
    every template once.  Ties go to the first name.
    """
    sheet = units.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in TEMPLATES))))
    have = tables.keep(units.select("key", "n", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "n", "term").agg(F.count(F.lit(1)).alias("tf")))
    model = sheet.select("license", "body", F.explode(terms(F.col("body"))).alias("term")).groupBy("license", "body", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = float(units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + len(TEMPLATES))
    frequency = have.select("term", "n").unionAll(model.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = tables.keep(frequency.select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    left = have.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    right = model.join(idf, "term").withColumn("y", F.col("tf") * F.col("idf"))
    left_norm = left.groupBy("key", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    right_norm = right.groupBy("license", "body").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    weights = right.join(right_norm, ["license", "body"])
    weights = tables.keep(weights.select("license", F.xxhash64("body").alias("template"), "term", (F.col("y") / F.col("ny")).alias("y")))
    dot = left.join(F.broadcast(weights), "term").groupBy("key", "license", "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dot.join(left_norm, "key").select("key", "n", "license", F.round(F.col("dot") / F.col("nx"), 6).alias("cosine")).where(F.col("cosine") >= least_cosine)
    best = scored.groupBy("key", "n").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("license"))).alias("b"))
    out = tables.keep(best.select("key", "n", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("cosine")))
    tables.drop(have, idf, weights)
    return out


def units_of(text: Column, is_file: Column) -> Column:
    """What is compared of a file, as an array of (kind, key, unit): null where nothing speaks of licensing."""
    low = F.lower(text)
    hinted = low.contains(CUES[0])
    for c in CUES[1:]:
        hinted = hinted | low.contains(c)
    speaks = lambda s: F.lower(s).rlike(CUE)
    unit = lambda kind, s: F.struct(F.lit(kind).alias("kind"), F.md5(s).alias("key"), s.alias("unit"))
    single = F.transform(F.filter(sentences(text), speaks), lambda s: unit("sentence", s))
    whole = F.array(F.when(speaks(header(text)), unit("header", header(text))), F.when(is_file, unit("file", text)))
    return F.when(hinted | is_file, F.concat(single, F.filter(whole, lambda u: u.isNotNull())))


def own_licenses(files: DataFrame, least_cosine: float, tables: Tables) -> DataFrame:
    """(id, own_license, cosine, n_notices): the best unit of every file that has one, of ``files`` (id, units).

    A unit that many files carry is no hot join key: such units are few, and their matches
    are broadcast.
    """
    found = files.where("units is not null and id is not null").select("id", F.explode("units").alias("u")).select("id", "u.kind", "u.key", "u.unit")
    distinct = tables.keep(found.groupBy("key").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n")))
    matched = match_units(distinct, least_cosine, tables)
    least = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * FREQUENT
    often = F.broadcast(matched.where(F.col("n") > least).drop("n"))
    carried = found.select("id", "kind", "key")
    seldom = carried.join(often, "key", "left_anti").join(matched.where(F.col("n") <= least).drop("n"), "key")
    every = carried.join(often, "key").unionByName(seldom)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("license"))).alias("b")
    per = every.groupBy("id").agg(best, F.count(F.when(F.col("kind") == "sentence", 1)).alias("n_notices"))
    out = tables.keep(per.select("id", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("cosine"), "n_notices"))
    tables.drop(distinct, matched)
    return out


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root '' included, as (path, depth)."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.when(directory == "", 0).otherwise(F.size(parts))),
        lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth")),
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)


def scan_licenses(
    files: DataFrame,
    least_cosine: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Licence of every file: that of its own best notice, header or text, else of the nearest ancestor directory.

    A directory's licence is that of its licence files, which are known by their names and
    compared as wholes: the best cosine, then the first name.  Columns after the id and
    those of ``more``: own_license, cosine, n_notices (matched sentences), license, basis
    ('notice', 'inherited' or 'none') and from_dir, the directory it is inherited from.

    The usual edge cases; a null path has no directory and inherits nothing, and a row with
    a null id has no notices.  Rows that repeat an id share the notices of all its texts.
    """
    tables = Tables(files.sparkSession)
    path = F.col(path_col)
    directory = F.when(path.isNotNull(), F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"^/+|/+$", ""))
    base = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), directory.alias("dir"), F.rlike(file_name(path), F.lit(FILE_NAMES)).alias("is_file"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(more)))
    held = tables.keep(base.withColumn("units", units_of(F.col("text"), F.col("is_file"))).drop("text"))  # texts are read and searched once
    own = own_licenses(held.select("id", "units"), least_cosine, tables)
    rows = held.drop("units").join(own, "id", "left")
    of_dir = held.where("is_file and dir is not null").select("id", "dir").join(own, "id").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("own_license").alias("license"))).alias("b")).select(F.col("dir").alias("path"), F.col("b.license").alias("dir_license"))
    lookup = held.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("up")).select("dir", F.col("up.path").alias("path"), F.col("up.depth").alias("depth"))
    nearest = lookup.join(of_dir, "path").groupBy("dir").agg(F.max(F.struct("depth", "path", "dir_license")).alias("near"))
    done = rows.join(nearest, "dir", "left")
    own_null = F.col("own_license").isNull()
    return done.select(
        F.col("id").alias(id_col),
        *(F.col(f"m{k}").alias(c) for k, c in enumerate(more)),
        "own_license",
        "cosine",
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(~own_null, "notice").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(own_null, F.col("near.path")).alias("from_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: each in a folder ``source/lang/doc_id`` as ``text.txt``, and a last line that speaks of licensing as its ``LICENSE``.

    A footer is set apart from the text by a line break and speaks for the whole of it, as a
    licence file does for its folder.  A row with a null id is one file without a path.
    """
    text = F.rtrim(F.coalesce("text", F.lit("")), F.lit("\n"))
    last = F.substring_index("all", "\n", -1)
    base = docs.select("doc_id", text.alias("all"), F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("dir"))
    footed = base.withColumn("footer", F.when(F.col("doc_id").isNotNull() & F.col("all").contains("\n") & F.lower(last).rlike(CUE), last))
    folder = F.when(F.col("doc_id").isNotNull(), F.col("dir"))
    body = F.struct(F.concat(folder, F.lit("/text.txt")).alias("path"), F.when(F.col("footer").isNull(), F.col("all")).otherwise(F.expr("left(all, length(all) - length(footer) - 1)")).alias("text"))
    extra = F.when(F.col("footer").isNotNull(), F.struct(F.concat(folder, F.lit("/LICENSE")).alias("path"), F.col("footer").alias("text")))
    return footed.select("doc_id", F.explode(F.filter(F.array(body, extra), lambda f: f.isNotNull())).alias("f")).select("doc_id", "f.path", "f.text")


def document_licenses(docs: DataFrame) -> DataFrame:
    """The licence of every document, from its own notices or inherited from the footer of its folder; see scan_licenses."""
    found = scan_licenses(document_files(docs), id_col="path", more=("doc_id",))
    return found.where(F.col("path").isNull() | ~F.col("path").endswith("/LICENSE")).drop("path")


#: The same written anew in SQL; only the template sheet is shared, as data.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, rtrim(coalesce(text, ''), chr(10)) AS whole,
         coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id::VARCHAR AS dir FROM documents),
cue AS (SELECT 'licen|copyright|spdx|cc by|cc0|permission is hereby|redistribution|public domain|all rights reserved|free software' AS re),
cut AS (
  SELECT doc_id, whole, dir, CASE WHEN doc_id IS NOT NULL AND contains(whole, chr(10)) AND regexp_matches(lower(string_split(whole, chr(10))[-1]), re)
                             THEN string_split(whole, chr(10))[-1] END AS footer FROM docs, cue),
files AS (
  SELECT doc_id, 'text' AS name, CASE WHEN footer IS NULL THEN whole ELSE left(whole, length(whole) - length(footer) - 1) END AS body FROM cut
  UNION ALL SELECT doc_id, 'LICENSE', footer FROM cut WHERE footer IS NOT NULL),
tops AS (SELECT doc_id, name, string_split_regex(regexp_replace(body, '\A\s+', ''), '\n\s*\n')[1] AS unit FROM files WHERE doc_id IS NOT NULL),
found AS (
  SELECT doc_id, name, 1 AS sentence, s AS unit FROM (
    SELECT doc_id, name, unnest(string_split(regexp_replace(body, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM files WHERE doc_id IS NOT NULL), cue
  WHERE regexp_matches(lower(s), re)
  UNION ALL SELECT doc_id, name, 0, unit FROM tops, cue WHERE contains(unit, chr(10)) AND regexp_matches(lower(unit), re)
  UNION ALL SELECT doc_id, name, 0, body FROM files WHERE name = 'LICENSE'),
dist AS (SELECT unit, count(*) AS n FROM found GROUP BY unit),
sheet(license, body) AS (VALUES @SHEET@),
have AS (SELECT unit, n, term, count(*) AS tf FROM (SELECT unit, n, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM dist) GROUP BY ALL),
model AS (SELECT license, body, term, count(*) AS tf FROM (SELECT license, body, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM sheet) GROUP BY ALL),
freq AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM have UNION ALL SELECT term, 1 FROM model) GROUP BY term),
idf AS (SELECT term, ln(((SELECT coalesce(sum(n), 0) FROM dist) + (SELECT count(*) FROM sheet) + 1e0) / (df + 1)) + 1 AS idf FROM freq),
lft AS (SELECT unit, term, tf * idf AS x FROM have JOIN idf USING (term)),
rgt AS (SELECT license, body, term, tf * idf AS y FROM model JOIN idf USING (term)),
ln_ AS (SELECT unit, sqrt(sum(x * x)) AS nx FROM lft GROUP BY unit),
rn AS (SELECT license, body, sqrt(sum(y * y)) AS ny FROM rgt GROUP BY license, body),
sim AS (SELECT unit, license, round(sum(x * (y / ny)) / any_value(nx), 6) AS cosine
        FROM lft JOIN rgt USING (term) JOIN rn USING (license, body) JOIN ln_ USING (unit) GROUP BY unit, license, body),
best AS (SELECT unit, license, cosine FROM sim WHERE cosine >= 5e-1 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
own AS (SELECT doc_id, name, license, cosine, n_notices FROM (
  SELECT doc_id, name, license, cosine, sum(sentence) OVER (PARTITION BY doc_id, name)::BIGINT AS n_notices,
         row_number() OVER (PARTITION BY doc_id, name ORDER BY cosine DESC, license) AS k FROM found JOIN best USING (unit)) WHERE k = 1)
SELECT c.doc_id, o.license AS own_license, o.cosine, coalesce(o.n_notices, 0) AS n_notices, coalesce(o.license, f.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN 'notice' WHEN f.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN o.license IS NULL AND f.license IS NOT NULL THEN c.dir END AS from_dir
FROM cut c LEFT JOIN own o ON c.doc_id = o.doc_id AND o.name = 'text' LEFT JOIN own f ON c.doc_id = f.doc_id AND f.name = 'LICENSE'
""".replace("@SHEET@", ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES))
