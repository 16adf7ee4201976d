"""Licence scans in DataFrame functions only: sparse TF-IDF cosine of headers and licence
files to templates, then inheritance from the nearest ancestor directory by path joins.

A file is compared in three ways: each line with short notices; each block (up to a blank line,
without comment marks) with the paragraphs of usual headers; a licence file, by its name, as a
whole with the full texts of short licences. Each distinct line, block and text is scored once, however
many files hold it. What cannot reach the least cosine, by a bound on the terms that it
shares with a template, is left out before the shuffle; nothing else is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Short notices by which licences are usually declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
)

#: Blocks of the usual headers and licence files. They have weights of their own.
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {0} of the License, or (at your option) any later version."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BLOCKS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", _GPL.format("", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("ISC", _ISC),
    ("LGPL-2.1", _LIBRARY.format("2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", _MIT),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Whole texts of short licences, with weights of their own.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = (
    ("BSD-2-Clause", "Copyright (c) " + _BSD + _BSD_END),
    ("BSD-3-Clause", "Copyright (c) " + _BSD + _NAMES + _BSD_END),
    ("ISC", "Copyright (c) " + _ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "MIT License Copyright (c) " + _MIT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)
#: A line's comment marks, the blank lines that part blocks, words that any text has, and a block's terms.
MARKS = r"(?m)^[ \t]*(?:(?:#+|/?\*+/?|//+|;+|--+|%+|<!--|\"{3}|'{3})[ \t]*)?|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
BLANK, COMMON = r"\n\s*\n", "a an and any are as at be by can for from if in is it may not of on one or that the this to use was which with you"
WORD = "[a-z0-9]+"
#: Names after SPDX-License-Identifier, in lower case: these and the templates' own.
SPDX = r"(?i)spdx-license-identifier:\s*([a-z0-9.+-]*[a-z0-9+])"
ALIASES = {"gpl-3.0-only": "GPL-3.0", "gpl-3.0-or-later": "GPL-3.0", "gpl-3.0+": "GPL-3.0", "gpl-2.0-only": "GPL-2.0", "gpl-2.0-or-later": "GPL-2.0", "gpl-2.0+": "GPL-2.0", "lgpl-3.0-only": "LGPL-3.0", "lgpl-3.0-or-later": "LGPL-3.0", "lgpl-3.0+": "LGPL-3.0", "lgpl-2.1-only": "LGPL-2.1", "lgpl-2.1-or-later": "LGPL-2.1", "lgpl-2.1+": "LGPL-2.1", "agpl-3.0-only": "AGPL-3.0", "agpl-3.0-or-later": "AGPL-3.0"}

#: What says that a licence does not hold, and what names a licence file.
DENIED = r"(?i)\b(?:not|never|no longer)\s+(?:[a-z]+\s+){0,2}(?:licen[cs]ed|released|distributed|available|provided|offered|published)\s+under\b"
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine.
LEAST = 0.6


def _template_terms(templates=TEMPLATES, term: str = TERM) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight over the template's norm); idf by term; idf of all other terms."""
    split = [[t for t in re.findall(term, text.lower()) if t not in COMMON.split()] for _, text in templates]
    n = len(split)
    idf = {t: math.log((1 + n) / (1 + sum(t in s for s in split))) + 1 for s in split for t in s}
    rows = []
    for k, words in enumerate(split):
        weights = {t: words.count(t) * idf[t] for t in words}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(k, templates[k][0], t, w / norm) for t, w in sorted(weights.items())]
    return rows, idf, math.log(1 + n) + 1


def _needed(templates, term: str, least: float) -> list[str]:
    """Every text, in lower case, whose cosine to a template may be `least` has one of these terms: the
    others of the template alone have a norm below it. Terms of many templates go first, short
    ones and numbers, which many texts hold, last."""
    weights: dict[str, dict[int, float]] = {}
    for k, _, t, w in _template_terms(templates, term)[0]:
        weights.setdefault(t, {})[k] = w * w
    open_ = {k: 1 - (least - 1e-6) ** 2 for own in weights.values() for k in own}
    out = []
    while open_:
        worth = lambda t: sum(min(w, open_[k]) for k, w in weights[t].items() if k in open_) * (0.2 if len(t) < 4 or t.isdigit() else 1)
        best = max(sorted(set(weights).difference(out)), key=worth)
        out.append(best)
        open_ = {k: left - weights[best].get(k, 0.0) for k, left in open_.items() if left - weights[best].get(k, 0.0) > 0}
    return sorted(t for t in out if not any(o != t and t.startswith(o) for o in out))  # what begins with a longer one begins with it


def _of_prefixes(terms: list[str]) -> str:
    """An expression for any of the terms, parted by their first letters."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    return "(?:" + "|".join(re.escape(c) + ("" if "" in rest else _of_prefixes(rest)) for c, rest in sorted(by.items())) + ")"


def _holds_any(text: Column, terms: list[str]) -> Column:
    """Whether a text has a word that begins with one of the terms."""
    return text.rlike("(?<![a-z0-9])" + _of_prefixes(terms))


def _terms(said: str, term: str) -> Column:
    """The terms of a text: those of the expression but the words that any text has."""
    return F.filter(F.regexp_extract_all(F.lower(said), F.lit(term), F.lit(0)), lambda t: ~t.isin(COMMON.split()))


def _may_be_alike(said: str, templates, term: str, least: float) -> Column:
    """Whether the cosine of a text to some template may be `least`. Its product with a template is exact;
    its norm counts each term as often as it occurs, which is no more than the square of that.
    So no text with that cosine is lost, and no shuffle is needed for the others."""
    rows, idf, other = _template_terms(templates, term)
    terms = _terms(said, term)
    known = F.filter(terms, lambda t: t.isin(sorted(idf)))
    weight = F.create_map(*(F.lit(x) for kv in sorted(idf.items()) for x in kv))
    maps = [F.create_map(*(F.lit(x) for k, _, t, w in rows if k == own for x in (t, w * idf[t]))) for own in range(len(templates))]
    norm = F.aggregate(known, F.lit(0.0), lambda held, t: held + F.element_at(weight, t) * F.element_at(weight, t))
    zero = F.array(*(F.lit(0.0) for _ in maps))
    dots = F.aggregate(known, zero, lambda held, t: F.array(*(held[k] + F.coalesce(F.element_at(m, t), F.lit(0.0)) for k, m in enumerate(maps))))
    return F.array_max(dots) >= (least - 1e-6) * F.sqrt(norm + (F.size(terms) - F.size(known)) * (other * other))


def score_lines(lines: DataFrame, *, said: str = "line", against=TEMPLATES, term: str = TERM) -> DataFrame:
    """line, license and cosine of the template most like each line (ties: the first licence by
    name); its text is in the column `said`."""
    rows, idf, other = _template_terms(against, term)
    spark = lines.sparkSession
    templates = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    terms = lines.select("line", F.explode(_terms(said, term)).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    own = terms.join(F.broadcast(weights), "term", "left").select("line", "term", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("w"))
    norm = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = own.join(F.broadcast(templates), "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    return dot.join(norm, "line").groupBy("line").agg(F.min(F.struct((-cosine).alias("c"), "license")).alias("best")).select("line", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _is_licence(path: str) -> Column:
    """Whether a path names a licence file."""
    return F.coalesce(_name(F.col(path)).rlike(LICENCE_FILE), F.lit(False))


def _ancestors(path: Column) -> Column:
    """(depth, directory) of all directories above a path; the root is the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan_licenses(files: DataFrame, *, path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Per row of files: its columns and license, method (header, file, inherited, none), cosine, license_dir.

    Lines, blocks and licence files are compared as above; those that deny a licence ("not
    released under ...") are left out. An SPDX identifier of a known licence has cosine 1. The
    best of these counts, if its cosine is `least` or more; of ties the first name. A file
    without one takes the licence of the nearest directory above it that has a licence
    file with one (of several the best, then the first by path). Null or empty texts have
    no lines; rows with a null path inherit nothing. Repeated rows are treated alike.
    Columns of files with the names of results are replaced.
    """
    spark = files.sparkSession
    scratch = C.Scratch(spark, "licenses")
    own = [c for c in files.columns if c not in ("license", "method", "cosine", "license_dir")]
    rows = files.select(F.col(path_col).alias("p"), _is_licence(path_col).alias("is_file"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("p IS NOT NULL")

    def alike(rows: DataFrame, unit: Column, against, term: str, name: str) -> DataFrame:
        """p, is_file, license, cosine: what each unit of a text is most like. Texts without any of the
        terms that a unit needs have none to be compared."""
        needed = _needed(against, term, least)
        units = rows.where(_holds_any(F.lower("text"), needed)).select("p", "is_file", F.explode(unit).alias("said"))
        some = units.where(_holds_any(F.lower("said"), needed)).where(_may_be_alike("said", against, term, least)).where(~F.col("said").rlike(DENIED))
        some = scratch.save(some.withColumn("line", F.sha2("said", 256)), name)
        scored = score_lines(some.select("line", "said").distinct(), said="said", against=against, term=term).where(F.col("cosine") >= least)
        return some.select("p", "is_file", "line").distinct().join(scored, "line").select("p", "is_file", "license", "cosine")

    bare = F.regexp_replace("text", MARKS, "")
    found = alike(rows, F.split("text", "\n"), TEMPLATES, TERM, "lines")
    found = found.unionByName(alike(rows, F.split(bare, BLANK), BLOCKS, WORD, "blocks"))
    found = found.unionByName(alike(rows.where("is_file"), F.array(bare), TEXTS, WORD, "texts"))
    ids = {name.lower(): name for name, _ in TEMPLATES + BLOCKS + TEXTS} | ALIASES
    named = rows.where(F.contains(F.lower("text"), F.lit("spdx"))).select("p", "is_file", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("id"))
    named = named.select("p", "is_file", F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.lower("id")).alias("license"), F.lit(1.0).alias("cosine")).where("license IS NOT NULL")
    best = found.unionByName(named).groupBy("p", "is_file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b"))
    best = scratch.save(best.select("p", "is_file", F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine")), "best")
    dirs = best.where("is_file").select(F.regexp_replace("p", "/?[^/]*$", "").alias("dir"), F.struct((-F.col("cosine")).alias("c"), F.col("p").alias("by"), F.col("license").alias("l")).alias("b"))
    dirs = scratch.save(dirs.groupBy("dir").agg(F.min("b").alias("b")).select("dir", F.col("b.l").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine")), "dirs")
    # Directories are few beside files: the licence of each is found once, by its ancestors.
    places = rows.select(F.regexp_replace("p", "/?[^/]*$", "").alias("place")).distinct()
    up = places.select("place", F.explode(_ancestors(F.concat("place", F.when(F.col("place") == "", "").otherwise("/"), F.lit("x")))).alias("a")).select("place", "a.depth", "a.dir")
    near = up.join(dirs, "dir").groupBy("place").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_cosine")).alias("n"))
    near = scratch.save(near.select(F.col("place").alias("_np"), F.col("n.dir").alias("_nd"), F.col("n.dir_license").alias("_nl"), F.col("n.dir_cosine").alias("_nc")), "near")
    scratch.drop_all_but("best", "near")
    best = best.select(F.col("p").alias("_bp"), F.col("is_file").alias("_bf"), F.col("license").alias("_bl"), F.col("cosine").alias("_bc"))
    out = files.select(*(files[c] for c in own), F.col(path_col).alias("_p"), F.regexp_replace(F.col(path_col), "/?[^/]*$", "").alias("_place"))
    out = out.join(best, F.col("_p") == F.col("_bp"), "left").join(near, F.col("_place") == F.col("_np"), "left")
    has, above = F.col("_bl").isNotNull(), F.col("_nl").isNotNull()
    method = F.when(has & F.col("_bf"), "file").when(has, "header").when(above, "inherited").otherwise("none")
    return out.select(*own, F.coalesce("_bl", "_nl").alias("license"), method.alias("method"), F.when(has, F.col("_bc")).otherwise(F.col("_nc")).alias("cosine"), F.when(~has & above, F.col("_nd")).alias("license_dir"))



#: The query's file tree: source/language/id.txt. A text of up to 40 words counts as the licence
#: file of its directory, an English one as that of its source.


def op8_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    short = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " ")) <= 40
    licence = short & F.coalesce(F.col("text").rlike("(?i)licen[cs]e"), F.lit(False))
    name = F.when(licence, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    home = F.when(licence & (F.col("lang") == "en"), F.coalesce("source", F.lit(""))).otherwise(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    files = docs.select("doc_id", "text", F.concat_ws("/", home, name).alias("path"))
    return scan_licenses(files).select("doc_id", "path", "license", "method", "cosine", "license_dir")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _sql() -> str:
    rows, idf, other = _template_terms()
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(string_split(trim(coalesce(text, '')), ' ')) <= 40 AND regexp_matches(coalesce(text, ''), '(?i)licen[cs]e') AS lic, lang, source FROM documents),
f AS (SELECT doc_id, text, lic, CASE WHEN lic AND lang = 'en' THEN source ELSE source || '/' || lang END AS dir,
             CASE WHEN lic THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name FROM d),
t(k, license, term, weight) AS (VALUES {_values(rows)}), i(term, idf) AS (VALUES {_values(sorted(idf.items()))}),
l AS (SELECT DISTINCT doc_id, lic, line FROM (SELECT doc_id, lic, unnest(string_split(text, chr(10))) AS line FROM f) WHERE trim(line) <> '' AND NOT regexp_matches(line, '{DENIED}')),
w AS (SELECT line, term, count(*) * coalesce(any_value(CAST(idf AS DOUBLE)), CAST({other!r} AS DOUBLE)) AS w FROM (SELECT line, unnest([x FOR x IN regexp_extract_all(lower(line), '{TERM}') IF x NOT IN ({', '.join(repr(c) for c in COMMON.split())})]) AS term FROM (SELECT DISTINCT line FROM l)) LEFT JOIN i USING (term) GROUP BY 1, 2),
s AS (SELECT line, license, k, sum(w * CAST(weight AS DOUBLE)) AS dot FROM w JOIN t USING (term) GROUP BY 1, 2, 3),
n AS (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
c AS (SELECT line, license, round(dot / norm, 6) AS cosine FROM s JOIN n USING (line)),
b AS (SELECT line, license, cosine FROM c QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, license) = 1),
o AS (SELECT doc_id, lic, license, cosine FROM l JOIN b USING (line) WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
g AS (SELECT dir, license, cosine FROM o JOIN f USING (doc_id) WHERE o.lic QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, dir || '/' || name) = 1),
a AS (SELECT f.doc_id, g.dir, g.license, g.cosine FROM f JOIN g ON f.dir = g.dir OR f.dir LIKE g.dir || '/%' QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.dir) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || f.name AS path, coalesce(o.license, a.license) AS license,
       CASE WHEN o.license IS NOT NULL AND o.lic THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
       coalesce(o.cosine, a.cosine) AS cosine, CASE WHEN o.license IS NULL THEN a.dir END AS license_dir
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN a USING (doc_id)
"""


OP8_SQL = _sql()
