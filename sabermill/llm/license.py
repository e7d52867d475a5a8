"""Licence scan: sparse TF-IDF cosine of blocks of lines and whole files to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Weights are boolean term frequency times idf = ln((1 + N) / (1 + df)) + 1, with df counted over all files for every term of every block that is compared, so that common words
lower a cosine little. Blocks are windows of adjacent lines in a few sizes. A block can only reach the least cosine with a template if the terms that they share weigh enough by
themselves, whatever else it says; blocks that fail this are left out before document frequencies are looked up. Templates and the idf of their terms are the only data on the driver.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from sabermill.llm.shared import Scratch

#: The notices looked for, by licence; several texts of one licence are parted by the names after the slash.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": "Released under the MIT License.",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
}

#: Least cosine of a block, and of a whole file that counts as the licence file of its directory; lines of a block.
LINE, FILE, BLOCKS = 0.75, 0.35, (1, 4, 10)

_SPLIT = "[^a-z0-9]+"


def terms(text: str) -> list[str]:
    return sorted({t for t in re.split(_SPLIT, text.lower()) if t})


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _needed(own: dict[str, list[str]], weight: dict[str, float]) -> list[str]:
    """Terms of which every line at least LINE from a template has one: dot >= LINE^2 |t|^2 must hold, so terms worth more than the rest can't all be missing."""
    out: set[str] = set()
    for ts in own.values():
        need, got = (1 - LINE**2) * sum(weight[t] for t in ts), 0.0
        for t in sorted(ts, key=lambda t: (-weight[t], t)):
            if got > need:
                break
            out.add(t)
            got += weight[t]
    return sorted(out)


def license_scan(files: DataFrame, scratch: Scratch, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, path, license, origin, similarity, matched_lines) of each file.

    ``origin``: 'header' (a block of 1, 4 or 10 adjacent lines of the file is at least LINE from a template: the best such), 'inherited' (the nearest directory at or above the file's that has a licence file
    gives its licence; a licence file has such a block and is as a whole at least FILE from a template; of several, the most similar, then the first by name) or 'none' (license '').
    ``similarity``: of the best block; ``matched_lines``: single lines of at least LINE. Equal cosines go to the template first by name; a template's name up to a slash is its licence.
    Null text: no lines; null path: '' and so no directory; repeated rows keep a row each; an empty table gives no rows; other columns are not read. Every line of every text is looked at, without a
    shuffle; shuffled are counts by term, the terms of blocks that may match, and directories, which Spark joins back as their size allows.
    """
    templates = templates or TEMPLATES
    names = sorted(templates)
    own = {n: terms(templates[n]) for n in names}
    vocabulary = sorted({t for ts in own.values() for t in ts})
    src = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    hits = src.select(F.explode(F.expr(f"array_intersect(split(low, '{_SPLIT}'), {_array(vocabulary)})")).alias("t"))
    df = {r["t"]: r["n"] for r in hits.groupBy("t").agg(F.count("*").alias("n")).collect()}
    n = src.count()
    weight = {t: (math.log((1 + n) / (1 + df.get(t, 0))) + 1) ** 2 for t in vocabulary}
    norm = {name: sum(weight[t] for t in own[name]) for name in names}
    table = "map(" + ", ".join(f"'{t}', {w!r}D" for t, w in weight.items()) + ")"

    def distinct(text: str) -> str:
        return f"array_distinct(filter(split({text}, '{_SPLIT}'), x -> x <> ''))"

    def enough(words: str) -> str:
        """Whether what a block shares with some template weighs enough for LINE."""
        return " OR ".join(f"aggregate(array_intersect({words}, {_array(own[t])}), 0D, (a, x) -> a + element_at({table}, x)) >= {LINE**2 * norm[t] * (1 - 1e-9)!r}D" for t in names)

    def blocks(k: int) -> str:
        starts = f"filter(sequence(1, size(lines) - {k - 1}), i -> exists(slice(flags, i, {k}), f -> f))"
        body = f"array_join(slice(lines, i, {k}), ' ')"
        found = f"transform({starts}, i -> struct({k} AS k, {distinct(body)} AS words))"
        return f"if(size(lines) >= {k}, filter({found}, b -> {enough('b.words')}), array())"

    needed = "|".join(_needed(own, weight))
    # a file of which all words together are not enough has no block that is; only the others are cut into lines
    marked = src.withColumn("hit", F.expr(f"array_intersect(split(low, '{_SPLIT}'), {_array(vocabulary)})"))
    marked = marked.select("id", "path", "low", F.monotonically_increasing_id().alias("row"), F.expr(f"if({enough('hit')}, split(low, '\n'), array())").alias("lines"))
    marked = marked.withColumn("flags", F.expr(f"transform(lines, l -> l rlike '{needed}')"))
    marked = marked.withColumn("blocks", F.expr(f"concat({', '.join(blocks(k) for k in BLOCKS)})"))
    whole = F.expr(f"if(size(blocks) > 0, array_append(blocks, struct(0 AS k, {distinct('low')} AS words)), array())")
    found = scratch.write(marked.select("row", "id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), whole.alias("blocks")), "found")
    said = found.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.k", F.explode("b.words").alias("t"))
    said = scratch.write(said, "terms")
    wanted = scratch.write(said.select("t").distinct(), "wanted")  # a table of known size, so that Spark broadcasts it while it is small
    # counted before the join, which is inner as a semi-join would be pushed below the count: a task sends each of its terms once, not once a file
    counted = src.select(F.explode(F.expr(distinct("low"))).alias("t")).groupBy("t").agg(F.count("*").alias("df")).join(wanted, "t")
    w = F.pow(F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1, 2)
    dots = [F.sum(F.when(F.col("t").isin(own[name]), F.col("w")).otherwise(0.0)).alias(f"d{i}") for i, name in enumerate(names)]
    cosine = [F.struct(F.round(F.col(f"d{i}") / F.sqrt(F.col("norm") * F.lit(norm[name])), 6).alias("s"), F.lit(-i).alias("order"), F.lit(name.split("/")[0]).alias("license")) for i, name in enumerate(names)]
    scored = said.join(counted.select("t", w.alias("w")), "t").groupBy("row", "block", "k").agg(F.sum("w").alias("norm"), *dots).select("row", "k", F.array_max(F.array(*cosine)).alias("b"))
    near = (F.col("k") > 0) & (F.col("b.s") >= LINE)
    best = scored.groupBy("row").agg(F.count_if(near & (F.col("k") == 1)).alias("matched"), F.max(F.when(near, F.col("b"))).alias("top"), F.max(F.when(F.col("k") == 0, F.col("b.s"))).alias("whole")).where("top IS NOT NULL")
    files = found.select("row", "id", "path", "dir").join(scratch.write(best, "best"), "row", "left")
    given = files.where(f"top IS NOT NULL AND whole >= {FILE} AND path <> ''").groupBy("dir").agg(F.min(F.struct((-F.col("whole")).alias("w"), "top.license")).alias("g")).select(F.col("dir").alias("above"), F.col("g.license").alias("given"))
    given = scratch.write(given, "given")
    root = given.where("above = ''").agg(F.first("given").alias("root"))  # one row, whatever there is
    above = F.expr("transform(sequence(1, size(split(dir, '/'))), i -> struct(i AS depth, array_join(slice(split(dir, '/'), 1, i), '/') AS above))")
    ancestors = found.where("dir <> ''").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    nearest = ancestors.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "given")).alias("m")).select(F.col("dir").alias("of"), "m.given")
    joined = files.join(nearest, F.col("dir") == F.col("of"), "left").join(F.broadcast(root)).withColumn("given", F.coalesce("given", "root"))
    header, inherited = F.col("top").isNotNull(), F.col("given").isNotNull() & (F.col("path") != "")
    return joined.select(
        "id", "path",
        F.when(header, F.col("top.license")).when(inherited, F.col("given")).otherwise("").alias("license"),
        F.when(header, "header").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.coalesce("top.s", F.lit(0.0)).alias("similarity"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched_lines"),
    ).withColumnRenamed("id", id_col)


def oracle(files: str, id_col: str = "doc_id", templates: dict[str, str] | None = None) -> str:
    """``license_scan`` over a subquery (id_col, path, text) in DuckDB SQL, all blocks and templates compared without any shortcut."""
    templates = templates or TEMPLATES
    rows = ", ".join(f"({i}, '{n.split('/')[0]}', [{', '.join(repr(t) for t in terms(templates[n]))}])" for i, n in enumerate(sorted(templates)))
    words = "list_distinct(list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda x: x <> ''))"
    sizes = " UNION ALL ".join(f"SELECT id, {k} AS k, array_to_string(lines[i : i + {k - 1}], ' ') AS body FROM (SELECT id, lines, unnest(range(1, len(lines) - {k - 2})) AS i FROM l WHERE len(lines) >= {k})" for k in BLOCKS)
    return f"""
WITH f AS (SELECT {id_col} AS id, coalesce(path, '') AS path, lower(coalesce(text, '')) AS low FROM ({files})),
tpl(o, license, ts) AS (VALUES {rows}),
own AS (SELECT o, license, unnest(ts) AS t FROM tpl),
total AS (SELECT count(*) AS n FROM f),
w AS (SELECT t, pow(ln((1 + any_value(n)) / (1 + count(*))) + 1, 2) AS w FROM (SELECT unnest({words.format('low')}) AS t FROM f), total GROUP BY t),
tnorm AS (SELECT o, license, sum(coalesce(w, pow(ln(1 + n) + 1, 2))) AS tn FROM own LEFT JOIN w USING (t), total GROUP BY o, license),
l AS (SELECT id, string_split(low, chr(10)) AS lines FROM f),
seg AS (SELECT row_number() OVER () AS seg, id, k, words FROM (SELECT id, k, {words.format('body')} AS words FROM ({sizes} UNION ALL SELECT id, 0, low FROM f))),
term AS (SELECT seg, unnest(words) AS t FROM seg),
norm AS (SELECT seg, sum(w) AS sn FROM term JOIN w USING (t) GROUP BY seg),
dot AS (SELECT seg, o, license, sum(w) AS d FROM term JOIN own USING (t) JOIN w USING (t) GROUP BY seg, o, license),
best AS (SELECT seg, dot.o, dot.license, round(d / sqrt(sn * tn), 6) AS s FROM dot JOIN norm USING (seg) JOIN tnorm ON tnorm.o = dot.o QUALIFY row_number() OVER (PARTITION BY seg ORDER BY round(d / sqrt(sn * tn), 6) DESC, dot.o) = 1),
near AS (SELECT id, k, o, license, s FROM seg JOIN best USING (seg) WHERE k > 0 AND s >= {LINE}),
top AS (SELECT id, license, s, count(*) FILTER (k = 1) OVER (PARTITION BY id) AS matched FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o) = 1),
found AS (SELECT f.id, path, matched, top.license, top.s, CASE WHEN matched IS NOT NULL THEN wb.s END AS whole, regexp_replace(path, '/?[^/]*$', '') AS dir
  FROM f LEFT JOIN top USING (id) LEFT JOIN (SELECT id, s FROM seg JOIN best USING (seg) WHERE k = 0) wb USING (id)),
given AS (SELECT dir AS above, license AS given FROM found WHERE whole >= {FILE} AND path <> '' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY whole DESC, license) = 1),
above AS (SELECT d.dir, given FROM (SELECT DISTINCT dir FROM found WHERE path <> '') d JOIN given ON above = '' OR d.dir = above OR starts_with(d.dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(above) DESC) = 1)
SELECT id AS {id_col}, path, CASE WHEN matched IS NOT NULL THEN license WHEN given IS NOT NULL AND path <> '' THEN given ELSE '' END AS license,
  CASE WHEN matched IS NOT NULL THEN 'header' WHEN given IS NOT NULL AND path <> '' THEN 'inherited' ELSE 'none' END AS origin, CAST(coalesce(s, 0) AS DOUBLE) AS similarity, CAST(coalesce(matched, 0) AS BIGINT) AS matched_lines
FROM found LEFT JOIN above ON above.dir = found.dir"""
