"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Every line that speaks of a license is a header, and so are the block of lines around
it and, in a license file, the whole text. A header's terms, weighted by inverse
document frequency over all headers of the corpus, are compared with each template's.
A file that is mostly license lines is a license file and stands for its directory. A
file without a license of its own takes that of its nearest ancestor directory, found
by joins on path.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
#: Notices and short whole texts by which the licenses are commonly known.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution CC BY 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """ + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
_CUES = "licen[cs]|copyright|permission is hereby|redistribution and use|creative commons|public domain|hereby granted"
CUE = re.compile(_CUES, re.IGNORECASE)
LICENSE_FILE = re.compile(r"(^|/)(un)?(licen[cs]e|copying)[^/]*$", re.IGNORECASE)
TERM = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


def headers_of(text: str, path: str | None, file_share: float) -> tuple[list[str], bool]:
    """The headers of a text (lines, blocks of lines between blank ones, a license file's whole text), and whether it is a license file."""
    lines = [x for x in text.split("\n") if x.strip()]
    found = [x for x in lines if CUE.search(x)]
    if not found:
        return [], False
    is_file = len(found) >= file_share * len(lines) or bool(LICENSE_FILE.search(path or ""))
    blocks = [b for b in re.split(r"\n[^\S\n]*\n", text) if CUE.search(b) and b.count("\n")]
    return list(dict.fromkeys([*found, *blocks, *([text] if is_file and len(lines) > 1 else [])])), is_file


def headers(docs: DataFrame, path_col: str, id_col: str, text_col: str, file_share: float) -> DataFrame:
    """(_row, doc_id, path, lines, file) of every document: its headers, and whether it is a license file.

    Written once: the row numbers must not be made anew when the table is read again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.when(F.lower(text).rlike(_CUES), text).otherwise("").alias("text")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [headers_of(t, p, file_share) for t, p in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                lines, files = pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([y for _, y in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "doc_id", "path")], lines, files], names=["_row", "doc_id", "path", "lines", "file"])

    return stored(rows.mapInArrow(run, "_row long, doc_id long, path string, lines array<string>, file boolean"), "headers")


def _held_join(left: DataFrame, right: DataFrame, on: str, times: str, total: int) -> DataFrame:
    """``left`` joined to ``right``, whose ``times`` says how many of the ``total`` rows of ``left`` hold its key.

    Keys that hold more than one row in 10,000 are less than 10,000 and are broadcast, so no task gets a hot key.
    """
    often = F.col(times) * 10_000 > total
    common, other = right.where(often).drop(times), right.where(~often).drop(times)
    return left.join(F.broadcast(common), on).unionByName(left.join(F.broadcast(common.select(on)), on, "left_anti").join(other, on))


def best_templates(found: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(key, license, score, times) of the different headers whose greatest cosine to a template reaches the threshold; among equals the first name.

    ``found`` has a header's ``line`` and its SHA-256 as ``key``; only the key goes with the terms. A term's
    weight is its smoothed inverse frequency over all headers, of every term that a header or a template holds.
    """
    spark = found.sparkSession
    lines = found.groupBy("key").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("times"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(TERM.pattern), F.lit(0))
    held = stored(lines.select("key", "times", F.explode(words).alias("term")).groupBy("key", "times", "term").agg(F.count(F.lit(1)).alias("c")), "terms")
    own = [(i, name, t, c) for i, (name, text) in enumerate(templates) for t, c in Counter(terms(text)).items()]
    fixed = spark.createDataFrame(own, "template int, license string, term string, c long")
    n, pairs = found.count(), held.count()
    seen = held.select("term", "times", F.lit(1).alias("pair")).unionAll(fixed.select("term", F.lit(0).cast("long"), F.lit(0)))
    df = seen.groupBy("term").agg(F.sum("times").alias("df"), F.sum("pair").alias("pairs"))
    weights = stored(df.select("term", "pairs", (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1).alias("weight")), "weights")
    # the templates are a fixed list: their vectors, one column for each, are small at every size
    y = fixed.join(weights.drop("pairs"), "term").withColumn("y", F.col("c") * F.col("weight"))
    sizes = y.groupBy("template").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("size"))
    unit = y.join(sizes, "template").select("template", "term", (F.col("y") / F.col("size")).alias("y"))
    sides = [f"y{i}" for i in range(len(templates))]
    b = unit.groupBy("term").agg(*[F.sum(F.when(F.col("template") == i, F.col("y"))).alias(side) for i, side in enumerate(sides)])
    x = _held_join(held, weights, "term", "pairs", pairs).select("key", "times", "term", (F.col("c") * F.col("weight")).alias("x"))
    # norms and products in one pass over the weighted terms, which are not written
    sums = x.join(F.broadcast(b), "term", "left").groupBy("key", "times").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.col(side)).alias(side) for side in sides])
    scores = F.array(*[F.struct(F.round(-F.col(side) / F.col("norm"), 12).alias("less"), F.lit(name).alias("license")) for side, (name, _) in zip(sides, templates, strict=True)])
    # the highest score; among equals the first name
    lead = F.array_min(F.filter(scores, lambda s: s["less"] <= -threshold))
    best = sums.select("key", "times", lead.alias("b")).where("b is not null").select("key", "times", F.struct(F.col("b.license").alias("license"), (-F.col("b.less")).alias("score")).alias("b"))
    return stored(best.select("key", "times", "b.*"), "lines")


def scan(
    docs: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, file_share: float = 0.5, templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """doc_id, license, score and origin (own, inherited or none) of every document.

    A license file is a document whose license lines are at least ``file_share``
    of its lines, or whose name begins with LICENSE, LICENCE, UNLICENSE or COPYING; several
    in one directory: the highest score, then the first template, counts. Null
    texts are empty; a null path has no directory; repeated and null ids and
    repeated rows are ordinary rows; an empty table gives no row.
    """
    base = headers(docs, path_col, id_col, text_col, file_share)
    found = base.where(F.size("lines") > 0).select("_row", "path", "file", F.explode("lines").alias("line")).withColumn("key", F.unhex(F.sha2("line", 256)))
    best = best_templates(found, templates, threshold)
    scored = _held_join(found.drop("line"), best, "key", "times", found.count())
    # the highest score; among equals the first name
    lead = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    own = stored(scored.groupBy("_row").agg(lead.alias("o"), F.max("file").alias("file"), F.first("path").alias("path")).select("_row", "path", "file", "o.*"), "own-licenses")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    files = own.where("file and path like '%/%'")
    folders = files.groupBy(folder.alias("folder")).agg(lead.alias("f")).select("folder", F.col("f.license").alias("f_license"), F.col("f.score").alias("f_score"))
    rows = base.select("_row", "doc_id", "path")
    bare = rows.join(own.select("_row"), "_row", "left_anti")
    inside = bare.where("path like '%/%'").select("_row", folder.alias("inner"))
    # each directory looks up its ancestors once, however many documents it holds
    dirs = stored(inside.groupBy("inner").agg(F.count(F.lit(1)).alias("times")), "directories")
    parts = F.split("inner", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    above = dirs.select("inner", "times", F.explode(chain).alias("a")).select("inner", "times", "a.*")
    reach = above.groupBy("folder").agg(F.count(F.lit(1)).alias("dirs")).join(folders, "folder")
    near = _held_join(above, reach, "folder", "dirs", above.count()).groupBy("inner", "times").agg(F.max_by(F.struct("f_license", "f_score"), "depth").alias("i"))
    nearest = _held_join(inside, near.select("inner", "times", "i.*"), "inner", "times", inside.count()).drop("inner")
    return (
        rows.join(own.select("_row", "license", "score"), "_row", "left")
        .join(nearest, "_row", "left")
        .select(
            "doc_id",
            F.coalesce("license", "f_license").alias("license"),
            F.round(F.coalesce("score", "f_score"), 6).alias("score"),
            F.when(F.col("license").isNotNull(), "own").when(F.col("f_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        )
    )
