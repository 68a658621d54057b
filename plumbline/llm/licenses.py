"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages are the lines of a document that speak of a licence, the blocks of lines around them (paragraphs and headers in
comments) and the whole text. Lines are compared with short notices, blocks with whole headers and whole licences
too, the whole text with whole licences. Their words and word pairs, weighted by TF-IDF with
document frequencies over all distinct lines of the corpus and all short notices, are compared with each template by
cosine. A document that is a licence file, by its name or because most of its words are licence lines or its text is near a whole licence, gives its
licence to its directory; documents without one of their own take that of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

#: Short notices and openings of well-known licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3, 19 November 2007"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Notices that stand at the head of a file, over several lines.
HEADERS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Words that open a passage, and names of licence files.
CUES = r"(?i)licen[cs]|copyright|creative commons|\bcc0\b|free of charge|public domain|redistribut"
FILE_NAMES = r"(?i)(^|/)(licen[cs]es?|copying|copyright|notice|unlicense)([.-][a-z0-9.-]*)?$"


#: A line without letters and digits ends a paragraph; a line that does not start as a comment ends a header.
_GAP, _CODE = r"\n[^\p{L}\p{N}\n]*(?=\n)", r"\n(?![ \t]*(?:#|//|/\*|\*|--|;|%|<!--))"


def full_texts() -> dict[str, str]:
    """Whole licences by name."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def blocks(text: Column) -> Column:
    """Paragraphs and headers in comments that hold a cue."""
    return F.array_distinct(F.filter(F.concat(F.split(text, _GAP), F.split(text, _CODE)), lambda x: x.rlike(CUES)))


def terms(text: Column) -> Column:
    """Lower-case words, with inner dots of versions, and pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def hashed_terms(text: Column) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def _key(text: str) -> Column:
    """128 bits that stand for a text where it would be shuffled with each of its terms."""
    return F.unhex(F.md5(text))


def _weights(texts: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """texts (key, text) -> (key, term, x): TF-IDF of length 1. Terms, as 64-bit hashes, without a frequency count as seen
    in no passage."""
    counted = texts.select("key", F.explode(hashed_terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    w = counted.join(frequency, "term", "left").withColumn("x", (1 + F.log("tf")) * idf)
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return w.join(norm, "key").select("key", "term", (F.col("x") / F.col("norm")).alias("x"))


def within_reach(longer: DataFrame, known: DataFrame, frequency: DataFrame, n: int, least: float) -> DataFrame:
    """Those rows of longer (key, text, whole) that can reach the least cosine to some text of known; no other can.

    A cosine is at most the share of the length that lies in the terms of all known texts, and a term weighs no less
    than one that is in every passage. So nothing but the rows that stay need the frequencies of all their terms.
    """
    met = known.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("name")).distinct().withColumn("term", F.xxhash64("name")).join(frequency, "term", "left").toArrow()
    idf = {t: math.log((n + 1) / ((df or 0) + 1)) + 1 for t, df in zip(met["name"].to_pylist(), met["df"].to_pylist())}
    held = longer.sparkSession.sparkContext.broadcast(idf)
    word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

    def run(batches):
        for batch in batches:
            stay = []
            for text in batch.column(3).to_pylist():
                w = word.findall(text)
                inside = outside = 0.0
                for t, tf in Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]).items():
                    x = 1 + math.log(tf)
                    if (i := held.value.get(t)) is None:
                        outside += x * x
                    else:
                        inside += x * x * i * i
                stay.append(inside >= (least * least - 1e-6) * (inside + outside) and inside > 0)
            yield batch.filter(pa.array(stay, pa.bool_())).select([0, 1, 2])

    return longer.select("key", "text", "whole", F.lower("text").alias("lower")).mapInArrow(run, "key binary, text string, whole boolean")


def match_passages(passages: DataFrame, scratch: Scratch, templates: dict[str, list[str]], least: float, longer: DataFrame | None = None, headers: dict[str, list[str]] | None = None, full: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """passages (text), distinct -> (text, license, score) for those near enough to a template.

    longer (key, text, whole) -> (key, whole, license, score): blocks against templates, headers and
    whole licences, whole texts against whole licences alone. They are weighed by the frequencies of the passages.
    """
    spark = passages.sparkSession
    rows = [(f"{name}\t{i}", t) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    known = spark.createDataFrame(rows, "key string, text string")
    keyed = scratch.keep(passages.select(_key("text").alias("key"), "text"), "passages")
    frequency = keyed.select("text").unionAll(known.select("text")).select(F.explode(F.array_distinct(hashed_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    frequency = scratch.keep(frequency, "terms")
    n = keyed.count() + len(rows)

    def nearest(own: DataFrame, known: DataFrame) -> DataFrame:
        theirs = _weights(known, frequency, n).select(F.col("key").alias("template"), "term", F.col("x").alias("y"))
        near = _weights(own, frequency, n).join(theirs, "term").groupBy("key", "template").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("score")).where(F.col("score") >= least)
        best = near.groupBy("key").agg(F.min(F.struct(-F.col("score"), F.substring_index("template", "\t", 1).alias("license"))).alias("b"))
        return best.select("key", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"))

    short = nearest(keyed, known).join(keyed, "key").select("text", "license", "score")
    if longer is None:
        return short, None
    whole = [(f"{name}\tfull", t) for name, t in sorted((full or {}).items())]
    more = rows + whole + [(f"{name}\th{i}", t) for name, texts in sorted((headers or {}).items()) for i, t in enumerate(texts)]
    every = spark.createDataFrame(more, "key string, text string")
    longer = scratch.keep(within_reach(longer, every, frequency, n, least).distinct(), "blocks")
    parts = [nearest(longer.where(cond).select("key", "text"), spark.createDataFrame(ts, "key string, text string")).withColumn("whole", F.lit(flag)) for cond, ts, flag in (("not whole", more, False), ("whole", whole, True)) if ts]
    return short, parts[0].unionAll(parts[1]) if len(parts) > 1 else parts[0]


def scan_licenses(docs: DataFrame, scratch: Scratch, path: Column, templates: dict[str, list[str]] | None = None, least: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """docs (doc_id, text) and an expression for their path -> doc_id, path, license, score, origin, directory.

    Templates given take the place of all built-in ones. origin is 'own' where a passage of the document itself is near a template (the nearest one counts; ties go to the
    first licence by name), 'inherited' where an ancestor directory has a licence file (directory names it), else null.
    All lines of whole texts are looked at; null and empty texts have none. Repeated rows come back alike; a null path
    inherits nothing. Among several licence files of a directory the nearest to its template counts. Passages are made
    distinct before they are weighed, so a notice that a third of all documents share is weighed once. An empty table
    gives no rows; other columns are ignored.
    """
    base = docs.select("doc_id", path.alias("path"), "text")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(CUES))
    found = base.withColumn("lines", lines).where(F.size("lines") > 0)
    words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    share = words(F.array_join("lines", "\n")) / F.greatest(words(F.col("text")), F.lit(1))
    found = scratch.keep(found.select("doc_id", "path", "lines", share.alias("share")), "found")
    passages = found.select(F.explode("lines").alias("text")).distinct()
    cued = base.where(F.col("text").rlike(CUES))
    pieces = cued.select("doc_id", "path", F.explode(F.concat(F.transform(blocks(F.col("text")), lambda x: F.struct(x.alias("text"), F.lit(False).alias("whole"))), F.array(F.struct("text", F.lit(True).alias("whole"))))).alias("p"))
    pieces = pieces.select("doc_id", "path", "p.text", "p.whole", _key("p.text").alias("key"))
    longer = pieces.select("key", "text", "whole")
    matched, wider = match_passages(passages, scratch, templates or TEMPLATES, least, longer, None if templates else HEADERS, None if templates else full_texts())
    matched, wider = scratch.keep(matched, "matched"), scratch.keep(wider, "matched-blocks")

    hits = found.select("doc_id", "path", "share", F.explode("lines").alias("text")).join(matched, "text").select("doc_id", "path", "share", "license", "score")
    in_blocks = scratch.keep(pieces.select("doc_id", "path", "key", "whole").join(wider, ["key", "whole"]).select("doc_id", "path", "whole", "license", "score"), "hits")
    shares = found.select("doc_id", "path", "share")
    together = in_blocks.join(shares.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), "share").distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p")))
    hits = hits.unionAll(together.select("doc_id", "path", F.when(F.col("whole"), 1.0).otherwise(F.col("share")).alias("share"), "license", "score"))
    own = hits.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max("share").alias("share"))
    own = scratch.keep(own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), "share"), "own")

    directory = F.regexp_replace("own_path", "/?[^/]*$", "")
    files = own.where(F.col("own_path").rlike(FILE_NAMES) | (F.col("share") >= file_share)).withColumn("dir", directory)
    given = files.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("b")).select("dir", F.col("b.license").alias("given"), (-F.col("b.s")).alias("given_score"))
    given = scratch.keep(given, "given")

    rows = base.select("doc_id", "path").join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    rows = rows.select("doc_id", "path", "own_license", "own_score")
    # the ancestors of a distinct directory: as many rows as it has parts
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    dirs = base.where("path is not null").select(F.regexp_replace("path", "/?[^/]*$", "").alias("of"), parts.alias("parts")).distinct()
    up = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", 1, i), "/").alias("dir")))).alias("a")).select("of", "a.depth", "a.dir")
    nearest = up.join(given, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "given", "given_score")).alias("g"))
    nearest = nearest.select("of", F.col("g.dir").alias("directory"), F.col("g.given").alias("given"), F.col("g.given_score").alias("given_score"))
    out = rows.withColumn("of_dir", F.regexp_replace("path", "/?[^/]*$", "")).join(nearest, F.col("of_dir") == F.col("of"), "left")
    is_own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own_license", "given").alias("license"),
        F.coalesce("own_score", "given_score").alias("score"),
        F.when(is_own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(~is_own, F.col("directory")).alias("directory"),
    )
