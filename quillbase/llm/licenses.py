"""Licence scans: sparse TF-IDF cosine of licence lines to templates, and inheritance from directories.

Only DataFrame functions: lines that speak of licences become (line, term, count) rows, are joined with
the templates' weights on the term and summed per line and template. Each distinct line is scored once,
however many files have it. The comments that a file begins with are compared as one text with the headers
that licences prescribe, and the whole text of a file that is named as a licence file with licence texts, in
blocks that overlap. A file that is named so, or a text that is nothing but licence, declares its directory's
licence; a file of code never does. A file without a licence of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import SPACE_CLASS, cut, scratch, small_enough_to_broadcast
from quillbase.llm.license_texts import HEADERS, TEXTS

THRESHOLD = 0.6
#: A licence file is compared in blocks of so many words, each a quarter of a block after the one before; a block, or the comments at a file's front, must come this close to a licence's text or header.
BLOCK_WORDS, TEXT_THRESHOLD = (130, 260), 0.75
#: Of nothing but licence: so much of a text's words, in per cent, stands in its licence lines or header.
WHOLE_PERCENT = 90
#: The comments and blank lines that a text begins with; the mark of a comment at the front of a line; lines that name a holder.
HEAD = r"^(?:[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*(?:\n|$)|[ \t]*\n)+"
MARKS = r"(^|\n)[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)"
HOLDERS = r"(?i)(^|\n)[^\n]*(?:copyright|\(c\)|spdx)[^\n]*"
#: Names of files that are code whatever they are called.
CODE = r"\.(py|pyi|js|mjs|ts|jsx|tsx|c|h|cc|cpp|hpp|java|go|rs|rb|sh|php|cs|kt|swift|scala|pl|lua|sql|css|vue)$"
#: Names of files whose text isn't code: without an extension, or with one of these.
PROSE = r"^[^.]*$|\.(txt|md|rst|html?)$"
#: Names of files that hold a licence, in lower case.
FILE_NAMES = r"^(.*[-_.])?(licen[cs]e|copying|unlicense)([-_.].*)?$"
#: Words that a line must have one of to be looked at; all in lower case.
CUES = ("licen", "copyright", "rights reserved", "spdx", "public domain", "permission is hereby", "redistribution and use")

# Licence names, and header or licence text in their usual words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def idf_weights(templates: Sequence[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, unit weight) rows, each term's idf, and the idf of a term in no template."""
    counts = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]
    held = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + k)) + 1 for t, k in held.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(templates)) + 1


def _cued(text: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | text.contains(cue)
    return found


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")).cast("long")


def score_lines(spark: SparkSession, lines: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(line, license, score): the best template of each distinct ``line``; ties go to the first name."""
    rows, idf, unseen = idf_weights(templates)
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, w double"))  # a fixed table
    own = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    terms = lines.select("line").distinct().select("line", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    terms = terms.groupBy("line", "term").agg(F.count(F.lit(1)).alias("n")).join(own, "term", "left")
    terms = terms.withColumn("v", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    norms = terms.groupBy("line").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = terms.join(weights, "term").groupBy("line", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "line").select("line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("line", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _blocks(rows: DataFrame) -> DataFrame:
    """(path, line): the texts of licence files in overlapping blocks of either size of ``BLOCK_WORDS``."""
    words = rows.where(_is_licence_file(F.col("path"))).select("path", F.array_remove(F.split("body", f"[{SPACE_CLASS}]+"), "").alias("w")).where(F.size("w") > 0)

    def of(size: int) -> Column:
        last = F.greatest(F.size("w") - size, F.lit(0)) + 1
        starts = F.array_union(F.sequence(F.lit(1), last, F.lit(size // 4)), F.array(last))  # the last one ends with the text
        return F.transform(starts, lambda a: F.array_join(F.slice("w", a, F.lit(size)), " "))

    return words.select("path", F.explode(F.array_distinct(F.concat(*map(of, BLOCK_WORDS)))).alias("line"))


def _file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*$", 0))


def _is_licence_file(path: Column) -> Column:
    return _file_name(path).rlike(FILE_NAMES) & ~_file_name(path).rlike(CODE)


def head_text(body: Column) -> Column:
    """What the comments at the front of a text say, without their marks and without the lines that name a holder."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(body, HEAD, 0), MARKS, "\n"), HOLDERS, "$1")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per path: ``path``, ``license``, ``score``, ``origin`` ("own", "inherited" or "none") and ``from_path``.

    A file's own licence is that of its header, if the comments that it begins with come as close as ``TEXT_THRESHOLD`` to one, or of a
    block of its text, if it is named as a licence file; else that of its best line, at a cosine of ``threshold`` or more. Ties go to the
    first name. A file that is named as a licence file and has a licence declares its directory's, and so does a text, by its name no code,
    of which ``WHOLE_PERCENT`` of the words stand in licence lines or the header; of several the best (by score, then
    path). Others inherit from the nearest directory above them that has one, their own included. Rows that repeat a path are one
    file with all their lines; a null path is a file in the root; a null or empty text has no licence of its own. An
    empty table gives an empty table. Other columns are not read and may have any names. Tables made on the way are deleted; the result lasts.
    """
    with scratch(files.sparkSession):
        return cut(_scan(files, path_col, text_col, threshold), lasting=True)


def _scan(files: DataFrame, path_col: str, text_col: str, threshold: float) -> DataFrame:
    spark = files.sparkSession
    rows = files.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    cued = rows.where(_cued(F.lower("body"))).withColumn("words", _n_words(F.col("body")))
    lines = cued.select("path", "words", F.explode(F.split("body", "\n")).alias("line"))
    lines = cut(lines.where(_cued(F.lower("line"))))
    hits = lines.join(score_lines(spark, lines).where(F.col("score") >= threshold), "line")
    heads = cut(cued.select("path", "words", head_text(F.col("body")).alias("line"), _n_words(F.regexp_extract("body", HEAD, 0)).alias("said")).where(F.length(F.trim("line")) > 0))
    near = heads.join(score_lines(spark, heads, HEADERS).where(F.col("score") >= TEXT_THRESHOLD), "line")
    blocks = cut(_blocks(rows))
    close = blocks.join(score_lines(spark, blocks, TEXTS).where(F.col("score") >= TEXT_THRESHOLD), "line")
    none = F.lit(None).cast("long")
    # headers and blocks say more than single lines: they have the first rank
    told = hits.select("path", "license", "score", F.lit(2).alias("rank"), _n_words(F.col("line")).alias("said"), "words")
    told = told.unionByName(near.select("path", "license", "score", F.lit(1).alias("rank"), none.alias("said"), "words"))
    told = told.unionByName(near.select("path", "license", "score", F.lit(3).alias("rank"), "said", "words"))
    told = told.unionByName(close.select("path", "license", "score", F.lit(1).alias("rank"), none.alias("said"), none.alias("words")))
    enough = F.greatest(F.sum(F.when(F.col("rank") == 2, F.col("said"))), F.max(F.when(F.col("rank") == 3, F.col("said")))) * 100 >= F.max("words") * WHOLE_PERCENT
    per_file = told.groupBy("path").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "license")).alias("b"), F.coalesce(enough, F.lit(False)).alias("whole"))
    declares = _is_licence_file(F.col("path")) | (F.col("whole") & _file_name(F.col("path")).rlike(PROSE))
    own = cut(per_file.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), declares.alias("whole")))

    above = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    declared = own.where("whole").groupBy(above(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
    declared = declared.select("dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.path").alias("from_path"))
    paths = rows.select("path").distinct()
    dirs = paths.select(above(F.col("path")).alias("start")).distinct()
    parts = F.split("start", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    chains = dirs.select("start", F.explode(chain).alias("up")).select("start", "up.depth", "up.dir")
    nearest = cut(chains.join(declared, "dir").groupBy("start").agg(F.max_by(F.struct("license", "score", "from_path"), "depth").alias("up")))
    if small_enough_to_broadcast(nearest.count(), 400):
        nearest = F.broadcast(nearest)  # else a directory with many files is left to the skew join of adaptive execution
    out = paths.join(own, "path", "left").withColumn("start", above(F.col("path"))).join(nearest, "start", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", F.col("up.license")).alias("license"),
        F.coalesce("score", F.col("up.score")).alias("score"),
        F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("up.from_path")).alias("from_path"),
    )
