"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directory tree.

A statement is a line with a cue word.  Its terms are weighted by the idf of the templates and
compared with every template; only terms that occur are held.  A file takes the best statement in
it.  A file without one takes the licence of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, saved, without

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "Creative Commons CC0 1.0 Universal public domain dedication."],
}
CUE = r"(?i)\b(?:licen[cs]e[ds]?|copyright|permission|redistribut\w*|public domain|cc0|spdx)\b"
TERM = "[a-z0-9]+"
THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|notice)"


def terms_of(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def template_vectors() -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """idf of the templates' terms, idf of any other term, and rows (licence, number, term, unit weight)."""
    bags = [(name, i, terms_of(t)) for name, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    seen = Counter(t for _, _, b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for name, i, bag in bags:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(name, i, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return idf, math.log(1 + len(bags)) + 1, rows


def _templates(spark: SparkSession) -> tuple[DataFrame, DataFrame, float]:
    idf, other, rows = template_vectors()
    weights = spark.createDataFrame(rows, "license string, template int, term string, weight double")
    return spark.createDataFrame(sorted(idf.items()), "term string, idf double"), weights, other


def statements(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row, line, license, score`` of each line (``row, __body``) that matches a template."""
    idf, weights, other = _templates(files.sparkSession)
    lines = (files.where(F.col("__body").rlike(CUE)).select("row", F.posexplode(F.split("__body", "\n", -1)).alias("line", "words"))
             .where(F.col("words").rlike(CUE)))
    bags = (lines.select("row", "line", F.explode(F.regexp_extract_all(F.lower("words"), F.lit(TERM), 0)).alias("term"))
            .groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("tf")))
    weighed = (bags.join(F.broadcast(idf), "term", "left")  # as many rows as the templates have terms
               .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))))
    norms = weighed.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (weighed.join(F.broadcast(weights), "term").groupBy("row", "line", "license", "template")
            .agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    return (dots.join(norms, ["row", "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
            .groupBy("row", "line").agg(F.max(F.struct("score", "license")).alias("best"))
            .select("row", "line", "best.license", "best.score"))


def parent(path: Column) -> Column:
    """The directory of a path; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(directories: DataFrame, owned: DataFrame) -> DataFrame:
    """``dir, from_dir, license`` for each of ``directories`` (dir) below or at one of ``owned`` (dir, license)."""
    parts = F.split("dir", "/", -1)
    chain = directories.select("dir", F.explode(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("up")).distinct()
    return (chain.join(owned.select(F.col("dir").alias("up"), "license"), "up")
            .groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "license")).alias("near"))
            .select("dir", F.col("near.up").alias("from_dir"), F.col("near.license").alias("license")))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", columns: list[str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (or ``columns`` of it) with ``own_license, score, n_statements, license, from_dir, origin``.

    ``origin`` is ``own``, ``inherited`` or null.  A licence file is one whose name starts like
    LICENSE, COPYING or NOTICE and that has a statement; of several in a directory the best score
    holds, then the later licence name.  Null texts have no statement; a null path has no ancestors; repeated
    rows are judged each; ties of score go to the later licence name.  An empty table gives an empty
    table; columns named like the added ones are replaced.
    """
    added = ["own_license", "score", "n_statements", "license", "from_dir", "origin"]
    files = without(files, [n for n in added if n not in (path, text)])
    kept = columns or files.columns
    rows = saved(files.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("__"), *[quoted(c) for c in kept]).alias("r"),
                              quoted(path).alias("p"), F.when(F.coalesce(quoted(text), F.lit("")).rlike(CUE), quoted(text)).alias("__body")),
                 "license-files")
    own = (statements(rows.select("row", "__body"), threshold).groupBy("row")
           .agg(F.max(F.struct("score", "license")).alias("b"), F.count(F.lit(1)).alias("n"))
           .select("row", F.col("b.license").alias("own_license"), F.col("b.score").alias("score"), F.col("n").alias("n_statements")))
    own = saved(own, "license-own")
    judged = rows.select("row", "r", "p", parent(F.col("p")).alias("dir")).join(own, "row", "left")
    name = F.regexp_replace("p", "^.*/", "")
    owned = (judged.where(F.col("own_license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir")
             .agg(F.max_by("own_license", F.struct("score", "own_license")).alias("license")))
    near = inherited(judged.select("dir").where("dir is not null").distinct(), owned)
    return (judged.join(near, "dir", "left")
            .select(*[F.col("r")[c].alias(c) for c in kept], "own_license", "score",
                    F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
                    F.coalesce("own_license", "license").alias("license"),
                    F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
                    F.when(F.col("own_license").isNotNull(), "own").when(F.col("license").isNotNull(), "inherited").alias("origin")))
