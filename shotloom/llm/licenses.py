"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame operations only. What is compared: every run of one to LINES lines, so
that a wrapped statement counts as one; every paragraph, such as a header block
or the title or grant of a licence file; and the whole file. The vector space is
the templates' vocabulary, so its statistics are bounded by the templates;
document frequencies are counted over all lines of all files. A token outside
the vocabulary counts as unseen: it has the largest weight and only lengthens
the vector. Units without one of the heavy terms can't reach the threshold (the
other terms of a template are too light for that), so only the others are
compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Names under which licences are stated, by SPDX identifier; a statement is each name after each of FRAMES.
NAMES = (
    ("MIT", "MIT License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
)
FRAMES = ("Licensed under the", "Released under the")
#: What licences say of themselves in headers, titles and grants, by SPDX identifier.
PASSAGES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
TEMPLATES = tuple((spdx, f"{frame} {name}") for spdx, name in NAMES for frame in FRAMES) + PASSAGES
#: Lines in a run at most. Kinds of unit: a run of 1 to LINES lines, then paragraph and file.
LINES = 3
PARAGRAPH, FILE = LINES + 1, LINES + 2
BLANK = "\n[^0-9a-z\n]*\n"
TOKEN = r"[^0-9a-z]+"
THRESHOLD = 0.7
#: Base names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-][^/]*)?$"


def tokens(text: str) -> list[str]:
    return [t for t in re.split(TOKEN, text.lower()) if t]


def _weights(templates, df: dict[str, int], n: int):
    """Each term's idf, the unseen terms' idf, and each template's unit vector."""
    idf = lambda d: math.log((n + 1) / (d + 1)) + 1
    weight = {t: idf(df.get(t, 0)) for _, text in templates for t in tokens(text)}
    units = []
    for _, text in templates:
        v = {t: c * weight[t] for t, c in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        units.append({t: x / norm for t, x in v.items()})
    return weight, idf(0), units


def heavy_terms(units, weight: dict[str, float], threshold: float) -> list[str]:
    """Terms such that what any template has without them is lighter than the threshold; the rarest serve first."""
    heavy: set[str] = set()
    for v in units:
        rest = sum(x * x for t, x in v.items() if t not in heavy)
        for t, x in sorted(v.items(), key=lambda p: (-weight[p[0]], -p[1], p[0])):
            if rest < (threshold - 1e-6) ** 2:
                break
            if t not in heavy:
                heavy.add(t)
                rest -= x * x
    return sorted(heavy)


def scan_headers(files: DataFrame, path: Column, text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, similarity, kind, at) for every file that states a licence: its best unit.

    kind is the number of lines of a run (at is its first line, from 0),
    PARAGRAPH (at counts paragraphs, parted by lines without letters or digits)
    or FILE. Of equally similar units the smallest kind counts, then the first;
    of templates the first. Every whole text is cut into units. Null texts have
    none; a null path is ignored. Rows that share a path are one file with all
    their units.
    """
    rows = files.select(path.cast("string").alias("path"), F.lower(text.cast("string")).alias("text")).where("path is not null and text is not null")
    cut = lambda c: F.array_remove(F.split(c, TOKEN), "")
    lines = F.transform(F.split("text", "\n"), cut)
    vocabulary = sorted({t for _, x in templates for t in tokens(x)})
    terms = F.array(*[F.lit(t) for t in vocabulary])
    # one pass for the counts: a line without a term of the vocabulary still counts as a line
    each = rows.select(F.explode(lines).alias("words")).where(F.size("words") > 0)
    counted = each.select(F.explode(F.array_append(F.array_intersect("words", terms), F.lit(""))).alias("t")).groupBy("t").count().collect()
    df = {r["t"]: r["count"] for r in counted}
    weight, unseen, units = _weights(templates, df, df.get("", 0))
    heavy = F.array(*[F.lit(t) for t in heavy_terms(units, weight, threshold)])

    # a generator's row is computed once; the optimiser would write the lines out again wherever they are used
    near = rows.select("path", F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.struct("text", lines.alias("lines")))).alias("x"))
    near = near.select("path", "row", "x.text", "x.lines").where(F.exists("lines", lambda x: F.arrays_overlap(x, heavy)))
    unit = lambda kind, at, words: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), words.alias("words"))
    none = F.array().cast("array<string>")

    def run_of(n: int) -> Column:
        """Units of n lines, without words where a line has none."""
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines") - (n - 1)))
        run = F.transform(starts, lambda i: F.slice("lines", i, n))
        return F.transform(run, lambda x, i: unit(n, i, F.when((F.size(x) == n) & F.forall(x, lambda y: F.size(y) > 0), F.flatten(x)).otherwise(none)))

    found = [run_of(n) for n in range(1, LINES + 1)]
    blocks = F.filter(F.transform(F.split("text", BLANK), cut), lambda x: F.size(x) > 0)
    found.append(F.transform(blocks, lambda x, i: unit(PARAGRAPH, i, x)))
    found.append(F.array(unit(FILE, F.lit(0), F.flatten("lines"))))
    near = near.select("path", "row", F.explode(F.filter(F.concat(*found), lambda u: F.arrays_overlap(u["words"], heavy))).alias("u"))
    key = ["path", "row", "kind", "at"]
    near = near.select("path", "row", "u.kind", "u.at", F.explode("u.words").alias("t"))
    spark = files.sparkSession
    # bounded by the templates: a weight for each term and template
    values = spark.createDataFrame([(t, weight[t], [u.get(t, 0.0) for u in units]) for t in vocabulary], "t string, w double, u array<double>")
    by_term = near.groupBy(*key, "t").count().join(F.broadcast(values), "t", "left")
    x = F.col("count") * F.coalesce("w", F.lit(unseen))
    dots = [F.sum(F.when(F.col("w").isNotNull(), x * F.col("u")[i]).otherwise(0.0)).alias(f"d{i}") for i in range(len(units))]
    by_unit = by_term.groupBy(*key).agg(F.sum(x * x).alias("norm"), *dots)
    length = F.sqrt("norm")
    best = F.greatest(*[F.struct(F.round(F.col(f"d{i}") / length, 12).alias("similarity"), F.lit(-i).alias("i")) for i in range(len(units))])
    stated = by_unit.withColumn("best", best).where(F.col("best.similarity") >= threshold)
    top = stated.groupBy("path").agg(F.max(F.struct(F.col("best.similarity").alias("similarity"), (-F.col("kind")).alias("kind"), (-F.col("at")).alias("at"), F.col("best.i").alias("i"))).alias("b"))
    names = F.array(*[F.lit(x) for x, _ in templates])
    return top.select("path", F.element_at(names, 1 - F.col("b.i")).alias("license"), F.round("b.similarity", 6).alias("similarity"), (-F.col("b.kind")).alias("kind"), (-F.col("b.at")).alias("at"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def license_scan(files: DataFrame, path: Column, text: Column, is_notice: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, basis, similarity, from_dir) for each distinct path.

    basis is `header` for a licence stated in the file, `directory` for one
    inherited from the nearest directory above that has a notice (from_dir), or
    `none`. is_notice is a column over path, license, kind and at that marks the
    files whose licence holds for their directory: licence files by name, unless
    given. Of several notices in one directory the most similar counts, then the
    smallest path. Null paths are ignored; null and empty texts have no header;
    an empty table gives an empty result; other columns are ignored.
    """
    headers = stored(scan_headers(files, path, text, templates, threshold), "headers")
    if is_notice is None:
        is_notice = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)
    paths = files.select(path.cast("string").alias("path")).where("path is not null").distinct()
    directory = F.element_at(ancestors(F.col("path")), 1)
    notices = headers.where(is_notice).groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("p"), F.col("license").alias("l"))).alias("n"))
    # dealt anew, so that the join below has exchanges of its own and adaptive execution can split a large directory
    notices = notices.select("dir", F.col("n.l").alias("notice")).hint("rebalance")
    own = paths.join(headers, "path", "left")
    open_ = own.where("license is null").select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    near = open_.join(notices, "dir").groupBy("path").agg(F.min(F.struct("up", "dir", "notice")).alias("d"))
    basis = F.when(F.col("license").isNotNull(), "header").when(F.col("d").isNotNull(), "directory").otherwise("none")
    return own.join(near, "path", "left").select(
        "path", F.coalesce("license", "d.notice").alias("license"), basis.alias("basis"), "similarity",
        F.when(F.col("license").isNull(), F.col("d.dir")).alias("from_dir"),
    )
