"""Licence scans: TF-IDF cosine to templates, then inheritance down the folders.

Everything is DataFrame operations. Lines that mention a licence are taken from
the whole texts, wherever they stand; equal lines are scored once. Besides, the
words around every cue are scored in windows as long as a template, across line
breaks and inside longer lines. A file's own licence is the best template of its
lines and windows; a file without one takes that of the licence file in its
nearest ancestor folder, found by joining folders.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick, save

CUT = 0.6  #: cosine from which a line states a licence
CUE = "licen[sc]e|copyright|copyleft|redistribut|public domain|permission is hereby|spdx"
CUE_WORD = "licen[sc]|copyright|copyleft|redistribut|domain|permission|spdx"  #: every template holds one
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"
FILE = "(?i)^(licen[sc]e|copying|notice)([.-].*)?$"

# Public licence notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def match_lines(lines: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cut: float = CUT) -> DataFrame:
    """(line, license, score): the best template of every distinct line, if its cosine reaches ``cut``.

    ``lines`` is (line, n): distinct lines and how often they stand in the
    corpus. A word's weight is ln((1 + lines) / (1 + lines with it)) + 1. Ties go
    to the smaller name.
    """
    spark = lines.sparkSession
    words = lines.select("line", "n", F.explode(_words(F.col("line"))).alias("w")).groupBy("line", "n", "w").agg(F.count(F.lit(1)).alias("tf"))
    words = save(words, "line_words")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    known = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(known, "t int, license string, text string")  # the fixed list above
    t = t.select("t", "license", F.explode(_words(F.col("text"))).alias("w")).groupBy("t", "license", "w").agg(F.count(F.lit(1)).alias("tf_t"))
    df = words.groupBy("w").agg(F.sum("n").alias("df"))
    both = df.join(t.select("w").distinct(), "w", "full")
    idf = both.select("w", (F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = save(idf, "idf")
    line = words.join(idf, "w").withColumn("x", F.col("tf") * F.col("idf"))
    norm = line.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    t = t.join(idf, "w").withColumn("y", F.col("tf_t") * F.col("idf"))
    norm_t = t.groupBy("t").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm_t"))
    dots = line.join(t.select("t", "license", "w", "y"), "w").groupBy("line", "t", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dots.join(norm, "line").join(norm_t, "t").select("line", "license", F.round(F.col("dot") / F.col("norm") / F.col("norm_t"), 6).alias("score"))
    best = cosine.where(F.col("score") >= cut).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("line", "b.license", (-F.col("b.s")).alias("score"))


def _weighed(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple]]:
    """Weights of the templates' words, the weight of any other word, and (license, length, norm, [(word, y)]) of each template.

    A word's weight is ln((1 + licences) / (1 + licences with it)) + 1.
    """
    rows = [(name, re.findall(WORD, text.lower())) for name, text in templates]
    names = {name for name, _ in rows}
    df = Counter(w for _, w in {(name, w) for name, words in rows for w in words})
    idf = {w: log((1 + len(names)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for name, words in rows:
        y = {w: n * idf[w] for w, n in Counter(words).items()}
        out.append((name, len(words), sqrt(sum(v * v for v in y.values())), list(y.items())))
    return idf, log(1 + len(names)) + 1, out


def match_windows(d: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cut: float = CUT) -> DataFrame:
    """(path, license, score) of every window of consecutive words that reaches ``cut``.

    ``d`` is (path, text). A window holds a cue word and as many words as the
    template (fewer only if the text has no more), so words beside a sentence do
    not weigh, nor does the number of documents. A window belongs to its first cue.
    """
    if not templates:
        return d.select("path", F.lit("").alias("license"), F.lit(0.0).alias("score")).where("false")
    idf, other, known = _weighed(templates)
    longest = max(n for _, n, _, _ in known)
    words = d.where(F.col("text").rlike(f"(?i){CUE_WORD}")).select("path", _words(F.col("text")).alias("words"))
    words = save(words, "texts")  # so that no lambda below splits a text again
    cues = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CUE_WORD), i)), lambda i: i.isNotNull())
    cues = save(words.withColumn("cues", cues), "cues")

    def around(cue, j):
        first = F.greatest(F.when(j > 0, F.get("cues", j - 1) + 1).otherwise(0), cue - (longest - 1))
        return F.named_struct(F.lit("head"), first == 0, F.lit("at"), cue - first, F.lit("words"), F.slice("words", first + 1, cue - first + longest))

    near = save(cues.select("path", F.inline(F.transform("cues", around))), "near")
    weights = F.create_map(*[F.lit(v) for pair in idf.items() for v in pair])
    weighed = F.transform("words", lambda w: F.named_struct(F.lit("w"), w, F.lit("x"), F.coalesce(F.try_element_at(weights, w), F.lit(other))))
    t = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(n).alias("k"), F.lit(norm).alias("norm_t"),
                           F.array(*[F.struct(F.lit(w).alias("w"), F.lit(v).alias("y")) for w, v in y]).alias("y")) for name, n, norm, y in known])
    pairs = near.select("path", "head", "at", weighed.alias("words"), F.inline(t))

    def total(column, value):
        return F.aggregate(column, F.lit(0.0), lambda a, v: a + value(v))

    def cosine(v, y):
        dot = total(v, lambda p: p["x"] * total(y, lambda q: F.when(q["w"] == p["w"], q["y"]).otherwise(0.0)))
        norm = total(v, lambda p: p["x"] * p["x"] * total(v, lambda q: F.when(q["w"] == p["w"], 1.0).otherwise(0.0)))
        return F.round(dot / F.sqrt(norm) / F.col("norm_t"), 6)

    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k") + 1), F.greatest(F.lit(0), F.least(F.col("at"), F.size("words") - F.col("k"))))
    windows = F.filter(F.transform(starts, lambda i: F.slice("words", i + 1, F.col("k"))), lambda v: (F.size(v) == F.col("k")) | F.col("head"))
    scored = pairs.select("path", "license", F.array_max(F.transform(windows, lambda v: cosine(v, F.col("y")))).alias("score"))
    return scored.where(F.col("score") >= cut)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, cut: float = CUT) -> DataFrame:
    """Licence of every path: path, license, score, origin, licensed_by.

    origin is ``own`` (the file's best line or window), ``inherited`` (from the licence
    file licensed_by in the nearest ancestor folder, its own folder included;
    of several there the first by path) or ``none``. Null texts state nothing;
    rows without a path are left out; rows with one path count as one file. An
    empty table gives no rows.
    """
    d = pick(files, path_col, text_col).toDF("path", "text").where("path IS NOT NULL")
    line = F.trim(F.regexp_replace(F.lower("l"), "\\s+", " "))
    lines = d.where(F.col("text").rlike(f"(?i){CUE}")).select("path", F.explode(F.split("text", "\n")).alias("l")).select("path", line.alias("line"))
    lines = save(lines.where(F.col("line").rlike(CUE)), "lines")
    matched = save(match_lines(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), templates, cut), "matched")
    found = lines.join(matched, "line").select("path", "license", "score").unionByName(match_windows(d, templates, cut))
    own = found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = save(own.select("path", "b.license", (-F.col("b.s")).alias("score")), "own")

    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    stated = own.where(F.element_at(parts, -1).rlike(FILE)).withColumn("folder", folder)
    stated = stated.groupBy("folder").agg(F.min(F.struct("path", "license", "score")).alias("from"))
    rest = d.select("path").distinct().join(own, "path", "left_anti")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")
    up = rest.select("path", depth).withColumn("folder", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    given = up.join(stated, "folder").groupBy("path").agg(F.max(F.struct("depth", "from")).alias("g"))
    given = given.select("path", F.col("g.from.license").alias("license"), F.col("g.from.score").alias("score"), F.col("g.from.path").alias("licensed_by"))
    inherited = rest.join(given, "path", "left").select(
        "path", "license", "score", F.when(F.col("license").isNull(), "none").otherwise("inherited").alias("origin"), "licensed_by")
    return own.select("path", "license", "score", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("licensed_by")).unionByName(inherited)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``, which have no paths: source/thousands/hundreds/number.txt.

    Numbers divisible by 100 are the licence files of their folder of hundreds,
    by 1,000 of their thousands, by 10,000 of their source.
    """
    d = load(spark, sf_dir, "documents")
    thousand, hundred = F.expr("doc_id DIV 1000").cast("string"), F.expr("doc_id DIV 100").cast("string")
    source, name = F.coalesce("source", F.lit("none")), F.lit("LICENSE")
    path = (F.when(F.col("doc_id") % 10000 == 0, F.concat_ws("/", source, F.concat_ws(".", name, "doc_id")))
            .when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", source, thousand, name))
            .when(F.col("doc_id") % 100 == 0, F.concat_ws("/", source, thousand, hundred, name))
            .otherwise(F.concat_ws("/", source, thousand, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))
    d = d.select("doc_id", path.alias("path"), "text")
    return scan_licenses(d).join(d.select("doc_id", "path").distinct(), "path")


_TEMPLATE_ROWS = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
LICENSE_SQL = f"""
WITH d AS (
  SELECT CASE WHEN doc_id % 10000 = 0 THEN coalesce(source, 'none') || '/LICENSE.' || doc_id
    WHEN doc_id % 1000 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 1000) || '/LICENSE'
    WHEN doc_id % 100 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE'
    ELSE coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path, text, doc_id
  FROM documents),
lines AS (
  SELECT path, trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) AS line
  FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(lower(l), '{CUE}')),
distinct_lines AS (SELECT line, count(*) AS n FROM lines GROUP BY line),
words AS (
  SELECT line, n, w, count(*) AS tf
  FROM (SELECT line, n, unnest(regexp_extract_all(line, '{WORD}')) AS w FROM distinct_lines) GROUP BY line, n, w),
t AS (
  SELECT t, license, w, count(*) AS tf_t
  FROM (SELECT t, license, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM (VALUES {_TEMPLATE_ROWS}) v(t, license, text)) GROUP BY t, license, w),
idf AS (
  SELECT coalesce(a.w, b.w) AS w, ln((1 + (SELECT coalesce(sum(n), 0) FROM distinct_lines)) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf
  FROM (SELECT w, sum(n) AS df FROM words GROUP BY w) a FULL JOIN (SELECT DISTINCT w FROM t) b ON a.w = b.w),
x AS (SELECT line, w, tf * idf AS x FROM words JOIN idf USING (w)),
y AS (SELECT t, license, w, tf_t * idf AS y FROM t JOIN idf USING (w)),
cosine AS (
  SELECT line, license, round(sum(x * y) / any_value(nx) / any_value(ny), 6) AS score
  FROM x JOIN y USING (w) JOIN (SELECT line, sqrt(sum(x * x)) AS nx FROM x GROUP BY line) USING (line)
  JOIN (SELECT t, sqrt(sum(y * y)) AS ny FROM y GROUP BY t) USING (t) GROUP BY line, t, license),
matched AS (
  SELECT line, license, score FROM cosine WHERE score >= {CUT}
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
own AS (
  SELECT path, license, score FROM lines JOIN matched USING (line)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
stated AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path AS licensed_by, license, score FROM own
  WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE}')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path) = 1),
rest AS (SELECT DISTINCT path FROM d ANTI JOIN own USING (path)),
given AS (
  SELECT path, license, score, licensed_by FROM rest JOIN stated ON starts_with(path, folder || '/')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(folder) DESC) = 1)
SELECT r.*, doc_id FROM (
  SELECT path, license, score, 'own' AS origin, NULL::VARCHAR AS licensed_by FROM own
  UNION ALL
  SELECT path, license, score, CASE WHEN license IS NULL THEN 'none' ELSE 'inherited' END, licensed_by FROM rest LEFT JOIN given USING (path)
) r JOIN (SELECT DISTINCT path, doc_id FROM d) USING (path)
"""
