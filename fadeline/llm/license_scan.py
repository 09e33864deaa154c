"""License scan: TF-IDF cosine of text segments to licence templates, then inheritance down the directories. JVM only.

Every file is cut into segments (lines, and sentences within them). Segments that hold a telling
template term become sparse TF-IDF vectors over the templates' terms; what they hold besides counts in
their length. A file takes the licence of its best segment. A licence file (its name says so, or it
holds little else) speaks for its directory, and files without a licence of their own inherit from the
nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import settle

#: Licences by SPDX id, with the notices that files carry.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "The MIT License"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE.md file for details"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0 - see the LICENSE.md file for details"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")),
]
#: Words that say nothing about a licence by themselves.
_COMMON = frozenset("a and any by except except file files for form forms from in into is may not of or person source the this to under use used version with without work you are code free subject terms copy public general released rights all domain software project see md details deal restriction including limitation modify merge publish distribute sell copies january 2004 http www org it as published either at your option later international creative to clause".split())
#: Terms: runs of letters and digits; a dotted number stays whole.
_TERM = r"[0-9]+(?:\.[0-9]+)+|[a-z0-9]+"
_FILES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Least cosine of a match, and least share of a file's words in it that makes the file speak for its directory.
THRESHOLD, SPEAKS = 0.75, 0.5


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _telling() -> list[str]:
    return sorted({t for _, x in TEMPLATES for t in _terms(x) if len(t) > 1} - _COMMON)


def read_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, terms, segments): one pass over the texts.

    ``terms``: the template terms that the document holds; ``segments``: those that hold a telling one, looked
    for only in documents that do.
    """
    vocabulary = sorted({t for _, x in TEMPLATES for t in _terms(x)})
    ends = [*vocabulary, *(f"{t}." for t in vocabulary)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    rows = rows.withColumn("found", F.array_distinct(F.filter(F.split(F.lower("t"), r"[^a-z0-9.]+"), lambda w: w.isin(ends))))
    rows = rows.withColumn("terms", F.array_distinct(F.transform("found", lambda w: F.rtrim(w, F.lit("."))))).drop("found")
    telling = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, _telling())) + ")(?![a-z0-9])"
    some = F.arrays_overlap("terms", F.array(*map(F.lit, _telling())))
    segments = F.filter(F.split("t", r"\n|(?<=[.;!?])\s+"), lambda s: s.rlike(telling))
    return rows.select("key", F.when(some, F.size(F.filter(F.split("t", r"\s+"), lambda w: w != ""))).alias("n_words"), "terms", F.when(some, segments).alias("segments"))


def term_weights(texts: DataFrame) -> dict[str, float]:
    """Inverse document frequency of the templates' terms over all documents; \"\" stands for any other term.

    Each document is reduced to the template terms that it holds before anything is shuffled, so the
    driver gets as many counts as templates have terms.
    """
    vocabulary = sorted({t for _, x in TEMPLATES for t in _terms(x)})
    counts = texts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    n = texts.count()
    seen = {r["t"]: r["count"] for r in counts}
    return {t: math.log((1 + n) / (1 + min(n, seen.get(t, 0)))) + 1 for t in vocabulary} | {"": math.log(1 + n) + 1}


def _weights(idf: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for t, w in idf.items() for x in (t, w)))


def best_segments(texts: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(key, license, similarity, share, n_segments) of every document with a segment over the threshold.

    The templates' vectors are constants of the plan. Equal similarities: the longer segment, then the earlier template.
    """
    rows = texts.filter("segments IS NOT NULL").select("key", "n_words", F.explode("segments").alias("segment"))
    terms = F.regexp_extract_all(F.lower("segment"), F.lit(f"({_TERM})"), 1)
    vocabulary = [t for t in idf if t]
    rows = rows.withColumn("terms", terms)
    rows = rows.withColumn("held", F.filter("terms", lambda t: t.isin(vocabulary))).withColumn("rest", F.array_sort(F.filter("terms", lambda t: ~t.isin(vocabulary))))
    table = _weights({t: idf[t] for t in vocabulary})
    count = F.transform(F.array_distinct("held"), lambda t: F.struct(t.alias("t"), (F.size(F.filter("held", lambda x: x == t)) * F.element_at(table, t)).alias("w")))
    # squares of the other terms' numbers, one by one along their sorted list: a run of r grows its square by 2 r + 1
    squares = F.aggregate("rest", F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("sum")), lambda s, x: F.struct(
        x.alias("last"), F.when(s["last"] == x, s["run"] + 1).otherwise(1).cast("bigint").alias("run"), (s["sum"] + F.when(s["last"] == x, 2 * s["run"] + 1).otherwise(1)).cast("bigint").alias("sum")), lambda s: s["sum"])
    rows = rows.withColumn("vector", count).withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]) + squares * (idf[""] ** 2)))
    scores = []
    for rank, (name, notice) in enumerate(TEMPLATES):
        t = _terms(notice)
        vector = {x: t.count(x) * idf[x] for x in t}
        length = math.sqrt(sum(w * w for w in vector.values()))
        own = _weights(vector)
        dot = _dot(own)
        scores.append(F.struct((dot / (F.col("norm") * length)).alias("similarity"), F.size("terms").alias("size"), F.lit(-rank).alias("rank"), F.lit(name).alias("license")))
    best = rows.select("key", "n_words", F.array_max(F.array(*scores)).alias("best")).filter(F.col("best.similarity") >= THRESHOLD)
    best = best.groupBy("key").agg(F.max("best").alias("best"), F.sum("best.size").alias("covered"), F.max("n_words").alias("n_words"), F.count("*").alias("n_segments"))
    return best.select("key", "best.license", "best.similarity", (F.col("covered") / F.greatest("n_words", F.lit(1))).alias("share"), "n_segments")


def _dot(own: Column) -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(own, x["t"]), F.lit(0.0)))


def scan(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, path, license, similarity, n_segments, inherited_from) of every file.

    ``license`` is the file's own, or that of the nearest ancestor directory (``inherited_from``) that a
    licence file speaks for, or null. Of several licence files in a directory the one with the highest
    similarity speaks, then the smallest licence id. Null paths have no directory, null texts no licence.
    Repeated keys and paths are rows of their own.
    """
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    rows = rows.withColumn("__row", F.xxhash64("key", "path", "text"))
    texts = settle(read_texts(rows, "__row", "text"))
    once = texts.filter("segments IS NOT NULL").dropDuplicates(["key"])  # repeated rows count in the weights, but hold their segments once
    found = settle(best_segments(once, term_weights(texts)).withColumnRenamed("key", "__row"))
    slim = rows.select("key", "path", "__row")
    labelled = settle(slim.join(found, "__row", "left").drop("__row"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    speakers = labelled.filter(F.col("license").isNotNull() & (F.col("path").rlike(_FILES) | (F.col("share") >= SPEAKS)))
    spoken = speakers.select(folder.alias("folder"), F.struct((-F.col("similarity")).alias("s"), "license").alias("best")).filter("folder IS NOT NULL").groupBy("folder").agg(F.min("best").alias("best"))
    spoken = settle(spoken.select("folder", F.col("best.license").alias("theirs")))
    # folders, not files, look for their ancestors: a folder is one row however many files it holds
    folders = labelled.filter("license IS NULL AND path IS NOT NULL").select(folder.alias("at")).distinct()
    parts = F.split("at", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = folders.select("at", F.explode(F.array_distinct(ups)).alias("folder")).join(spoken, "folder")
    nearest = above.groupBy("at").agg(F.max(F.struct(F.length("folder").alias("depth"), "folder", "theirs")).alias("best")).select("at", F.col("best.folder").alias("from"), "best.theirs")
    nearest = settle(nearest)  # a table, so that a large folder's files can be dealt over several tasks
    need = labelled.withColumn("at", F.when(F.col("license").isNull(), folder))
    out = need.filter("at IS NOT NULL").join(nearest, "at", "left").unionByName(need.filter("at IS NULL").withColumn("from", F.lit(None).cast("string")).withColumn("theirs", F.lit(None).cast("string")))
    return out.select("key", "path", F.coalesce("license", "theirs").alias("license"), "similarity", F.coalesce("n_segments", F.lit(0)).cast("bigint").alias("n_segments"), F.col("from").alias("inherited_from"))
