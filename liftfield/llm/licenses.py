"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

DataFrame functions only. A text's units are each line, and the three and twelve lines from it on (wrapped headers),
the whole text (licence files), each sentence, and windows of a notice's number of terms, placed by an anchor term. Only units with a template's anchor term are compared; anchors are chosen so that
a unit without any of them cannot reach the threshold, so the filter loses nothing. Templates and their terms are
parameters of a fixed size and are broadcast; a unit with too many terms of no notice is left out before its terms
are taken apart (a bound on the cosine), so documents move only as their few likely units.

A cosine can't tell a version or a clause, so an exact check follows: a notice counts only if the unit has all its family
names, version numbers and clause words, and no clause word that its licence lacks. Identifier lines name their licence exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftfield.session import cut_lineage

LEAST_COSINE = 0.7
SPANS = (1, 3, 12)
LICENSE_FILE = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"

# Notices by which the licences are commonly given.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
}


# Words too common to tell licences from prose; they have no weight.
STOP_WORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "if", "in", "into", "is", "it", "its", "may", "not", "of", "on",
              "or", "s", "so", "such", "that", "the", "their", "this", "to", "under", "use", "v", "was", "were", "will", "with", "you", "your")


# Family names, words that make another licence of the same family, and the line that names a licence by its identifier.
CLAUSES = ("affero", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike")
FAMILIES = ("apache", "bsd", "cc", "cc0", "creative", "gnu", "mit", "mozilla")
IDENTIFIER = r"(?i)SPDX-License-Identifier:\s*\(?\s*([a-z0-9][a-z0-9.+-]*)"
#: A stretch that says what a text is not licensed under, to the end of its sentence.
DENIED = r"(?i)\b(?:not|never|n't)\s+(?:\w+\s+)?(?:licen[cs]ed|released|distributed|covered|available|offered)\b[^.;\n]*"


def decisive(notice: str) -> list[str]:
    """Family names, version numbers and clause words of a notice."""
    return sorted({t for t in terms(notice) if t in CLAUSES or t in FAMILIES or (t.isdigit() and int(t) > 0)})


def permitted(templates: dict[str, tuple[str, ...]], license: Column, notice: Column, marks: Column) -> Column:
    """Whether a unit with these decisive words can be the notice."""
    out = F.lit(False)
    for name, notices in templates.items():
        foreign = sorted(set(CLAUSES) - {t for n in notices for t in decisive(n)})
        own = ~F.arrays_overlap(marks, F.array(*[F.lit(t) for t in foreign]))
        for k, n in enumerate(notices):
            need = decisive(n)
            has = F.forall(F.array(*[F.lit(t) for t in need]).cast("array<string>"), lambda t: F.array_contains(marks, t))
            out = F.when((license == name) & (notice == k), own & has if need else own).otherwise(out)
    return out


def terms(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]


def template_vectors(templates: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, notice, term, share of the unit vector) rows; idf of each known term; idf of any other term."""
    notices = [(name, k, Counter(terms(t))) for name, ts in templates.items() for k, t in enumerate(ts)]
    df = Counter(t for _, _, c in notices for t in c)
    idf = {t: math.log((1 + len(notices)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, k, c in notices:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf, math.log(1 + len(notices)) + 1


def anchors(rows: list[tuple[str, int, str, float]], least: float) -> list[str]:
    """Terms without which no notice can reach ``least``: of each notice the heaviest, until the rest is too light.

    Terms of up to three characters come last, as other languages have them as common words.
    """
    chosen: set[str] = set()
    for key in dict.fromkeys((r[0], r[1]) for r in rows):
        left = sorted((len(t) <= 3, -w, t) for name, k, t, w in rows if (name, k) == key)
        while sum(w * w for _, w, t in left if t not in chosen) >= least**2 * (1 - 1e-9):
            chosen.add(next(t for _, _, t in left if t not in chosen))
    return sorted(chosen)


def cuts(rows: list[tuple[str, int, str, float]], templates: dict[str, tuple[str, ...]], least: float) -> dict[str, list[tuple[int, int]]]:
    """Of each anchor term its places in the notices, as (terms before it, terms of the notice)."""
    out: dict[str, set[tuple[int, int]]] = {t: set() for t in anchors(rows, least)}
    for notice in (terms(t) for ts in templates.values() for t in ts):
        for k, t in enumerate(notice):
            if t in out:
                out[t].add((k, len(notice)))
    return {t: sorted(v) for t, v in out.items()}


def own_licenses(files: DataFrame, least: float = LEAST_COSINE, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Best licence of each row that has one: ``path``, ``license``, ``cosine``, ``whole`` (the whole text is the notice)."""
    spark: SparkSession = files.sparkSession
    rows, idf, other = template_vectors(templates)
    seen = f"(?i)(?<![a-zA-Z0-9])(?:{'|'.join([*anchors(rows, least), 'spdx'])})(?![a-zA-Z0-9])"
    lines = F.split("text", "\n")
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i.cast("int")).rlike(seen))
    units = F.flatten(F.transform("at", lambda i: F.array(*[
        F.struct(F.lit(False).alias("whole"), F.array_join(F.slice("lines", F.greatest(F.lit(1), i - k), F.lit(n)), " ").alias("unit"))
        for n in SPANS for k in ((0,) if n == 1 else (0, n // 2))])))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit")))
    # within lines: sentences, and as many terms as a notice has, placed by an anchor term as in the notice
    sentences = F.transform(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x.rlike(seen)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    places = F.create_map(*[x for t, v in cuts(rows, templates, least).items()
                            for x in (F.lit(t), F.array(*[F.struct(F.lit(a).alias("before"), F.lit(n).alias("n")) for a, n in v]))])
    met = F.filter(F.transform("terms", lambda t, i: F.struct(i.alias("i"), places[t].alias("cuts"))), lambda x: x["cuts"].isNotNull())
    spans = F.flatten(F.transform("met", lambda x: F.transform(x["cuts"], lambda c: F.struct(F.lit(False).alias("whole"), F.array_join(
        F.slice("terms", F.greatest(F.lit(1), x["i"] - c["before"] + 1), c["n"]), " ").alias("unit")))))
    plain = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))
    named = F.regexp_replace(F.regexp_extract("text", IDENTIFIER, 1), r"(?i)(-only|-or-later|\+|\.)$", "")
    some = (files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
            .where(F.col("text").rlike(seen)).withColumn("named", named).withColumn("text", F.regexp_replace("text", DENIED, " ")).withColumn("lines", lines)
            .withColumn("at", at).withColumn("terms", plain).withColumn("met", met)
            .select("path", "named", F.explode(F.array_distinct(F.concat(units, whole, sentences, spans))).alias("u")).select("path", "named", "u.whole", "u.unit"))
    words = F.filter(F.regexp_extract_all(F.lower("unit"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))
    # a term of no notice weighs most: with k terms of notices and m others the cosine is at most k / sqrt(k * k + m)
    k = F.size(F.filter("words", lambda t: t.isin(*idf))).cast("double")
    bound = k * k >= (k * k + F.size("words") - k) * (least * least * (1 - 1e-9))
    known_marks = sorted({t for ts in templates.values() for n in ts for t in decisive(n)} | set(CLAUSES))
    marks = F.array_join(F.array_sort(F.array_intersect("words", F.array(*[F.lit(t) for t in known_marks]))), " ")
    unit = ["path", "whole", "unit", "marks"]  # the marks follow from the unit
    # the few units that can reach the threshold, and each text's identifier line, are written once
    likely = cut_lineage(some.withColumn("words", words).where(bound | (F.col("whole") & (F.col("named") != ""))).select(
        "path", "named", "whole", F.xxhash64("unit").alias("unit"), marks.alias("marks"), F.when(bound, F.col("words")).alias("words")).distinct())
    by_name = likely.where(F.col("whole") & (F.col("named") != "")).select("path", F.col("named").alias("license"), F.lit(1.0).alias("cosine"), F.lit(False).alias("whole"))
    counted = likely.select(*unit, F.explode("words").alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame(list(idf.items()), "term string, idf double")
    weighed = counted.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    shares = spark.createDataFrame(rows, "license string, notice int, term string, share double").groupBy("term").agg(
        F.collect_list(F.struct("license", "notice", "share")).alias("notices"))
    # one pass: a unit's squared weights, and its products with each notice, are sums over its terms
    products = weighed.join(F.broadcast(shares), "term", "left").select(
        *unit, F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("license"), F.lit(None).cast("int").alias("notice"), F.col("w").alias("x"))),
            F.coalesce(F.transform("notices", lambda n: F.struct(n["license"].alias("license"), n["notice"].alias("notice"), (n["share"] * F.col("w")).alias("x"))),
                       F.array().cast("array<struct<license:string,notice:int,x:double>>")))).alias("p"))
    summed = products.groupBy(*unit, "p.license", "p.notice").agg(F.sum("p.x").alias("x"), F.sum(F.col("p.x") * F.col("p.x")).alias("xx"))
    # a unit meets each notice in one row at most, so its list is as short as the templates are
    by_unit = summed.groupBy(*unit).agg(
        F.sqrt(F.max(F.when(F.col("license").isNull(), F.col("xx")))).alias("norm"),
        F.collect_list(F.when(F.col("license").isNotNull(), F.struct("x", "license", "notice"))).alias("met"))
    close = by_unit.select("path", "whole", "marks", "norm", F.explode(F.filter("met", lambda m: m["x"] >= F.col("norm") * least)).alias("m"))
    good = close.where(permitted(templates, F.col("m.license"), F.col("m.notice"), F.split("marks", " "))).select(
        "path", "whole", "m.license", (F.col("m.x") / F.col("norm")).alias("cosine"))
    return good.unionByName(by_name).groupBy("path").agg(F.max(F.struct("cosine", "whole", "license")).alias("b"), F.max("whole").alias("whole")).select(
        "path", "b.license", "b.cosine", "whole")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licenses(files: DataFrame, least: float = LEAST_COSINE, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``path``, ``own_license``, ``cosine``, ``license`` and ``inherited_from`` of each distinct path of ``files`` (path, text).

    A file's own notice decides. Else it inherits from the licence files (by name, or because the whole text is a
    notice) of the nearest directory above it that has one; of several there, the best cosine, then the name. A file
    with neither has null. Null or empty texts have no notice; a null path is a file without directory; rows that
    repeat a path are one file with the best notice of all.
    """
    own = cut_lineage(own_licenses(files, least, templates))  # texts are read for it once; all below is about paths
    paths = files.select(F.col("path").cast("string").alias("path")).distinct()
    all_files = cut_lineage(paths.join(own, paths["path"].eqNullSafe(own["path"]), "left").select(
        paths["path"], F.col("license").alias("own_license"), "cosine", "whole").withColumn("dir", directory(F.col("path"))))
    name = F.regexp_extract("path", "[^/]*$", 0)
    givers = all_files.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (name.rlike(LICENSE_FILE) | F.col("whole"))).groupBy(
        F.col("dir").alias("giver")).agg(F.max_by("own_license", F.struct("cosine", "own_license")).alias("given"))
    # ancestors of each distinct directory, itself first; the nearest that gives wins
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = all_files.where("own_license is null and path is not null").select("dir").distinct().withColumn("parts", parts).select(
        "dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts").select(
        "dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("giver"))
    nearest = above.join(givers, "giver").groupBy("dir").agg(F.max_by(F.struct("given", "giver"), "depth").alias("g")).select(
        F.col("dir").alias("d"), "g.given", "g.giver")
    return all_files.join(nearest, F.col("own_license").isNull() & (F.col("dir") == F.col("d")), "left").select(
        "path", "own_license", "cosine", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("giver")).alias("inherited_from"))
