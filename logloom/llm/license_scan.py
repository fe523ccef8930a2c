"""Licence scans: TF-IDF cosine of every line to licence templates, then inheritance from the nearest directory with a licence file.

Everything is DataFrame operations.  Document frequencies of the template vocabulary are counted over all files; every line of the
whole text that holds a word of the vocabulary is compared with every template, inside its row.  A word outside the vocabulary, or one of it that no
file holds, weighs as much as the rarest word of the vocabulary that occurs; stop words carry no weight.  Weights depend on the shares of files that hold
a word, not on their number, so the same files a thousand times over match as they do once.  The vocabulary and its frequencies are as large as the
templates, not as the files.

Inheritance works on directories: each directory with files is joined, by all its ancestors' paths, with the directories that hold a
licence file, keeps the deepest one, and is joined back to its files.

Defined results: a null text has no licence of its own; a null path is a file of no directory that inherits nothing; a score under the
threshold is no match; ties go to the smaller licence name, then the smaller path; repeated rows are rows of their own; a licence file
without a recognised licence is no licence file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import aside

# Customary notices, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
STOP = ("a", "all", "an", "and", "any", "are", "as", "be", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "without")

@dataclass(frozen=True)
class Scan:
    """Templates, the least cosine of a match, and what the name of a licence file looks like."""

    templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)
    least: float = 0.6
    names: str = r"(?i)^(licen[cs]e|copying|notice)([-_.].*)?$"

    def terms(self) -> list[dict[str, int]]:
        return [{t: words.count(t) for t in words} for _, text in self.templates
                for words in [[w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOP]]]

    def vocabulary(self) -> list[str]:
        return sorted({t for terms in self.terms() for t in terms})


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def _found(text: Column, scan: Scan) -> Column:
    """The words of the vocabulary that a text holds."""
    return F.array_intersect(F.array(*map(F.lit, scan.vocabulary())), _tokens(text))


def weights(files: DataFrame, scan: Scan) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each word of the vocabulary, and of every other word: the greatest of the words that occur."""
    total = F.log(F.lit(files.count()).cast("double")) + 1
    df = files.select(F.explode(_found(F.col("text"), scan)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    seen = dict(map(tuple, df.select("term", (total - F.log(F.col("df").cast("double"))).alias("idf")).collect()))
    other = max(seen.values(), default=1.0)
    return {t: seen.get(t, other) for t in scan.vocabulary()}, other


def best_match(text: Column, scan: Scan, idf: dict[str, float], other: float) -> Column:
    """struct(score, pick) of the line and template with the highest cosine; pick counts down from 0 along the sorted licences.

    Null where no line can reach the threshold.  Each word outside the vocabulary counts for itself.
    """
    vectors = [{t: n * idf[t] for t, n in terms.items()} for terms in scan.terms()]
    norms = [sum(v * v for v in x.values()) ** 0.5 for x in vectors]
    licences = sorted({name for name, _ in scan.templates})
    table = F.array(*[F.struct(F.lit(-licences.index(name)).alias("pick"),
                               F.create_map(*[F.lit(y) for t, v in sorted(x.items()) for y in (t, v * idf[t] / norm)]).alias("terms"))
                      for (name, _), x, norm in zip(scan.templates, vectors, norms)])
    known = F.create_map(*[F.lit(y) for t in sorted(idf) for y in (t, idf[t])])
    vocabulary = F.array(*map(F.lit, scan.vocabulary()))

    def of_line(line: Column) -> Column:
        tokens = F.filter(_tokens(line), lambda t: (t != "") & ~t.isin(*STOP))
        held = F.transform(F.array_intersect(vocabulary, tokens), lambda t: F.struct(
            t.alias("t"), F.size(F.filter(tokens, lambda u: u == t)).cast("double").alias("n"), F.element_at(known, t).alias("idf")))
        return F.struct(F.size(tokens).alias("words"), held.alias("held"))

    def summed(line: Column) -> Column:
        inside = F.aggregate(line["held"], F.lit(0.0), lambda s, x: s + F.pow(x["n"] * x["idf"], F.lit(2.0)))
        count = F.aggregate(line["held"], F.lit(0.0), lambda s, x: s + x["n"])
        return F.struct(line["held"].alias("held"), inside.alias("inside"), (inside + (line["words"] - count) * other * other).alias("whole"))

    def scored(line: Column) -> Column:
        return F.array_max(F.transform(table, lambda row: F.struct(
            F.round(F.aggregate(line["held"], F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.try_element_at(row["terms"], x["t"]), F.lit(0.0)))
                    / F.sqrt(line["whole"]), 6).alias("score"), row["pick"].alias("pick"))))

    lines = F.transform(F.transform(F.split(text, "\n"), of_line), summed)
    # no template can reach the threshold where the vocabulary's share of the line's own length is smaller
    near = F.filter(lines, lambda line: (line["inside"] > 0) & (F.sqrt(line["inside"] / line["whole"]) >= scan.least - 1e-6))
    return F.array_max(F.transform(near, scored))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, down to the empty path."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def scan_licences(files: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """``files`` (columns ``path`` and ``text`` are read) with own_license, own_score, license and inherited_from; columns of these names are replaced.

    A file's own licence stands; without one it takes that of the nearest directory upwards, its own included, that has a licence file.
    """
    idf, other = weights(files, scan)
    licences = F.array(*[F.lit(x) for x in sorted({name for name, _ in scan.templates})])
    own = ["own_license", "own_score", "license", "inherited_from"]
    others = files.drop(*own)
    rows = aside(others, "path", "text").withColumn("_best", best_match(F.col("text"), scan, idf, other))
    match = F.col("_best")["score"] >= scan.least
    rows = rows.withColumns({"own_license": F.when(match, F.element_at(licences, 1 - F.col("_best")["pick"])),
                             "own_score": F.when(match, F.col("_best")["score"]), "_folder": directory(F.col("path"))}).drop("_best")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(scan.names) & F.col("own_license").isNotNull()
    held = (rows.where(named).groupBy(F.col("_folder").alias("_above"))
            .agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("own_license"), F.col("path"))).alias("_license")))
    folders = rows.where("_folder is not null").select("_folder").distinct()
    nearest = (folders.withColumn("_above", F.explode(ancestors(F.col("_folder")))).join(held, "_above").groupBy("_folder")
               .agg(F.max_by(F.struct("_license", "_above"), F.length("_above")).alias("_near")))
    out = rows.join(nearest, "_folder", "left")
    out = out.withColumns({"license": F.coalesce("own_license", F.col("_near")["_license"]),
                           "inherited_from": F.when(F.col("own_license").isNull(), F.col("_near")["_above"])}).drop("_folder", "_near")
    return out.select(*[c for c in out.columns if c not in own], *own).toDF(*others.columns, *own)
