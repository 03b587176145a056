"""Licence scans: Dice coefficient over word bigrams against licence templates. DataFrame functions
only.

Units are the lines of a text, its paragraphs of several lines (lines without letters or digits
part them), the text as a whole, and windows: the words of a text from any word pair of a template
on, as many as that template has. Windows find notices wrapped over lines inside longer texts. A
unit and a template are lower-cased and reduced to their letters and digits; their similarity is twice the number of distinct word bigrams
in common over the sum of both numbers. At LEAST_DICE the two sizes cannot differ by more than a
fixed factor, so units outside the size bounds of all templates never get bigrams, and pairs
outside a template's own bounds are never counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_DICE = 0.8
#: What parts paragraphs: a line without letters and digits.
PARAGRAPH_GAP = r"\n[^\p{L}\p{N}\n]*+\n"

# Notices and licence texts in public use, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: str) -> Column:
    """Hashes of the distinct word pairs of an array column; empty below two words."""
    return F.expr(
        f"if(size({words}) < 2, array(), array_distinct(transform(sequence(0, size({words}) - 2),"
        f" i -> xxhash64({words}[i], {words}[i + 1]))))"
    )


def _template_rows(spark: SparkSession, templates) -> DataFrame:
    """template, licence, hs, length, size, h: a row per bigram; length is the number of pairs with repeats."""
    rows = spark.createDataFrame([(n, licence, text) for n, (licence, text) in enumerate(templates)], "template int, licence string, text string")
    words = rows.select("template", "licence", F.split(normalised(F.col("text")), " ").alias("words"))
    pairs = words.select("template", "licence", bigrams("words").alias("hs"), (F.size("words") - 1).alias("length"))
    return pairs.select("template", "licence", "hs", "length", F.size("hs").alias("size"), F.explode_outer("hs").alias("h"))


def _windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, row_key, unit, whole_text, template, licence, n, size, common: windows of a template's length.

    A window begins at a word pair of its template and is cut out of the row's text before rows
    are multiplied, so no text is copied or shuffled.
    """
    rows = known.select("length", "h").distinct().collect()
    if not rows:
        rows = [{"length": 1, "h": 0}]
    longest, hashes = max(r["length"] for r in rows), sorted({r["h"] for r in rows})
    pairs = F.expr("if(size(words) < 2, array(), transform(sequence(0, size(words) - 2), i -> xxhash64(words[i], words[i + 1])))")
    starts = F.filter(F.transform("pairs", lambda h, i: F.when(h.isin(hashes), i)), lambda i: i.isNotNull())
    cut = F.transform(starts, lambda i: F.struct((-1 - i).alias("unit"), F.slice("pairs", i + 1, longest).alias("run")))
    window = F.expr("array_distinct(slice(run, 1, length))")
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.split(normalised(F.col("text")), " ").alias("words"))
        .select("doc_id", "row_key", pairs.alias("pairs"))
        .select("doc_id", "row_key", F.explode(cut).alias("of"))
        .select("doc_id", "row_key", "of.unit", "of.run", F.col("of.run")[0].alias("h"))
        .join(F.broadcast(known), "h")
        .select("doc_id", "row_key", "unit", F.lit(False).alias("whole_text"), "template", "licence", "size", "hs", window.alias("window"))
        .select(
            "doc_id", "row_key", "unit", "whole_text", "template", "licence", F.size("window").alias("n"), "size",
            F.size(F.array_intersect("window", "hs")).cast("bigint").alias("common"),
        )
    )


def licence_matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, licence, dice, whole_text: the best match of each licence in each document.

    A unit belongs to its most similar template only, the earlier one of a tie.

    `templates` are (licence, text) pairs, a fixed list of a few dozen, sent to all tasks. Null,
    empty and wordless texts match nothing, templates of one word neither. The best of equal
    matches of a licence is the one of the whole text. Documents repeated under one id are
    scanned together; rows with a null doc_id are reported with it. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = _template_rows(spark, templates).filter("h is not null")
    sizes = [r["size"] for r in known.select("template", "size").distinct().collect()]
    if not sizes:
        sizes = [0]
    # Bounds a little wider than the threshold: sizes exactly at the factor are not lost to
    # rounding; the Dice coefficient itself decides.
    factor = (2 - least) / least * (1 + 1e-5)
    fewest = min(sizes) / factor
    most = max(sizes) * factor
    lines = F.concat(
        F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("unit"), F.lit(False).alias("whole_text"))),
        F.array(F.struct(F.col("text").alias("unit"), F.lit(True).alias("whole_text"))),
        F.transform(
            F.filter(F.split("text", PARAGRAPH_GAP), lambda part: part.contains("\n")),
            lambda part: F.struct(part.alias("unit"), F.lit(False).alias("whole_text")),
        ),
    )
    # A unit is known by its row's text and its place there, so a repeated task gives the same units.
    units = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode_outer(lines).alias("unit", "of"))
        .select("doc_id", "row_key", "unit", "of.whole_text", F.split(normalised(F.col("of.unit")), " ").alias("words"))
        .select("doc_id", "row_key", "unit", "whole_text", bigrams("words").alias("hs"))
        # Not nullable: else a filter for null counts would be moved below and split each unit anew.
        .select("doc_id", "row_key", "unit", "whole_text", F.coalesce(F.size("hs"), F.lit(0)).alias("n"), "hs")
        .select("doc_id", "row_key", "unit", "whole_text", "n", F.when(F.col("n").between(fewest, most), F.col("hs")).alias("hs"))
        .select("doc_id", "row_key", "unit", "whole_text", "n", F.explode_outer("hs").alias("h"))
    )
    dice = 2 * F.col("common") / (F.col("n") + F.col("size"))
    lined = (
        units.join(F.broadcast(known.drop("hs", "length")), "h")
        .filter((F.col("n") >= F.col("size") / factor) & (F.col("n") <= F.col("size") * factor))
        .groupBy("doc_id", "row_key", "unit", "whole_text", "template", "licence", "n", "size")
        .agg(F.count("*").alias("common"))
    )
    return (
        lined.unionByName(_windows(docs, known))
        .withColumn("dice", F.round(dice, 6))
        .filter(F.col("dice") >= least)
        # A unit counts for its most similar template.
        .groupBy("doc_id", "row_key", "unit", "whole_text")
        .agg(F.max(F.struct("dice", (-F.col("template")).alias("order"), "licence")).alias("best"))
        .select("doc_id", "whole_text", "best.licence", "best.dice")
        .groupBy("doc_id", "licence")
        .agg(F.max(F.struct("dice", "whole_text")).alias("best"))
        .select("doc_id", "licence", "best.dice", "best.whole_text")
    )
