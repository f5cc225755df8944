"""License scans with DataFrame functions only.

Units are the blocks of lines between blank lines and the single lines that speak of a licence, and the whole text of
licence files. A unit's terms are weighted by TF-IDF over all units; the cosine to each template decides its licence. A document
without a licence inherits that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import checkpoint

#: Titles and notices of common licences.
TEMPLATES = (
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Artistic-1.0", "The Artistic License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of which every template has one; blocks and lines without any aren't compared.
CUE = r"(?i)licen[cs]|copyright|spdx|permission|redistribut|public\s+domain|creative\s+commons|\bcc(0|[\s-]by)"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
BLANK = r"\n[ \t\r]*\n"
LEAST_COSINE = 0.6


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and dots between them: version numbers stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>> of a text: the runs of equal values in its sorted term hashes."""
    found = F.array_sort(F.transform(terms(text), lambda w: F.xxhash64(w)))
    return F.transform(F.array(found), _runs)[0]


def _runs(found: Column) -> Column:
    starts = F.filter(F.transform(found, lambda t, i: F.when((i == 0) | (F.get(found, i - 1) != t), i)), lambda i: i.isNotNull())
    counts = lambda starts: F.transform(starts, lambda b, k: F.struct(F.get(found, b).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(found)) - b).alias("tf")))
    return F.transform(F.array(starts), counts)[0]


def match_templates(units: DataFrame, templates: DataFrame) -> DataFrame:
    """(unit, licence, cosine): the most similar template of each unit(unit, text) with a cosine above 0.

    idf is ln((1 + units) / (1 + units with the term)) + 1 over all rows of units that have terms; a template's terms that
    no unit has weigh the most. Ties go to the licence that sorts first. Rows of one unit have the same text; they count
    as several units in idf. Terms are told apart by 64-bit hashes.

    A unit is one row, so its terms are counted in place, once, and kept as two arrays beside a number of the row; what
    moves is one row of numbers for each distinct term of a unit, once to its idf and once, as partial sums, to its unit.
    """
    numbered = units.select("unit", F.monotonically_increasing_id().alias("u"), term_counts(F.col("text")).alias("t"))
    numbered = checkpoint(numbered.select("unit", "u", F.transform("t", lambda x: x["term"]).alias("term"), F.transform("t", lambda x: x["tf"]).alias("tf")))
    counted = numbered.select("u", F.inline(F.arrays_zip("term", "tf")))
    total = numbered.where(F.size("term") > 0).agg(F.count("*").alias("n"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = lambda n, df: F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1

    own = templates.withColumn("template", F.monotonically_increasing_id()).select("template", "licence", F.inline(term_counts(F.col("text"))))
    own = own.join(df, "term", "left").crossJoin(F.broadcast(total)).select("template", "licence", "term", (F.col("tf") * idf(F.col("n"), F.coalesce("df", F.lit(0)))).alias("tw"))  # total is one row
    length = own.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("length"))
    own = own.join(length, "template").groupBy("term").agg(F.collect_list(F.struct("template", "licence", (F.col("tw") / F.col("length")).alias("tw"))).alias("own"))

    weighted = counted.join(df.hint("shuffle_hash"), "term").crossJoin(F.broadcast(total)).select("u", "term", (F.col("tf") * idf(F.col("n"), F.col("df"))).alias("w"))
    weighted = weighted.join(F.broadcast(own), "term", "left")  # own has the terms of the templates, a table of fixed size
    shared = F.collect_list(F.when(F.col("own").isNotNull(), F.struct("w", "own")))
    by_unit = weighted.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), shared.alias("shared"))
    dots = by_unit.select("u", "norm", F.explode("shared").alias("s")).select("u", "norm", "s.w", F.inline("s.own"))
    dots = dots.groupBy("u", "template").agg(F.first("licence").alias("licence"), F.first("norm").alias("norm"), F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosines = dots.select("u", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = cosines.groupBy("u").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    best = best.join(numbered.select("u", "unit"), "u").groupBy("unit").agg(F.min("b").alias("b"))
    return best.select("unit", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def template_rows(spark: SparkSession) -> DataFrame:
    """The templates, and each licence's tag, a table of fixed size."""
    tags = [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in TEMPLATES}) for end in ("", "-only", "-or-later")]
    return spark.createDataFrame([*TEMPLATES, *tags], "licence string, text string").coalesce(1)


def ancestors(directory: Column) -> Column:
    """directory and all directories above it, with their depths; the root is the empty path with depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, path, licence, cosine, origin) for every row of docs.

    origin is 'file' for the licence of a licence file's whole text, 'header' for one of a block or a line in any text (the
    larger cosine counts, of equal ones the header), 'inherited' for that of the nearest directory at or above with a
    licence file (a file named licence, copying or notice whose own text has a licence; of several in one directory the
    largest cosine, then the first path), else 'none' with nulls. Blocks end at blank lines, lines at line feeds; all are
    read to the end of the text. A null text has none; a null path takes no part in inheritance. Rows that repeat are
    separate rows with the same result; columns of other names are not read.
    """
    clean = F.regexp_replace(path, "^/+|/+$", "")
    rows = docs.select(F.col(id_col).alias("id"), clean.alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\u0001", given("id"), given("path"), "text")))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    cued = lambda parts: F.filter(parts, lambda x: x.rlike(CUE))
    parts = F.array_distinct(F.concat(cued(F.split("text", BLANK)), cued(F.split("text", "\n"))))
    kept = rows.where(F.col("text").rlike(CUE) | named).select("key", F.when(named, F.col("text")).alias("text"), parts.alias("parts"))
    unit = lambda n: F.struct(F.col("key"), n.alias("line"))
    units = kept.select("key", F.posexplode(F.concat(F.array("text"), "parts")).alias("line", "text")).where("text is not null").select(unit(F.col("line")).alias("unit"), "text")
    found = match_templates(units, template_rows(docs.sparkSession)).where(F.col("cosine") >= LEAST_COSINE)
    found = found.groupBy(F.col("unit.key").alias("key")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), (F.col("unit.line") == 0).alias("o"), "licence")).alias("b"))
    found = found.select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), F.when(F.col("b.o"), "file").otherwise("header").alias("origin"))

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = rows.select("id", "path", "key", folder.alias("folder"), named.alias("named"))
    rows = checkpoint(rows.join(checkpoint(found), "key", "left"))
    held = rows.where("named and licence is not null").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("b"))
    held = held.select(F.col("folder").alias("above"), F.col("b.licence").alias("near"), (-F.col("b.c")).alias("near_cosine"))
    folders = rows.where("folder is not null").select("folder").distinct()
    nearest = folders.select("folder", F.inline(ancestors(F.col("folder")))).join(held, "above").groupBy("folder").agg(F.max_by(F.struct("near", "near_cosine"), "depth").alias("n"))
    rows = rows.join(nearest.select("folder", "n.near", "n.near_cosine"), "folder", "left")
    origin = F.coalesce("origin", F.when(F.col("near").isNotNull(), "inherited"), F.lit("none"))
    return rows.select(F.col("id").alias(id_col), "path", F.coalesce("licence", "near").alias("licence"), F.coalesce("cosine", "near_cosine").alias("cosine"), origin.alias("origin"))


def document_paths(id_col: str = "doc_id", source_col: str = "source") -> Column:
    """A path for each document from its own columns: directories of the source, of 1,000 and of 50 ids; every fifth id
    is a licence file, in one of the three directories."""
    id_, source = F.col(id_col), F.coalesce(F.col(source_col), F.lit("unknown"))
    number = lambda x: F.floor(x).cast("bigint").cast("string")
    part, group = F.concat(F.lit("/part-"), number(id_ / 1000)), F.concat(F.lit("/set-"), number(id_ % 1000 / 50))
    level = F.when(id_ % 15 == 0, F.concat(source, part)).when(id_ % 15 == 5, F.concat(source, part, group)).otherwise(source)
    return F.when(id_ % 5 == 0, F.concat(level, F.lit("/LICENSE"))).otherwise(F.concat(source, part, group, F.lit("/doc-"), id_.cast("string"), F.lit(".txt")))
