"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is cut into sentences and lines. Those that hold a licence word become sparse TF-IDF vectors and are compared
with the templates' vectors by a join on terms; so is the whole text of a file named like a licence file. Standard headers and the titles and
first sentences of licence texts are compared in the same way with sentences whose wrapped lines have been joined; SPDX
identifiers are read as they stand. A file
whose text is mainly notices, or that is named so, is its directory's licence file. Files without a notice of their own
take the licence of the nearest directory above that has one: directories are joined with their ancestors' licences by path.
Everything is a DataFrame operation; texts aren't shuffled, only the terms of notices and paths are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estima.llm.common import WORD, drop_stored, stored

#: Licences and the notices that stand for them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
#: Standard headers, and titles and first sentences of licence texts.
FORMS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?i:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
#: Fixed value: a notice holds one of these.
LICENCE_WORDS = r"(?i)licen[cs]e|rights reserved|permission|redistribution|public domain|spdx"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
LEAST_SCORE = 0.75
LEAST_SHARE = 0.2  # of a file's words in notices that makes it a licence file


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+([A-Z])", "$1\n$2"), "\n")


def joined(text: Column) -> Column:
    """The text without comment marks, each paragraph and each copyright line on one line."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?im)^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|\"{3}|'{3}|(?:dnl|rem)(?=[ \t]))[ \t]*)+", "")
    text = F.regexp_replace(text, r"(?im)^[ \t]*(?:copyright|\(c\)|©|SPDX-)[^\n]*$", "$0\n")
    text = F.regexp_replace(text, r"\n[ \t]*+\n\s*+", "\u0001")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*+\n[ \t]*+", " "), "\u0001", "\n")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def template_vectors(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(license, template, term, idf, weight), each template's weights of length 1."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, text string")
    tf = rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(1.0 + len(templates))) / (1 + F.col("df"))) + 1
    weighted = tf.join(df, "term").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return weighted.select("license", "template", "term", "idf", (F.col("w") / length).alias("weight"))


def best_license(units: DataFrame, vectors: DataFrame, n: int, least: float) -> DataFrame:
    """units (file, unit, text) -> file, license, score: each file's best of the n templates by cosine, ties to the first name."""
    unseen = math.log(1.0 + n) + 1
    tf = units.select("file", "unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("file", "unit", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(vectors.select("term", "idf").distinct())
    w = tf.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen))).drop("idf")
    lengths = w.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = w.join(F.broadcast(vectors.drop("idf")), "term").groupBy("file", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(lengths, ["file", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= least)
    top = scored.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return top.select("file", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path; of the root, the empty path, null."""
    return F.when(path == "", F.lit(None)).otherwise(F.regexp_replace(path, "/?[^/]*$", ""))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root (the empty path) last."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_SCORE, share: float = LEAST_SHARE, forms: Sequence[tuple[str, str]] = FORMS) -> DataFrame:
    """files (file, path, text) -> file, path, own_license, score, is_licence_file, inherited_from, license; a row for each row.

    own_license is the file's SPDX identifier (its expression, without -only and -or-later; score 1), or else the best of the templates of its
    notices and of the forms of its joined ones, null below `least`, a bare reservation of rights only where there is nothing else; license is that or the one inherited
    from the directory inherited_from. Of several licence files in a directory the one with the highest score counts, ties to the
    smaller license. Null and empty texts have no notice; a null path has no directory and inherits nothing; `file` is an
    id, and rows that repeat it share their best notice. Whole texts are read, however long. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    slim = files.select("file", "path", F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1).rlike(LICENCE_FILE).alias("named"), text.alias("text"))
    has = F.col("named") | F.col("text").rlike(LICENCE_WORDS)
    notices = F.when(has, F.filter(sentences(F.col("text")), lambda x: x.rlike(LICENCE_WORDS))).otherwise(F.array().cast("array<string>"))
    forms_of = F.when(has, F.filter(sentences(joined(F.col("text"))), lambda x: x.rlike(LICENCE_WORDS))).otherwise(F.array().cast("array<string>"))
    spdx = F.when(has, F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = slim.select("file", "path", "named", notices.alias("notices"), F.when(F.col("named"), F.col("text")).alias("whole"), forms_of.alias("forms"), spdx.alias("spdx"), F.when(has, F.regexp_count("text", F.lit(WORD))).otherwise(0).alias("words"))
    found = found.withColumn("notice_words", F.aggregate("notices", F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(WORD))))
    # notices, and the few licence files' texts, are all that goes on from here
    found = stored(found, "notices")
    lines = found.select("file", F.explode("notices").alias("text"))
    whole = found.where("whole is not null").select("file", F.col("whole").alias("text"))
    units = lines.unionByName(whole).withColumn("unit", F.xxhash64("text"))
    ids = found.select("file", F.explode("spdx").alias("id")).select("file", F.lit(0).alias("way"), F.regexp_replace("id", r"(?:-only|-or-later|\+)(?=$|[ \t)])", "").alias("license"), F.lit(1.0).alias("score"))
    used = [stored(template_vectors(files.sparkSession, x), "templates") for x in (templates, (*templates, *forms))]  # as many rows as the templates have words
    by_notice = best_license(units.distinct(), used[0], len(templates), least).withColumn("way", F.lit(1))
    of_forms = found.select("file", F.explode("forms").alias("text")).withColumn("unit", F.xxhash64("text"))
    by_form = best_license(of_forms.distinct(), used[1], len(templates) + len(forms), least).withColumn("way", F.lit(2))
    rank = F.struct((F.col("way") != 0).alias("guessed"), (F.col("license") == "Proprietary").alias("last"), (-F.col("score")).alias("minus"), "way", "license")
    own = by_notice.unionByName(by_form).unionByName(ids).groupBy("file").agg(F.min(rank).alias("best"))
    own = stored(own.select("file", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score")), "own")
    rows = found.select("file", "path", "named", "words", "notice_words").join(own, "file", "left")
    drop_stored(*used)
    is_file = F.coalesce(F.col("license").isNotNull() & (F.col("named") | (F.col("notice_words") >= share * F.col("words"))), F.lit(False))
    rows = rows.withColumn("is_licence_file", is_file).withColumn("directory", parent(F.col("path")))

    by_directory = rows.where("is_licence_file and directory is not null").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    by_directory = stored(by_directory.select("directory", F.col("best.license").alias("of_directory")), "directories")
    wanted = rows.where("license is null and directory is not null").select("directory").distinct()
    above = wanted.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "ancestor"))
    near = above.join(by_directory.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.min(F.struct("up", "ancestor", "of_directory")).alias("near"))
    near = stored(near.select("directory", F.col("near.ancestor").alias("inherited_from"), F.col("near.of_directory").alias("inherited")), "nearest")
    drop_stored(by_directory)
    out = rows.join(near, "directory", "left")
    inherits = F.col("license").isNull()
    return out.select(
        "file", "path", F.col("license").alias("own_license"), "score", "is_licence_file",
        F.when(inherits, F.col("inherited_from")).alias("inherited_from"), F.coalesce("license", "inherited").alias("license"),
    )
