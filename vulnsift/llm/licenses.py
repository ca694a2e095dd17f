"""License scans with DataFrame functions only.

A text becomes its words (runs of letters and digits, lower case) and the hashes of its 5-word shingles.
Overlapping windows of WINDOW shingles are sketched by BANDS min-hashes of one row each (the least hash
after XOR with a fixed number); a template's windows, taken at every offset, carry the same sketches. Templates
of fewer shingles are windows of one shingle, whose min-hash is the shingle's own hash. One broadcast join with the
fixed template keys retrieves windows and shingles; what was retrieved is verified by exact shingle containment.

A window inside an unchanged copy equals a template window and always collides; one of Jaccard similarity j is
retrieved with probability 1 - (1 - j)^BANDS (0.98 at 0.5, 0.9999 at 0.8), and an occurrence of n shingles holds
about n / STRIDE windows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, BANDS, LEAST = 5, 8, 4, 6, 0.8

# Notices of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                 "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met:",
}

#: The fixed numbers of the bands.
MASKS = [(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) - (1 << 63) for k in range(BANDS)]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _keys(docs: DataFrame, id_col: str, text_col: str, stride: int) -> DataFrame:
    """Rows (id, n, at, key): all shingle hashes of a text, then the min-hashes of its windows, band by band; `_place`
    tells which is which. Each array is a column that the next step uses more than once, so that it is computed once
    per row, and no array is carried through the explode."""
    words = F.regexp_extract_all(F.lower(docs[text_col]), F.lit(r"[\p{L}\p{N}]+"), 0)
    n, h = F.col("n"), F.xxhash64
    rows = docs.select(docs[id_col].alias("id"), F.transform(words, lambda w: h(w)).alias("w"))
    rows = rows.select("id", "w", F.greatest(F.coalesce(F.size("w"), F.lit(0)) - (SHINGLE - 1), F.lit(0)).alias("n"))
    # hashes of 2, 4 and 5 words
    rows = rows.select("id", "w", "n", F.zip_with(F.slice("w", 1, n + 3), F.slice("w", 2, n + 3), lambda x, y: h(x, y)).alias("h2"))
    rows = rows.select("id", "w", "n", F.zip_with(F.slice("h2", 1, n + 1), F.slice("h2", 3, n + 1), lambda x, y: h(x, y)).alias("h4"))
    rows = rows.select("id", "n", F.zip_with(F.slice("h4", 1, n), F.slice("w", SHINGLE, n), lambda x, y: h(x, y)).alias("sh"))
    last = F.greatest(n - WINDOW, F.lit(0)) + 1
    # every `stride`-th window, and the last whole one; one short window if there is no whole one
    rows = rows.select("id", "n", "sh", F.concat(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last)).alias("st"))

    def sketch(mask: int) -> Column:
        # element by element: slice() inside a lambda would copy the whole array for every window
        return F.transform("st", lambda i: F.least(*(F.get("sh", i + (j - 1)).bitwiseXOR(F.lit(mask).cast("long")) for j in range(WINDOW))))

    return rows.select("id", "n", F.posexplode(F.concat("sh", *map(sketch, MASKS))).alias("at", "key"))


def _place(stride: int) -> tuple[Column, Column]:
    """kind and pos of a key of `_keys`: kind 0 is a shingle and its place, kind k a window's min-hash in band k and the
    window's first shingle."""
    whole = F.greatest(F.col("n") - WINDOW, F.lit(0))
    windows = F.floor(whole / stride).cast("int") + 2
    after = F.col("at") - F.col("n")
    return (F.when(after < 0, 0).otherwise(F.floor(after / windows).cast("int") + 1),
            F.when(after < 0, F.col("at")).otherwise(F.least(F.pmod(after, windows) * stride, whole)).cast("int"))


def template_keys(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, size (distinct shingles), t_kind, idx, t_key of the fixed templates; a shingle that comes twice counts once."""
    rows = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(v).alias("text")) for k, v in sorted(templates.items())))
    table = spark.range(1).select(F.inline(rows))
    kind, pos = _place(1)
    keys = _keys(table, "id", "text", 1).withColumns({"t_kind": kind, "pos": pos}).groupBy("id", "t_kind", "key").agg(F.min("pos").alias("idx"))
    sizes = keys.where("t_kind = 0").groupBy("id").agg(F.count("*").alias("size"))
    return keys.join(F.broadcast(sizes), "id").where((F.col("t_kind") == 0) | (F.col("size") >= WINDOW)) \
        .select(F.col("id").alias("license"), "size", "t_kind", "idx", F.col("key").alias("t_key"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license notice found: doc_id, license, start_word and end_word (exclusive), n_matched shingles
    and containment (of the template's distinct shingles, at least LEAST).

    An occurrence is a run of retrieved shingles in template order, no further apart than the template is long;
    it counts if a retrieved window covers one of them (templates of WINDOW shingles and more). Null, empty and short texts hold
    nothing; repeated rows of an id are taken as one; a null id is reported as null; other columns are not read. The
    templates are the only broadcast side and a constant of the call.
    """
    keys = template_keys(docs.sparkSession, templates)
    kind, pos = _place(STRIDE)
    hits = _keys(docs, id_col, text_col, STRIDE).join(F.broadcast(keys), F.col("key") == F.col("t_key")) \
        .withColumns({"kind": kind, "pos": pos}).where("kind = t_kind") \
        .select(F.col("id").alias("doc_id"), "license", "size", "kind", "pos", "idx").distinct()
    group = Window.partitionBy("doc_id", "license")
    order = group.orderBy("pos", "idx")
    covered = F.max(F.when(F.col("kind") > 0, 1)).over(group.orderBy("pos").rangeBetween(1 - WINDOW, 0))
    exact = hits.withColumn("band", covered).where(F.col("kind") == 0)
    new = (F.col("idx") < F.lag("idx").over(order)) | (F.col("pos") - F.lag("pos").over(order) > F.col("size") + WINDOW)
    runs = exact.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    found = runs.groupBy("doc_id", "license", "size", "run").agg(
        F.countDistinct("idx").alias("n_matched"), F.max("band").alias("band"),
        F.min("pos").cast("long").alias("start_word"), (F.max("pos") + SHINGLE).cast("long").alias("end_word"))
    share = F.col("n_matched") / F.col("size")
    return found.where((share >= LEAST) & (F.col("band").isNotNull() | (F.col("size") < WINDOW))) \
        .select("doc_id", "license", "start_word", "end_word", "n_matched", share.alias("containment"))
