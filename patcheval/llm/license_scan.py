"""Licence texts and notices in documents: Dice coefficient over word bigrams against templates.

Compared are windows of a text's words, wherever they lie: inside a line, over several lines, between comment marks. A window of
``m`` bigrams can reach a coefficient of ``t`` with a template of ``n`` only if ``m`` lies between ``n * t / (2 - t)`` and ``n * (2 - t) / t``
and they share at least ``n * t / (2 - t)`` bigrams. So of ``n`` less that many, plus one, of a template's bigrams one is in the window: those that begin with
the longest words are its anchors. Each place of an anchor gives windows of the template's size, and of those half-way to both bounds, laid so
that their start or their end is the template's. A bigram counts as often as both have it.
"""

from __future__ import annotations

import json
import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.llm.common import KEY, row_key, text_of

THRESHOLD = 0.8
# fixed values: public licence notices, by SPDX identifier
TEMPLATES: tuple[tuple[str, str], ...] = (
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "Zlib")],
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)


def normalised(text: Column) -> Column:
    """Lower-case letters a-z and digits in words with one blank between."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(w: Column) -> Column:
    """Pairs of neighbouring words of a list of two or more."""
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def shared_bigrams(a: Column, b: Column) -> Column:
    """How many elements two lists share, each as often as both have it."""
    times = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    both = F.transform(F.array_intersect(a, b), lambda g: F.least(times(a, g), times(b, g)))
    return F.aggregate(both, F.lit(0), lambda n, x: n + x)


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    return ceil(n * threshold / (2 - threshold) - 1e-9), floor(n * (2 - threshold) / threshold + 1e-9)


def template_bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    if len(w) < 2:
        raise ValueError(f"a template needs two words: {text!r}")
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def anchors(grams: list[str], threshold: float) -> list[int]:
    """Places of a template's anchors: a window that reaches ``threshold`` has one of these bigrams."""
    n = len(grams)
    wanted = n - size_bounds(n, threshold)[0] + 1
    return sorted(sorted(range(n), key=lambda q: (-len(grams[q].split(" ")[0]), -len(grams[q]), q))[:wanted])


def layouts(n: int, threshold: float) -> list[tuple[int, int]]:
    """(start, size) of the windows to lay on a template's place, in bigrams: its own size, and half-way to the bounds at either end."""
    lo, hi = size_bounds(n, threshold)
    sizes = {n, (lo + n) // 2, (n + hi) // 2} if n >= SHORT else {n}
    return sorted({(start, m) for m in sizes for start in (0, n - m)})


#: Templates of fewer bigrams are met by windows of their own size only: of a short notice the part without its last word tells no licence.
SHORT = 8
#: Words of a text that a task looks at together; windows may reach beyond them on either side.
SEGMENT = 2048


def license_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, license_id, dice) for every window of a row that reaches ``threshold`` with a template.

    ``templates`` are texts of two words or more given with the call, of which there are few; without any there are no rows.
    Long texts are cut into segments of words that overlap by the longest window, so that no row is longer than these.
    """
    spark = docs.sparkSession
    known = [(t, i, template_bigrams(text)) for t, (i, text) in enumerate(templates)]
    by_number = spark.createDataFrame([(t, i, g, len(g)) for t, i, g in known], "_t int, license_id string, _b array<string>, _n int")
    if not known:
        return docs.select(*row_key(), F.lit("").alias("license_id"), F.lit(0.0).alias("dice")).where(F.lit(False))
    places: dict[str, list[dict]] = {}
    for t, _, grams in known:
        for q in anchors(grams, threshold):
            places.setdefault(grams[q], []).extend({"t": t, "d": start - q, "m": m} for start, m in layouts(len(grams), threshold))
    pad = 2 * max(m for windows in places.values() for m in [w["m"] for w in windows])
    at = F.from_json(F.lit(json.dumps(places)), "map<string,array<struct<t:int,d:int,m:int>>>")

    w = F.col("_words")
    last = F.size(w) - 1
    cut = lambda s: F.struct(s.alias("s"), F.greatest(s - pad, F.lit(0)).alias("base"), last.alias("end"), F.slice(w, F.greatest(s - pad, F.lit(0)) + 1, F.least(s, F.lit(pad)) + SEGMENT + pad + 1).alias("w"))
    segments = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1, F.lit(SEGMENT)), cut))
    cells = docs.select(*row_key(), F.split(normalised(text_of()), " ").alias("_words")).select(*KEY, F.explode(segments).alias("_c"))
    cells = cells.select(*KEY, "_c.*")

    # places in the segment whose word begins an anchor, then those where an anchor stands
    here = F.sequence(F.col("s") - F.col("base"), F.least(F.col("s") + SEGMENT, F.col("end")) - F.col("base") - 1)
    begin = F.filter(here, lambda i: F.get("w", i).isin(sorted({g.split(" ")[0] for g in places})))
    grams = F.transform(begin, lambda i: F.struct((i + F.col("base")).alias("p"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("g")))
    hits = F.filter(grams, lambda h: h["g"].isin(sorted(places)))
    window = lambda p: lambda e: F.struct(e["t"].alias("t"), F.greatest(p + e["d"], F.lit(0)).alias("a"), F.least(p + e["d"] + e["m"], F.col("end")).alias("b"))
    windows = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(at, h["g"]), window(h["p"])))))
    # a layout may lie wholly before or behind the text
    windows = F.filter(windows, lambda x: x["a"] < x["b"])
    laid = cells.select(*KEY, "base", "w", F.explode(windows).alias("_x")).select(
        *KEY, F.col("_x.t").alias("_t"), F.slice("w", F.col("_x.a") - F.col("base") + 1, F.col("_x.b") - F.col("_x.a") + 1).alias("_u"),
        (F.col("_x.b") - F.col("_x.a")).alias("_m"),
    )
    least = F.when(F.col("_n") < SHORT, F.col("_n")).otherwise(F.col("_n") * threshold / (2 - threshold) - 1e-9)
    met = laid.join(F.broadcast(by_number), "_t").where(F.col("_m") >= least)
    met = met.select(*KEY, "license_id", "_b", "_n", "_m", bigrams(F.col("_u")).alias("_g"))
    dice = F.round(2 * shared_bigrams(F.col("_g"), F.col("_b")) / (F.col("_m") + F.col("_n")), 6)
    return met.select(*KEY, "license_id", dice.alias("dice")).where(F.col("dice") >= threshold)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license_id, dice, license_ids) for every row: the best licence (then the first by id), its coefficient and all
    licences found, sorted; nulls and '' where none is, as in null and empty texts."""
    found = license_matches(docs, templates, threshold).groupBy(*KEY).agg(
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("license_id").alias("i"))).alias("_best"), F.array_sort(F.collect_set("license_id")).alias("_all")
    )
    rows = docs.select("doc_id", *row_key())
    return rows.join(found, KEY, "left").select(
        "doc_id", F.col("_best.i").alias("license_id"), (-F.col("_best.d")).alias("dice"), F.coalesce(F.array_join("_all", ","), F.lit("")).alias("license_ids")
    )
