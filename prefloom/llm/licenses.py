"""Licence scan (DataFrame, SQL and spark.ml functions only).

A text is read as words, whatever its line breaks; a line without a letter or digit stands as
one foreign word between paragraphs. A notice may be wrapped, commented or inside a longer
paragraph, and is reported at the line (from 0) on which it begins, once per family.

1. Candidates: neighbouring words that a template holds are laid on the template's own order;
   a candidate has at least ``CONFIRM`` (and three, or all) of the template's distinctive pairs
   (not two common words or two numbers) and half of its key pairs (which no other family's templates hold) at about one place.
   A title counts only if it is a line of its own.
2. A multinomial logistic regression over sparse word 1- and 2-grams (hashed, present or not)
   tells licence families from ordinary paragraphs. It is trained on the families' templates,
   alone, inside ordinary paragraphs and with words left out, against at most about
   ``BACKGROUND`` paragraphs of the corpus itself (one per document, chosen by a hash) that
   hold no licence word.
3. The margin between a family and "unknown" is calibrated on held-out rows of that training
   set by a second logistic regression. Every candidate's words are scored for its own family,
   and every family at ``ACCEPT`` or over is reported, so that dual notices give both.

Defined results: a null or empty text has no paragraph; paragraphs without a licence give
nothing; repeated rows (same id and text) give the same result each; an empty table is
classified by a model trained without a background of its own. Extra columns pass through.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKGROUND = 3_000
VARIANTS = 40
FEATURES = 1 << 14
ACCEPT = 0.5
CONFIRM = 0.6
UNKNOWN = "unknown"

_CC = {"cc-by": "Attribution", "cc-by-nc": "Attribution-NonCommercial", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives",
       "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache-2.0": ("Apache-2.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"), "bsl": ("BSL-1.0",),
    "cc0": ("CC0-1.0",), "epl": ("EPL-1.0", "EPL-2.0"), "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"), "isc": ("ISC",),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "mit": ("MIT", "MIT-0"), "mpl": ("MPL-2.0",),
    "unlicense": ("Unlicense",), "zlib": ("Zlib",),
} | {k: tuple(f"{k.upper()}-{v}" for v in ("2.0", "2.5", "3.0", "4.0")) for k in _CC}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'


def _gnu(name: str, versions: tuple[str, ...]) -> tuple[str, ...]:
    return (f"under the terms of the {name} as published by the Free Software Foundation", f"under the terms of the {name}",
            f"You should have received a copy of the {name} along with this program",
            *[f"{x} the {name}, version {v}" for v in versions for x in ("Licensed under", "This work is licensed under", "Released under")],
            *[f"{name} v{v}" for v in versions], f"distributed under the {name}")


# fixed values: notices and texts by licence family, sentence by sentence
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": _gnu("GNU Affero General Public License", ("3",)) + ("Licensed under the AGPL", "Licensed under AGPLv3", "licensed under the AGPL-3.0"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "Apache License, Version 2.0", "Dual licensed under MIT and Apache", "under the Apache 2.0 license",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
                   "See the License for the specific language governing permissions and limitations under the License."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Licensed under the BSD License", "Released under the BSD License", "governed by a BSD-style license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "bsl": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0 1.0 Universal",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "This work is dedicated to the public domain.", "dedicated to the public domain under CC0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Licensed under the Eclipse Public License", "Eclipse Public License v2.0", "Eclipse Public License v1.0"),
    "gpl": _gnu("GNU General Public License", ("2", "3")) + ("Licensed under the GPL", "Licensed under the GPLv3", "Licensed under the GPLv2", "licensed under the GPL-3.0", "Dual licensed under the MIT and GPL licenses"),
    "isc": ("Licensed under the ISC License", "Released under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl": _gnu("GNU Lesser General Public License", ("2.1", "3")) + ("Licensed under the LGPL", "Licensed under LGPLv3", "licensed under the LGPL-2.1"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "under the MIT License", "is MIT licensed", "or MIT license at your option", "Licensed under either of MIT license", "Dual licensed under the MIT and GPL licenses",
            "Dual licensed under MIT and Apache", "use of this source code is governed by an MIT-style license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "Mozilla Public License Version 2.0",
            "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "Unauthorized copying of this file is strictly prohibited.", "proprietary and confidential"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "zlib": ("Licensed under the zlib License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
             "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
}
for _k, _n in _CC.items():
    _short = "CC " + _k[3:].upper()
    TEMPLATES[_k] = tuple(x for v in ("2.0", "2.5", "3.0", "4.0") for x in (f"Licensed under {_short} {v}.", f"{_short} {v}", f"Creative Commons {_n} {v}"))
    TEMPLATES[_k] += (f"This work is licensed under a Creative Commons {_n} 4.0 International License.", f"Creative Commons {_n} License")
for _k, _ids in _SPDX.items():
    TEMPLATES[_k] += tuple(f"SPDX-License-Identifier: {x}" for x in _ids)
# names that are a notice where they are a line of their own
TITLES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License",), "apache-2.0": ("Apache License", "Apache License 2.0", "Apache 2.0"), "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD License"),
    "bsl": ("Boost Software License",), "epl": ("Eclipse Public License",), "gpl": ("GNU General Public License", "The GNU General Public License"), "isc": ("ISC License",),
    "lgpl": ("GNU Lesser General Public License",), "mit": ("MIT License", "The MIT License", "The MIT License (MIT)", "License: MIT"), "mpl": ("Mozilla Public License",),
    "unlicense": ("The Unlicense",), "zlib": ("zlib License", "The zlib License"),
}
_COMMON = frozenset("a an and any are as at be by for from in is it its of on or that the this to with not use used you your may will 0 1 2 3 4 5".split())
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
_HINT = r"(?i)licen[sc]|copyright|copying|rights|permission|spdx|redistribut|public domain|creative commons|cc0|gnu |warrant|disclaim"
# what stands for a line without a letter or digit; no template holds it
_BLANK = "\n"


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def _words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def _template_rows() -> list[tuple]:
    """(pair, template, place in it, family, pairs of the template, is a key pair, key pairs, words if it is a title)."""
    all_ = [(k, _words(x), title) for title, texts in ((False, TEMPLATES), (True, TITLES)) for k in sorted(texts) for x in texts[k]]
    holders: dict[str, set] = {}
    for k, w, _ in all_:
        for x in zip(w, w[1:], strict=False):
            holders.setdefault(" ".join(x), set()).add((k, tuple(w)))
    rows = []
    for n, (k, w, title) in enumerate(all_):
        at = [(i, f"{x} {y}") for i, (x, y) in enumerate(zip(w, w[1:], strict=False)) if not (x in _COMMON and y in _COMMON and x.isdigit() == y.isdigit())]
        own = {x for _, x in at}
        # a text that two families share (a dual notice) is no other's
        key = {x for x in own if all(f == k or t == tuple(w) for f, t in holders[x])}
        rows += [(x, n, i, FAMILIES.index(k), len(own), x in key, len(key), len(w) if title else 0) for i, x in at]
    return rows


def _anchors(rows: list[tuple]) -> list[str]:
    """Words without one of which no template can reach ``CONFIRM``: a text that holds none is not read further."""
    pairs: dict[int, set[str]] = {}
    for x, n, *_ in rows:
        pairs.setdefault(n, set()).add(x)
    chosen: list[str] = []
    while True:
        bare = {n: [x for x in own if not set(x.split()) & set(chosen)] for n, own in pairs.items()}
        score = Counter(w for n, left in bare.items() if len(left) >= CONFIRM * len(pairs[n]) for x in left for w in set(x.split()) - _COMMON)
        if not score:
            return chosen
        chosen.append(max(sorted(score), key=lambda w: score[w]))


def _vectors(df: DataFrame) -> DataFrame:
    """``df`` with words in ``_t``: 1- and 2-grams hashed into a sparse vector ``_v``."""
    df = NGram(n=2, inputCol="_t", outputCol="_g").transform(df)
    df = df.withColumn("_g", F.concat("_t", "_g"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_g", outputCol="_v").transform(df).drop("_g")


def background(docs: DataFrame, text_col: str = "text", most: int = BACKGROUND) -> list[str]:
    """At most about ``most`` ordinary paragraphs of the corpus, one per chosen document."""
    rows = docs.count()
    pick = F.xxhash64(text_col)
    chosen = docs.filter(F.pmod(pick, F.lit(1_000_003)) < F.lit(min(1.0, most / max(1, rows))) * 1_000_003)
    parts = F.filter(F.split(text_col, "\n", -1), lambda x: ~x.rlike(_HINT) & x.rlike(r"[\p{L}\p{N}]"))
    one = chosen.select(parts.alias("p"), pick.alias("h")).filter(F.size("p") > 0).select(F.get("p", F.pmod(F.col("h"), F.size("p")).cast("int")).alias("x"))
    # `most` bounds the rows; a paragraph beyond 2,000 characters adds nothing as background
    return sorted(r["x"] for r in one.select(F.substring("x", 1, 2000).alias("x")).distinct().collect())


def training_rows(ordinary: list[str], variants: int = VARIANTS, seed: int = 11) -> list[tuple[str, int, bool]]:
    """(paragraph, class, held out) from the templates and ordinary paragraphs."""
    rnd = random.Random(seed)
    rows = [(p, 0, rnd.random() < 0.3) for p in ordinary] or [("", 0, False), ("", 0, True)]
    some = lambda: " ".join(rnd.choice(ordinary).split()[: rnd.randint(0, 30)]) if ordinary else ""
    for family, texts in TEMPLATES.items():
        k = FAMILIES.index(family)
        for text in (*texts, *TITLES.get(family, ())):
            words = text.split()
            for i in range(variants):
                kept = [w for w in words if i % 3 == 0 or rnd.random() > 0.08]
                body = " ".join(kept)
                rows.append((f"{some()} {body} {some()}" if i % 2 else body, k, rnd.random() < 0.3))
    return rows


class LicenseModel:
    def __init__(self, families, calibration):
        self.families, self.calibration = families, calibration

    def _raw(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_r``: the log-odds of every family."""
        return self.families.transform(_vectors(df)).withColumn("_r", vector_to_array("rawPrediction")).drop("rawPrediction", "probability", "prediction", "_v")

    def _margin(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_m``: the best family's log-odds against unknown."""
        known = F.slice("_r", 2, len(FAMILIES) - 1)
        return self._raw(df).withColumn("_m", F.array_max(known) - F.get("_r", F.lit(0))).drop("_r")

    def classify(self, candidates: DataFrame) -> DataFrame:
        """``candidates`` (words ``_t``, family number ``_k``) that the model takes for their family: plus probability."""
        a, b = self.calibration
        scored = self._raw(candidates)
        margin = F.get("_r", F.col("_k")) - F.get("_r", F.lit(0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin * a + b)))
        return scored.withColumn("probability", p).drop("_r").filter(F.col("probability") >= ACCEPT)


def fit(docs: DataFrame, text_col: str = "text", most: int = BACKGROUND) -> LicenseModel:
    spark = docs.sparkSession
    rows = training_rows(background(docs, text_col, most))
    train = spark.createDataFrame(rows, "p string, _y int, held boolean").coalesce(2).withColumn("_t", tokens(F.col("p"))).withColumn("_y", F.col("_y").cast("double"))
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", maxIter=60, regParam=0.002)
    families = lr.fit(_vectors(train.filter("NOT held")))
    model = LicenseModel(families, (1.0, 0.0))
    held = model._margin(train.filter("held")).select(array_to_vector(F.array("_m")).alias("_x"), (F.col("_y") > 0).cast("double").alias("_known"))
    fitted = LogisticRegression(featuresCol="_x", labelCol="_known", maxIter=50, regParam=0.001).fit(held)
    return LicenseModel(families, (float(fitted.coefficients[0]), float(fitted.intercept)))


def _words_of_lines(text: Column) -> Column:
    """Words of every line; in an SPDX expression every id is led by the same words."""
    spdx = r"(?i)\s(?:OR|AND)\s(?<=SPDX-License-Identifier:[^\n]{0,300})"
    led = F.when(F.lower(text).contains("spdx-license-identifier"), F.regexp_replace(text, spdx, " SPDX-License-Identifier ")).otherwise(text)
    return F.transform(F.split(led, "\n", -1), tokens)


def _hits(docs: DataFrame, rows: list[tuple], reach: int) -> DataFrame:
    """(``_id``, ``_tk``, place, pair, line, words in the line, the words from there on) of
    every two neighbouring words that a template holds. ``docs``: ``_id``, ``_text``."""
    maybe = docs.filter(F.lower("_text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(_anchors(rows)) + r")(?![\p{L}\p{N}])"))
    lines = maybe.select("_id", F.xxhash64("_text").alias("_tk"), _words_of_lines(F.col("_text")).alias("_l"))
    words = F.flatten(F.transform("_l", lambda x: F.when(F.size(x) == 0, F.array(F.lit(_BLANK))).otherwise(x)))
    where = F.flatten(F.transform("_l", lambda x, i: F.array_repeat(F.struct(i.alias("line"), F.size(x).alias("n")), F.greatest(F.size(x), F.lit(1)))))
    flat = lines.select("_id", "_tk", words.alias("_w"), where.alias("_at"))
    pair = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1))
    known = sorted({r[0] for r in rows})
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - 2, F.lit(0))), lambda i: pair(i).isin(known))
    entry = lambda i: F.struct(i.alias("i"), pair(i).alias("pair"), F.get("_at", i).alias("at"), F.slice("_w", i + 1, reach).alias("words"))
    hits = flat.select("_id", "_tk", F.explode(F.transform(at, entry)).alias("_h"))
    return hits.select("_id", "_tk", F.col("_h.i").alias("_i"), F.col("_h.pair").alias("_pair"), F.col("_h.at.line").alias("_line"), F.col("_h.at.n").alias("_n"), F.col("_h.words").alias("_w"))


def candidates(docs: DataFrame) -> DataFrame:
    """Confirmed places of ``docs`` (``_id``, ``_text``): ``_k`` family, ``_begin`` and ``_end``
    word, ``_line``, ``similarity`` and the words ``_t``."""
    rows = _template_rows()
    longest = max(r[2] for r in rows) + 2
    # words may be put in or left out: a fourth of the template's length, two at least
    slack = lambda n: F.greatest(F.lit(2), F.ceil(n / 4))
    known = docs.sparkSession.createDataFrame(rows, "_pair string, _template int, _place int, _k int, _pairs int, _key boolean, _keys int, _title int")
    hits = _hits(docs, rows, 2 * longest).join(F.broadcast(known), "_pair")
    start = F.floor((F.col("_i") - F.col("_place")) * 1000 / slack(F.col("_pairs"))).cast("long")
    near = Window.partitionBy("_id", "_tk", "_template").orderBy("_start").rangeBetween(0, 1000)
    own = F.size(F.collect_set("_pair").over(near))
    key = F.size(F.collect_set(F.when(F.col("_key"), F.col("_pair"))).over(near))
    seen = hits.withColumn("_start", start).select(
        "_id", "_tk", "_k", "_title", "_pairs", own.alias("_own"), (own / F.col("_pairs")).alias("similarity"), (key * 2 >= F.greatest(F.col("_keys"), F.lit(1))).alias("_sure"),
        F.min("_i").over(near).alias("_begin"), (F.max("_i").over(near) + 1).alias("_end"), F.min("_line").over(near).alias("_line"), F.max("_line").over(near).alias("_last"),
        F.max("_n").over(near).alias("_n"), F.min_by("_w", "_i").over(near).alias("_w"))
    alone = (F.col("similarity") == 1) & (F.col("_n") == F.col("_title")) & (F.col("_line") == F.col("_last"))
    seen = seen.filter((F.col("similarity") >= CONFIRM) & (F.col("_own") >= F.least(F.col("_pairs"), F.lit(3))) & F.col("_sure") & ((F.col("_title") == 0) | alone))
    return seen.withColumn("_t", F.array_remove(F.slice("_w", F.lit(1), F.col("_end") - F.col("_begin") + 1), _BLANK)).drop("_w", "_title", "_pairs", "_own", "_sure", "_n", "_last")


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with an array of (paragraph, family, probability, similarity), by position:
    ``paragraph`` is the line on which the notice begins."""
    found = model.classify(candidates(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))))
    # places of one family that overlap are one notice
    before = Window.partitionBy("_id", "_tk", "_k").orderBy("_begin", "_end")
    apart = F.coalesce(F.col("_begin") > F.max("_end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("_apart", apart.cast("int")).withColumn("_notice", F.sum("_apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    best = lambda df, *by: df.groupBy("_id", "_tk", "_k", *by).agg(*([] if "_line" in by else [F.min("_line").alias("_line")]), F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    found = best(best(found, "_notice"), "_line")
    names = F.array(*[F.lit(x) for x in FAMILIES])
    entry = F.struct(F.col("_line").alias("paragraph"), F.get(names, F.col("_k")).alias("family"), "probability", "similarity")
    lists = found.groupBy("_id", "_tk").agg(F.array_sort(F.collect_set(entry)).alias("_found"))
    left = docs.withColumn("_tk", F.xxhash64(text_col))
    both = left.join(lists, left[id_col].eqNullSafe(lists["_id"]) & (left["_tk"] == lists["_tk"]), "left")
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    return both.select(*[left[c] for c in docs.columns if c != out], F.coalesce("_found", empty).alias(out))


def query(docs: DataFrame) -> DataFrame:
    """op3: per document its lines with a letter or digit, those on which a notice begins, and the families found."""
    model = fit(docs)
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    # counted before the scan's join, which then moves no text
    narrow = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_paragraphs"))
    found = scan(narrow, model)
    families = F.array_sort(F.array_distinct(F.col("licenses.family")))
    return found.select("doc_id", "n_paragraphs", F.size(F.array_distinct("licenses.paragraph")).cast("long").alias("n_licensed"), F.array_join(families, ",").alias("families"),
                        F.array_max("licenses.probability").alias("probability"))
