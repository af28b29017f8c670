"""Licence scan: notices in test documents, variants, and near misses."""

import pytest

from prefloom.llm import licenses

SF = "/root/testdata/sf0.01"
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "All rights reserved.": "proprietary",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: ",".join(sorted({NOTICES[x] for x in r["text"].split("\n") if x in NOTICES})) for r in docs.collect()}
    got = licenses.query(docs).collect()
    wrong = [r["doc_id"] for r in got if r["families"] != want[r["doc_id"]]]
    assert len(got) == len(want) and len(wrong) <= 0.005 * len(got)
    assert sum(bool(x) for x in want.values()) > 20


def families(model, docs, rows):
    return {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in licenses.scan(docs(rows), model).collect()}


def test_variants_and_near_misses(model, docs):
    rows = [
        (1, "some words before. Licensed under the Apache License, Version 2.0."),
        (2, "LICENSED UNDER THE APACHE LICENSE VERSION 2.0"),
        (3, "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files."),
        (4, "The driver needs a licence, and the public was free to use the general road."),
        (5, "Licensed under the Great Pumpkin Agreement of 1966."),
        (6, "plain text\nReleased under the MIT License.\nAll rights reserved."),
    ]
    got = families(model, docs, rows)
    assert got[1] == got[2] == ["apache-2.0"] and got[3] == ["mit"] and got[4] == got[5] == [] and got[6] == ["mit", "proprietary"]


def test_rows(model, docs):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n ..."), (4, notice), (4, notice), (None, notice), (5, "word " * 100_000 + "\n" + notice), (4, "another text")]
    d = docs(rows).withColumnRenamed("lang", "family").withColumnRenamed("source", "probability")
    out = licenses.scan(d, model)
    assert out.columns == [*d.columns, "licenses"]
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:20], [(x["paragraph"], x["family"]) for x in r["licenses"]]) for r in out.collect())
    assert got == sorted([("1", "", []), ("2", "", []), ("3", "\n\n ...", []), *[("4", notice[:20], [(0, "mit")])] * 2, ("None", notice[:20], [(0, "mit")]),
                          ("5", "word word word word ", [(1, "mit")]), ("4", "another text", [])])


def test_no_python_in_the_plan(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark, docs):
    assert licenses.query(docs([])).collect() == []


BSD = """Copyright (c) 2001, Somebody. No other words.

# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software.
"""


def test_wrapped_dual_and_long(model, docs):
    prose = "the river went on past the old mill and nobody knew where the road would end "
    rows = [
        (1, BSD), (2, MIT), (3, "MIT License\n\nsome other words"),
        (4, "SPDX-License-Identifier: (MIT OR Apache-2.0)"), (5, "// SPDX-License-Identifier: BSD-3-Clause"),
        (6, "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
        (7, prose * 300 + "Released under the MIT License. " + prose * 300 + "Licensed under CC BY-SA 4.0. " + prose * 50),
        (8, "This library is free software; you can redistribute it\nand/or modify it under the terms of the GNU Lesser\nGeneral Public License as published by the Free Software\nFoundation."),
        (9, "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0\nInternational License."),
        (10, "Released under the\nMIT License.\nReleased under the MIT License."),
        (11, "Licensed under CC BY-NC-ND 4.0."), (12, "We met at the MIT license office and talked about the redistribution of land in general."),
        (13, "All rights\n\nreserved seats were sold."), (14, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
        (15, "SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause"),
    ]
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licenses"]] for r in licenses.scan(docs(rows), model).collect()}
    assert got[1] == [(2, "bsd")] and {x for _, x in got[2]} == {"mit"} and got[2][0] == (0, "mit") and got[3] == [(0, "mit")]
    assert got[4] == got[6] == [(0, "apache-2.0"), (0, "mit")] and got[5] == [(0, "bsd")] and got[15] == [(0, "apache-2.0"), (0, "bsd"), (0, "mit")]
    assert got[7] == [(0, "cc-by-sa"), (0, "mit")] and [x for _, x in got[8]] == ["lgpl"] and got[9] == [(0, "cc-by-nc-sa")]
    assert got[10] == [(0, "mit"), (2, "mit")] and got[11] == [(0, "cc-by-nc-nd")] and got[12] == got[13] == [] and got[14] == [(0, "gpl")]


def test_every_template_is_found(model, docs):
    texts = [(f, x) for table in (licenses.TEMPLATES, licenses.TITLES) for f in table for x in table[f]]
    got = families(model, docs, [(i, x) for i, (_, x) in enumerate(texts)])
    assert [texts[i] for i in got if texts[i][0] not in got[i]] == []
