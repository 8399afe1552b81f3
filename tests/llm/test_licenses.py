"""License scans against planted lines."""

import pytest
from pyspark.sql import functions as F

from recordlink.llm import licenses

DOCS = "doc_id long, text string, para string, weight string"
CLEAN = [f"the river bends near house {i} and the old mill stands under tall trees" for i in range(300)]
NOTICES = {
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "GPL-2.0": "Released under the GNU General Public License version 2", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Distributed under the GNU Lesser General Public License version 3.", "AGPL-3.0": "released under AGPL version 3", "BSD-3-Clause": "Released under the BSD 3-Clause License.", "ISC": "SPDX-License-Identifier: ISC",
}
NONE = ["the license fee is due in spring", "Licensed under the Microsoft Public License", "Copyright 2020, all rights reserved.", "he had a driving license from the year before", "GNU General Public License version 7 is not written yet", "licensed under CC BY 2.5"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, "some words\nReleased under the MIT License.\nmore words"), (2, NOTICES["Apache-2.0"]), (2, NOTICES["Apache-2.0"]), (3, None), (4, ""), (5, "\n".join(CLEAN)), (6, "\n".join([*CLEAN, NOTICES["CC-BY-NC-4.0"]])), (7, "word " * 50_000 + NOTICES["MIT"]), (8, " \n ")]
    rows += [(100 + i, t) for i, t in enumerate(NOTICES.values())] + [(200 + i, t) for i, t in enumerate(NONE)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    return sorted((r["doc_id"], r["para"], r["family"]) for r in licenses.license_scan(docs).collect())


def test_planted_lines(found):
    """Families are found, clean, null, blank and empty texts are left alone, repeated rows give one row, a notice inside a very long line is found, and columns with clashing names do no harm."""
    assert [x for x in found if x[0] < 100 and x[0] != 7] == [(1, 1, "MIT"), (2, 0, "Apache-2.0"), (6, 300, "CC-BY-NC-4.0")]


def test_families_are_told_apart(found):
    assert [(x[0] - 100, x[2]) for x in found if 100 <= x[0] < 200] == list(enumerate(NOTICES))


def test_no_notice(found):
    assert [x for x in found if x[0] >= 200] == []


def test_no_line_with_a_score_above_the_cut_is_lost_by_the_bounds(spark):
    """The bound from the table is never below the exact lead of any family over the unknown class."""
    lines = [*NOTICES.values(), *NONE, *CLEAN[:20]]
    paras = licenses.paragraphs(spark.createDataFrame(enumerate(lines), "doc_id long, text string"), "doc_id", "text")
    weights, biases, table, least = licenses.train(spark, paras)
    w, b = {}, {r.family: r.bias for r in biases.collect()}
    for r in weights.collect():
        w.setdefault(r.gram, {})[r.family] = r.weight
    some = paras.select("line", licenses._grams(licenses._words(F.col("line"))).alias("g"), licenses.can_reach(F.col("line"), table, least).alias("can")).collect()
    for r in some:
        lead = {f: b[f] - b[licenses.UNKNOWN] + sum(w.get(g, {}).get(f, 0) - w.get(g, {}).get(licenses.UNKNOWN, 0) for g in r.g) for f in licenses.NAMES}
        assert max(lead.values()) <= sum(table[g % len(table)] for g in r.g) + max(b[f] - b[licenses.UNKNOWN] for f in licenses.NAMES) + 1e-3
        if max(lead.values()) > licenses._logit(max(x.cut for x in biases.collect())):
            assert r.can, r.line


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
