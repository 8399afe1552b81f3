"""Queries against their SQL, and the text functions against known cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from recordlink.functions import text
from recordlink.plans import catalog_of_queries as q
from recordlink.plans import load_queries, more_queries, review_queries, search_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert name in q.QUERIES
    rel = con.execute(q.SQL[name])
    want = rows([c[0] for c in rel.description], rel.fetchall())
    df = q.QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == want


def test_names(spark):
    df = spark.createDataFrame([("Élan — “Vital”",), ("B1ue-Eyes",), (None,), ("",)], "n string")
    got = df.select(text.normalize_strict(F.col("n")), text.normalize_fuzzy(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("elan - vital", "eian vitai"), ("b1ue-eyes", "biueeyes"), (None, None), ("", "")]


def test_codes(spark):
    cases = {"LOB-001": ("LOB", None, "001"), "mago-en001": ("MAGO", "EN", "001"), "MVP1-ENV04": ("MVP1", "EN", "V04"), "IOC-SE1": ("IOC", None, "SE1"), "Blue-Eyes": None, "SDK001": ("SDK", None, "001"), "": None}
    df = text.with_code(spark.createDataFrame([(k,) for k in cases] + [(None,)], "c string"), "c")
    got = {r.c: r for r in df.collect()}
    for k, want in cases.items():
        assert (tuple(got[k].code) if got[k].code else None) == want
    assert got["SDK001"].code_variants[0] == "SDK001" and got[None].code is None
    v = text.with_code(spark.createDataFrame([("LOB-O01",), ("L0B-001",)], "c string"), "c").collect()
    assert [r.code_variants[1] for r in v] == ["LOB-001", "LOB-001"]


def test_ids(spark):
    df = spark.createDataFrame([("89631139",), ("8963I139",), ("41739381 1Edicao",), ("123",), ("896311З9",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_id(F.col("t"))).collect()] == ["89631139", "89631139", "41739381", None, "896311", None]
