"""Views that Spark computes by a cheaper way have the rows of their SQL, also for nulls, copies and keys longer than the texts made of them."""

import datetime
import re
from collections import Counter

import pytest

from recordlink.sources import views


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    day = datetime.datetime(1995, 1, 1)
    keys = [(1, 1, 7, 3, "A"), (1, 1, 7, 3, "A"), (1, 1, 7, 3, "N"), (1, 1, 8, 2, "A"), (1, 2, 16, 12345, "R"), (2, 2, 16, 12347, "R"), (2, 3, 16, 12344, "R"), (3, 1, 1234567, 12340, "A"), (3, 2, 1234568, 12341, None), (3, 3, 1234568, 12342, None)]
    keys += [(4, 1, 8, None, "A"), (4, 2, 9, None, "N"), (4, 3, None, 3, "A"), (5, None, 7, 3, "A"), (5, 3, 7, None, "A"), (None, 1, 7, 3, "A"), (6, 1, 16, -1230, "A"), (6, 2, 16, -1231, "A"), (6, 3, 99, 5, "A"), (7, 2, 1234567, 3, "Z")]
    rows = [(o, ln, p, s, 5.0, f, "O", day) for o, ln, p, s, f in keys]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    parts = [(p, f"name {p % 5}", "SMALL TIN", "Brand#1", 3, 900.0) for p in (7, 7, 8, 9, 16, 1234567, 1234568)] + [(8, "other", "SMALL TIN", "Brand#1", 3, 900.0), (None, "none", "X", "B", 1, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", sorted(views.COMPACT))
def test_same_rows_as_the_sql(spark, odd, name):
    want = spark.sql(re.sub(r"#\d\]", "]", views.VIEWS[name]), **{t: spark.read.parquet(f"{odd}/{t}.parquet") for t in set(views.tables_of(name))})
    got = views.view(spark, odd, name)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["card_print", "print_all", "reading"])
def test_no_text_is_shuffled_to_make_rows_different(spark, odd, name):
    """The aggregate that removes copies groups by keys, not by texts built from them."""
    plan = views.view(spark, odd, name)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert made and not any(re.search(r"print_id#|raw_code#|set_code_full#", line.split("Aggregate [", 1)[1].split("]")[0]) for line in made[-1:])
