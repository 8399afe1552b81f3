"""Steps that many queries share: what is looked up once, what does not multiply, and pages from the end."""

import pytest
from pyspark.sql import functions as F

from recordlink.functions import shared
from recordlink.operators import collection, exports, ladder, lookup, match, review, search
from recordlink.plans import catalog_of_queries, more_queries
from recordlink.plans import load_queries, review_queries, search_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
PRINTS = "card_id long, set_code_full string, set_prefix string, region string, number string, rarity string, print_id string"


def prints(spark, rows):
    return spark.createDataFrame(rows, PRINTS)


def test_a_code_is_parsed_once_however_often_it_was_read(spark):
    p = prints(spark, [(1, "LOB-EN001", "LOB", "EN", "001", "A", "a")])
    r = spark.range(100).select(F.col("id").alias("reading_id"), F.when(F.col("id") < 60, "LOB-EN001").when(F.col("id") < 90, "LOB-PTO01").when(F.col("id") < 95, "XYZ-EN001").alias("raw_code"))
    got = match.code_resolution(r, p)
    assert {(x.code, x.code_score, x.region, x.parsed): x.n for x in got.groupBy("code", "code_score", "region", "parsed").agg(F.count("*").alias("n")).collect()} == {
        ("LOB-EN001", 1.0, "EN", True): 60, (None, 0.5, "PT", True): 30, (None, 0.0, "EN", True): 5, (None, 0.0, None, False): 5,
    }
    written = [x for x in shared._made[spark.sparkContext.applicationId] if "/read-codes-" in x][-1]
    assert spark.read.parquet(written).count() == 3


def test_options_meet_only_codes_of_several_prints(spark):
    p = prints(spark, [(1, "S-EN1", "S", "EN", "1", "A", "a"), (1, "S-EN1", "S", "EN", "1", "B", "b"), (2, "S-EN1", "S", "EN", "1", "A", "c"), (3, "S-EN2", "S", "EN", "2", "A", "d")])
    r = spark.createDataFrame([(1, 1, "S-EN1"), (2, 2, "S-EN1"), (3, 9, "S-EN1"), (4, 3, "S-EN2")], "reading_id long, card_id long, code string")
    df = review.print_options(r, p)
    assert {x.reading_id: [tuple(o) for o in x.options] for x in df.collect()} == {1: [("a", "A"), ("b", "B")], 2: [("c", "A")], 3: []}
    assert "Aggregate [reading_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_print_lookup_asks_once_for_all_events(spark, monkeypatch):
    asked = []
    real = lookup.manual_prints
    monkeypatch.setattr(more_queries.lookup, "manual_prints", lambda a, p: (asked.append(a.count()), real(a, p))[1])
    rows = catalog_of_queries.QUERIES["mat_print_lookup"](spark, SF).count()
    codes = more_queries.view(spark, SF, "card_print").select("card_id", "set_code_full").distinct().count()
    assert asked == [2 * codes] and rows > 0


def test_a_print_that_cards_share_does_not_multiply_results(spark):
    p = prints(spark, [(i, f"S-EN{i}", "S", "EN", "1", "A", "x") for i in range(50)] + [(1, "S-PT1", "S", "PT", "1", r, f"p{r}") for r in "AB"])
    r = spark.createDataFrame([(1, 1, "x", "PT"), (2, 1, "x", "EN"), (3, 1, None, "PT"), (4, 7, "x", "PT")], "result_id long, card_id long, print_id string, language string")
    df = review.siblings(r, p)
    assert [tuple(x) for x in df.collect()] == [(1, "pA")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") >= 3  # the shared print and the siblings are made different before they meet the results


def test_apply_joins_no_table_of_results_with_itself(spark):
    plan = catalog_of_queries.QUERIES["ups_applied"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # for the language and for all; four times before


def test_each_region_of_a_shared_print_is_an_outcome_and_one_confirms(spark):
    p = prints(spark, [(1, "S-EN1", "S", "EN", "1", "A", "x"), (2, "S-PT1", "S", "PT", "1", "A", "x"), (3, "S-EN9", "S", "EN", "9", "Q", "y")])
    results = spark.createDataFrame([(1, "pending", False, None, 1, None), (2, "pending", True, None, 1, None), (3, "manual", False, "DE", 3, None)], "result_id long, decision string, applied boolean, language string, card_id long, print_id string")
    asked = spark.createDataFrame([(10, 1, 1, "x", None, None, 2, None), (11, 1, 1, "x", None, None, 2, None), (12, 2, 1, "x", None, None, 2, None), (13, 3, 3, None, "S-EN9", "q", 1, None), (14, 99, 1, "x", None, None, 1, "FR")], "ask_id long, result_id long, card_id long, print_id string, set_code string, rarity string, quantity int, language string")
    none = F.lit(None).cast("string")
    target = spark.range(0).select(F.col("id").alias("card_id"), *[none.alias(k) for k in collection.KEY[1:]], F.col("id").alias("quantity"))
    got = review.confirm(target, results, asked, p, spark.createDataFrame([], "card_id long, language string, print_id string"))
    assert sorted(tuple(x) for x in got["outcome"].select("ask_id", "outcome", "language").collect()) == [
        (10, "already_applied", "PT"), (10, "confirmed", "EN"), (11, "already_applied", "EN"), (11, "already_applied", "PT"), (12, "already_applied", "EN"), (12, "already_applied", "PT"), (13, "confirmed", "DE"), (14, "unknown", "FR"), (14, "unknown", "FR"),
    ]
    assert sorted((x.card_id, x.print_id, x.quantity) for x in got["collection"].collect()) == [(1, "x", 2), (3, "y", 1)]
    assert got["results"].filter("decision = 'confirmed'").count() == 2


@pytest.fixture
def shown(spark):
    rows = [(i, f"n{9 - i}", "p", i + 1, "Q" if i % 2 else None, None if i == 4 else "=S" if i == 3 else "S1") for i in range(6)]
    df = spark.createDataFrame(rows, "card_id long, name string, print_id string, quantity long, show_rarity string, set_prefix string")
    return df.withColumns({k: F.lit(None).cast("string") for k in ("pending_set", "pending_rarity")} | {k: F.lit("x") for k in ("condition", "edition", "language", "show_set")})


def test_set_names_come_after_the_order(spark, shown):
    sets = spark.createDataFrame([("S1", "one"), ("S1", "two"), ("S1", None), ("'=S", "no"), ("", "no")], "set_code string, set_name string")
    df = exports.partner_in_sets(shown, sets)
    want = exports.partner(exports.ordered(shown.join(sets.withColumnRenamed("set_code", "set_prefix"), "set_prefix", "left")))
    assert df.columns == want.columns and [x["Card Name"] for x in df.collect()] == [x["Card Name"] for x in want.collect()]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Sort [")  # the sort is below


def test_the_last_page_is_taken_from_the_end(spark, shown, monkeypatch):
    monkeypatch.setattr(search, "SHALLOW", 3)
    monkeypatch.setattr(search.shared, "written", lambda *a: pytest.fail("all rows were written"))
    page = search.page(shown, search.item_order("quantity"), 99, 4, search.item_order("quantity", backwards=True))
    assert sorted((x.quantity, x.place, x.page, x.pages) for x in page.collect()) == [(5, 5, 2, 2), (6, 6, 2, 2)]


@pytest.mark.parametrize("by", ["name", "quantity"])
@pytest.mark.parametrize("descending", [False, True])
def test_backwards_is_the_same_order(spark, shown, by, descending):
    ids = lambda b: [x.card_id for x in shown.orderBy(*search.item_order(by, descending, b)).collect()]
    assert ids(True) == ids(False)[::-1]


def test_sums_by_the_whole_key_come_after_the_shuffle(spark):
    plan = collection.summed(more_queries.view(spark, SF, "delta"))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange")  # no partial sums beside the scan


def test_bm25_counts_null_texts_and_ranks_as_the_plain_sum(spark, monkeypatch):
    calls = []
    real = ladder.text_search
    monkeypatch.setattr(catalog_of_queries.ladder, "text_search", lambda *a, **k: (calls.append(k), real(*a, **k))[1])
    assert catalog_of_queries.QUERIES["mat_bm25"](spark, SF).count() > 0 and calls
