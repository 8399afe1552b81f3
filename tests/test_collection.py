"""Keys with editions, what items carry, and backups that come back equal."""

import pytest
from pyspark.sql import functions as F

from recordlink.operators import catalogue, collection, exports, search

ROW = "card_id long, print_id string, pending_set string, pending_rarity string, condition string, edition string, language string, quantity long, source string, notes string, added_at string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def shape(df):
    return sorted(((r.edition, r.pending_set, r.quantity, r.source, r.notes) for r in df.collect()), key=repr)


def test_editions_are_items_of_their_own(spark):
    held = frame(spark, (1, "p", None, None, "NM", "Unlimited", "EN", 2, "scan", "", "a"), (1, "p", None, None, "NM", "1st Edition", "EN", 1, "manual", "mine", "b"))
    new = frame(spark, (1, "p", None, None, "NM", None, "EN", 3, "import", "filled", "c"), (1, "p", None, None, "NM", "1st Edition", "EN", 1, "import", "ignored", "c"))
    got = collection.add(held, new)
    assert shape(got) == [("1st Edition", None, 2, "manual", "mine"), ("Unlimited", None, 5, "scan", "filled")]
    left = collection.remove(got, frame(spark, (1, "p", None, None, "NM", "", "EN", 5, None, None, None)))
    assert [(r.edition, r.quantity) for r in left.collect()] == [("1st Edition", 2)]


def test_an_empty_pending_set_is_none(spark):
    rows = frame(spark, (1, None, "", "", "NM", "", "EN", 1, "scan", None, "a"), (1, None, None, None, "NM", None, "EN", 1, "scan", None, "a"), (1, None, "S1", "", "NM", None, "EN", 1, "scan", None, "a"))
    got = collection.add(rows.limit(0), rows)
    assert shape(got) == [("Unlimited", "S1", 1, "scan", None), ("Unlimited", None, 2, "scan", None)]


def test_resolving_keeps_editions_and_the_older_source(spark):
    rows = frame(spark, (1, "p1", None, None, "NM", None, "EN", 1, "manual", None, "b"), (1, None, "S1", None, "NM", None, "EN", 2, "scan", "n", "a"), (1, None, "S1", None, "NM", "1st Edition", "EN", 4, "scan", None, "a"))
    choice = spark.createDataFrame([(1, "S1", "p1")], "card_id long, pending_set string, chosen string")
    assert shape(collection.resolve_prints(rows, choice)) == [("1st Edition", None, 4, "scan", None), ("Unlimited", None, 3, "manual", "n")]


def test_a_backup_comes_back_equal(spark, tmp_path):
    rows = frame(spark, (1, "p1", None, None, "NM", "1st Edition", "EN", 3, "scan", "a, \"b\"\nc", "2024-01-01"), (1, None, "S9", "R", "NM", "Unlimited", "PT", 1, "manual", None, "2024-01-02"), (2, None, None, None, "LP", "Unlimited", "EN", 7, "import", None, None))
    card = spark.createDataFrame([(1, "One", "t", "a", 1), (2, "=Two", "t", "a", 1)], "card_id long, name string, type string, archetype string, level int")
    prints = spark.createDataFrame([("p1", "S9-EN001", "S9", "R")], "print_id string, set_code_full string, set_prefix string, rarity string")
    saved = exports.backup(collection.listing(rows, card, prints))
    back = catalogue.restored(rows.limit(0), saved).drop("action")
    assert sorted(map(repr, back.select(rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_frames_without_editions_still_work(spark):
    old = frame(spark, (1, "p", None, None, "NM", None, "EN", 2, None, None, None)).select("card_id", "print_id", "pending_set", "pending_rarity", "condition", "language", "quantity")
    got = collection.add(old, old).collect()
    assert [(r.edition, r.quantity, r.action) for r in got] == [("Unlimited", 4, "updated")]


@pytest.mark.parametrize("number", [1, 3, 17, 10**6])
def test_deep_pages(spark, monkeypatch, number):
    rows = spark.range(997).select(F.expr("CASE WHEN id % 11 <> 0 THEN id * 7919 % 101 END").alias("a"), "id")
    order = [F.col("a").desc_nulls_last(), F.col("id").asc_nulls_first()]
    near = search.page(rows, order, number, 60).collect()
    monkeypatch.setattr(search, "SHALLOW", 0)
    assert sorted(map(tuple, search.page(rows, order, number, 60).collect())) == sorted(map(tuple, near)) and len(near) in (60, 37)
    assert search.page(rows.limit(0), order, number, 60).collect() == []
