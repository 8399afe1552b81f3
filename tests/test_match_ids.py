"""The match looks names, codes and ids up by value; ids of readings that come again are joined as ids."""

import re

import pytest
from pyspark.sql import functions as F

from recordlink.functions import shared, text
from recordlink.operators import ladder, match
from recordlink.plans import catalog_of_queries

ROW = "reading_id string, raw_name string, raw_code string, raw_id string, truth long"
CARDS = [(10001, "Blue-Eyes White Dragon"), (10002, "Dark Magician"), (10003, "Pot of Greed"), (10004, "Red-Eyes Black Dragon"), (-5, "Mystical Space Typhoon")]
PRINTS = [(10001, "SDK-EN001", "SDK", "p1"), (10002, "SDY-EN006", "SDY", "p2"), (10002, "SDY-EN006", "SDY", "p3"), (10003, "LOB-E10", "LOB", "p4"), (10004, "LOB-E10", "LOB", "p5"), (10003, "x lower", "X", "p6")]
NAMES = ["Blue-Eyes White Dragon", "Dark Magicia", "PotofGreed", "P0t of Greed", "qqq", "", None, "Mystical Space Typhoon"]
CODES = ["SDK-EN001", " sdk-en001.", "SDK-ENOO1", "SDY-FR006", "SDY-EN006", "LOB-E10", "x lower", "ABC", "", None]
IDS = ["10001", " 10002.", "99999", "1", "", None, "-5", None]


def _by_ids(readings, card, alt, prints):
    """Everything joined by reading_id, as the results were before."""
    base = shared.written(readings.select("reading_id", text.normalize_strict(F.col("raw_name")).alias("typed"), "raw_code", "raw_id", "truth"), "base")
    found = ladder.candidates(base.select("typed"), match.name_variants(card, alt))
    lists = found.groupBy("typed").agg(F.sort_array(F.collect_list(F.struct("place", "card_id", "score", "language", "tier"))).alias("names"))
    j = base.join(lists, "typed", "left").join(match.code_resolution(base, prints), "reading_id", "left").join(match.resolve_ids(base, card), "reading_id", "left")
    return match.decided(j).select("reading_id", "card_id", "print_id", "name_score", "margin", "language", "tier", "confidence", "decision", "truth")


@pytest.mark.parametrize("again", [False, True])
def test_match_is_that_of_joins_by_id(spark, again):
    card = spark.createDataFrame(CARDS + [(10002, "Dark Magician")] * again, "card_id long, name string")
    alt = spark.createDataFrame([(10001, "PT", "Dragão Branco")], "card_id long, language string, name string")
    prints = spark.createDataFrame(PRINTS, "card_id long, set_code_full string, set_prefix string, print_id string").withColumn("rarity", F.lit("R"))
    rows = [(f"r{i}", NAMES[i % 8], CODES[i % 10], IDS[(i // 3) % 8], 10001 + i % 4) for i in range(80)]
    rows += [("r1", "Dark Magician", "SDK-EN001", "10003", 1), ("r2", None, None, None, 2), (None, "Pot of Greed", "SDK-EN001", "10001", 3), (None, "qqq", None, None, 4), rows[5]] if again else []
    r = spark.createDataFrame(rows, ROW)
    text_of = lambda df: sorted(map(str, df.collect()))
    out = match.match(r, card, alt, prints)
    assert text_of(out) == text_of(_by_ids(r, card, alt, prints))
    beside = match.match(r, card, alt, prints, beside=("raw_id",))
    assert text_of(beside) == text_of(out.join(r.select("reading_id", "raw_id"), "reading_id").select(*beside.columns))
    assert again or not re.search(r"reading_id#\d+ = ", out._jdf.queryExecution().optimizedPlan().toString())


def test_accuracy_reads_its_readings_once(spark, monkeypatch):
    """agg_accuracy: the ids come with the match, the readings are not made again to be joined."""
    seen, view = [], catalog_of_queries.view
    monkeypatch.setattr(catalog_of_queries, "view", lambda s, d, name, **more: (seen.append(name), view(s, d, name, **more))[1])
    got = catalog_of_queries.QUERIES["agg_accuracy"](spark, "/root/testdata/sf0.001").collect()
    assert seen.count("reading") == 1 and len(got) == 1
