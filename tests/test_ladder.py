"""The tiers of name matching compare numbers: the same results as by brute force, and no search or comparison twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlink.functions import shared, similarity, text
from recordlink.operators import ladder, match
from recordlink.sources import views
from tests.test_matching import lev

WORDS = "blue red ring rings dragon of the bolt silver knight".split()


def test_distances_of_many_pairs():
    r = random.Random(5)
    texts = sorted({"".join(r.choice("ab é𝔸\0") for _ in range(r.choice([0, 1, 3, 30, 63, 64, 65, 80, 300]))) for _ in range(60)})
    i, j = (np.array([r.randrange(len(texts)) for _ in range(400)]) for _ in range(2))
    assert similarity.Texts(texts).distances(i, j).tolist() == [lev(texts[a], texts[b]) for a, b in zip(i, j)]


def test_scores_and_counts_are_the_columns(spark):
    r = random.Random(7)
    names = sorted({" ".join(r.choices([*WORDS, "x" * 70, "99999999", ""], k=r.randrange(1, 7))) for _ in range(60)})
    i, j = (np.array([r.randrange(len(names)) for _ in range(200)]) for _ in range(2))
    rows = spark.createDataFrame([(n, names[a], names[b]) for n, (a, b) in enumerate(zip(i.tolist(), j.tolist()))], "n int, a string, b string").select("n", similarity.native(F.col("a"), F.col("b")).alias("s"), F.array(*text.counts_of_characters(F.col("a"))).alias("c")).orderBy("n").collect()
    known = similarity.Names(names)
    assert known.scores(i, j).tolist() == [x.s for x in rows]
    assert [[int(c[a]) for c in known.whole.counts(text.LANES)] for a in i] == [x.c for x in rows]


@pytest.fixture(scope="module")
def many(spark):
    """Names that cards share, cards of two English names, other languages' names, and texts that were read."""
    r = random.Random(4)
    names = [" ".join(r.choices(WORDS, k=3)) for _ in range(30)]
    cards = [(i, names[i % 30] if i < 270 else names[0]) for i in range(420)] + [(5, names[6]), (6, "lone " + "long " * 60)]
    alt = [(i, "PT", names[(i + 7) % 30]) for i in range(0, 420, 3)] + [(7, "DE", "ritter drache")]
    variants = shared.written(match.name_variants(spark.createDataFrame(cards, "card_id long, name string"), spark.createDataFrame(alt, "card_id long, language string, name string")), "variants")
    asked = sorted({n[:-1] for n in names} | {n + " zz" for n in names} | {n.replace(" ", "") for n in names} | {"dragon", "red ring", "ritter drach", "qq zz", "lone " + "long " * 59})
    return variants, shared.written(spark.createDataFrame([(x, x) for x in asked], "typed string, fuzzy string"), "asked"), names


def test_texts_of_the_same_words_are_searched_once(spark, many, monkeypatch):
    variants, typed, names = many
    searched, search = [], ladder.text_search
    monkeypatch.setattr(ladder, "text_search", lambda index, totals, asked, key, *more: (searched.append(asked.select(key).distinct().count()), search(index, totals, asked, key, *more))[1])
    ladder.shortlist(typed, variants).count()
    tokens = {t for v in variants.collect() for t in v.strict.split()}
    queries = set()
    for x in typed.collect():
        words = x.typed.split()
        known = frozenset((t, p) for i, t in enumerate(words) if (p := i == len(words) - 1 and len(t) >= 2, any(w.startswith(t) if p else w == t for w in tokens))[1])
        queries |= {known} if known else set()
    assert searched[0] == len(queries) < typed.count() / 1.5
    assert searched[1] < searched[0] / 2  # the others are full of English names


def test_candidates_are_those_of_brute_force(spark, many):
    """mat_ladder: the third and the fourth tier against every pair, without a comparison of texts by the column."""
    variants, typed, names = many
    pairs = variants.filter(F.length("fuzzy") >= 4).select("card_id", "language", "fuzzy").join(typed.select("typed", F.col("fuzzy").alias("asked")).filter(F.length("asked") >= 4))
    scored = shared.written(pairs.withColumn("score", similarity.native(F.col("asked"), F.col("fuzzy"))), "scored")
    lists = shared.written(ladder.shortlist(typed, variants), "lists")
    reranked = ladder.rerank(lists, typed, variants)
    whole = ladder.whole_catalogue(typed, variants)
    assert sorted(map(tuple, reranked.collect())) == sorted(map(tuple, ladder._best(scored.join(lists.select("typed", "card_id"), ["typed", "card_id"]), "typed", ladder.CUTOFF, ladder.TOP).collect()))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ladder._best(scored, "typed", ladder.CUTOFF, ladder.TOP).collect()))
    assert not any("levenshtein" in x._jdf.queryExecution().optimizedPlan().toString() for x in (reranked, whole))


def test_many_parts_and_blocks(spark, many, monkeypatch):
    variants, typed, names = many
    want = sorted(map(tuple, ladder.whole_catalogue(typed, variants).collect()))
    for name, value in (("PART_NAMES", (5, 9)), ("BLOCK_TEXTS", (7, 20)), ("PARTS", 3), ("BLOCKS", 4), ("FIRST", 2), ("BOUNDS", 50)):
        monkeypatch.setattr(ladder, name, value)
    assert sorted(map(tuple, ladder.whole_catalogue(typed, variants).collect())) == want and len(want) > 100


def test_names_read_are_those_of_the_readings(spark, tmp_path):
    """Also with nulls, names that come twice and parts of two names."""
    d = str(tmp_path)
    keys = [(o, ln, p, s) for o in (0, 1, 2, 3, 4, 5, 15, None, -1) for ln, p, s in ((1, 7, 3), (1, 7, 3), (2, 8, None), (None, 9, 1), (3, None, 1), (4, 10, 2), (5, 99, 2))]
    spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    parts = [(7, "old gold bolt", "SMALL", "Brand#1", 3), (7, "old gold bolt", "SMALL", "Brand#1", 3), (8, "red o", None, "Brand#1", 3), (8, "blue", "TIN", "B", 1), (9, None, None, None, None), (10, "old gold bolt", "SMALL", "Brand#1", 3), (None, "x", "y", "z", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    want = sorted(x.raw_name for x in views.view(spark, d, "reading").select("raw_name").distinct().collect())
    got = [x.raw_name for x in views.view(spark, d, "read_name").collect()]
    assert sorted(got) == want and len(got) > 8
