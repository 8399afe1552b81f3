"""Matching against brute force and known readings; streams that repeat a batch; boxes."""

import random

import pytest
from pyspark.sql import functions as F

from recordlink.functions import shared, similarity
from recordlink.operators import ladder, match, review, rules
from recordlink.streaming import ingest


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.7, 0.8, 0.9, 0.95])
def test_similarity_join_is_complete(spark, cutoff):
    r = random.Random(3)
    words = ["dragon", "blue", "eyes", "white", "of", "the", "magic", "ring", "abcd", "abxd"]
    left = {" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"abcd", "a", "ab", ""}
    right = {x if r.random() < 0.2 else "".join(c if r.random() > 0.06 else r.choice("abcxyz ") for c in x) for x in left} | {"abxd", "b"}
    frame = lambda names: spark.createDataFrame([(x, x) for x in sorted(names)], "id string, name string")
    got = {(p.l_id, p.r_id) for p in match.blocked_similarity(frame(left), frame(right), cutoff).collect()}
    want = {(a, b) for a in left for b in right if (1 - lev(a, b) / max(len(a), len(b)) if a or b else 1) >= cutoff - 1e-12 and (a or b)}
    assert want - got == set() and all((a, b) in want or not (a or b) for a, b in got)


CARDS = [(1, "Blue-Eyes White Dragon"), (2, "Dark Magician"), (3, "Pot of Greed"), (4, "Red-Eyes Black Dragon"), (5, "Dark Magician Girl"), (6, "Mystical Space Typhoon")]


@pytest.mark.parametrize("scorer", [similarity.native, similarity.weighted_column])
def test_corrupted_names_find_their_card(spark, scorer):
    reads = {"BLUE-EYES WH1TE DRAGON": 1, "B1ue-Eyes White Dragon": 1, "BLUE-EYES WHITE DRAGC": 1, "BLUEEYES WHITE DRAGON": 1, "BLUE-EYES WHITE DRAG0N": 1, "P0T OF GREED": 3, "Dark Magician": 2, "Dragão Branco": 1, "MystIcalSpaceTyphoon": 6}
    card = spark.createDataFrame(CARDS, "card_id long, name string")
    alt = spark.createDataFrame([(1, "PT", "Dragão Branco"), (2, "PT", "Mag")], "card_id long, language string, name string")
    prints = spark.createDataFrame([(1, "SDK-001", "SDK", "p1"), (2, "SDY-EN006", "SDY", "p2")], "card_id long, set_code_full string, set_prefix string, print_id string").withColumn("rarity", F.lit("R"))
    rows = [(str(i), n, None, None, t) for i, (n, t) in enumerate(reads.items())] + [("code", "zzzz qqqq", "SDK-OO1", None, 1), ("fallback", "Dark Magician", "SDY-FR006", None, 2), ("clash", "Pot of Greed", "SDK-001", None, 3), ("none", None, None, None, None)]
    r = spark.createDataFrame(rows, "reading_id string, raw_name string, raw_code string, raw_id string, truth long")
    got = {x.reading_id: x for x in match.match(r, card, alt, prints, scorer, lengths=scorer is similarity.native).collect()}
    assert [n for i, (n, t) in enumerate(reads.items()) if got[str(i)].card_id != t] == []
    assert (got["code"].card_id, got["code"].decision) == (1, "manual") and got["clash"].decision == "manual" and got["none"].decision == "unmatched"
    assert (got["fallback"].card_id, got["fallback"].print_id, got["fallback"].decision, got["fallback"].language) == (2, "p2", "auto", "FR")


def test_weighted_ratio():
    assert similarity.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert similarity.partial("this is a test", "this is a test!") == 1
    assert similarity.weighted("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(0.95)
    assert similarity.weighted("", "a") == 0 == similarity.weighted(None, "a") and similarity.weighted("abc", "abc") == 1
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity._common(a, b) == table[-1][-1]


def test_shortlist_prefers_english(spark):
    card = spark.createDataFrame(CARDS, "card_id long, name string")
    alt = spark.createDataFrame([(3, "PT", "Dragon Pot"), (2, "PT", "Mago Dragon"), (5, "PT", "Maga Negra"), (6, "PT", "Tufao Mistico")], "card_id long, language string, name string")
    typed = spark.createDataFrame([("dragon whit",)], "typed string")
    got = ladder.shortlist(typed, match.name_variants(card, alt)).orderBy("place").collect()
    assert [r.card_id for r in got] == [1, 4, 2, 3]


def test_a_repeated_batch_adds_nothing_and_loses_nothing(spark):
    out = shared.folder(spark, "stream")
    merge = ingest.merge_new("k", out)
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    for batch, xs in ((0, "ab"), (1, "bc"), (1, "bc"), (2, "cd")):
        merge(frame(xs), batch)
    assert sorted(r.k for r in spark.read.parquet(f"{out}/data/*").collect()) == list("abcd")
    out = shared.folder(spark, "stream")
    add = ingest.add_once(out)
    d = spark.createDataFrame([(1, "p", "s", "r", "c", "EN", 2)], "card_id long, print_id string, pending_set string, pending_rarity string, condition string, language string, quantity int")
    for batch in (0, 1, 1):
        add(d, batch)
    assert [r[0] for r in spark.read.parquet(f"{out}/data/*").groupBy().sum("quantity").collect()] == [4]


def test_boxes_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, i // 12, r.random(), r.random(), 0.1 + r.random() / 4, 0.1 + r.random() / 4) for i in range(120)]
    got = {}
    for x in rules.ordered_boxes(spark.createDataFrame(rows, "box_id long, image_id long, x double, y double, w double, h double")).orderBy("image_id", "position").collect():
        got.setdefault(x.image_id, []).append(x.box_id)

    def iou(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        both = max(w, 0) * max(h, 0)
        return both / (a[4] * a[5] + b[4] * b[5] - both)

    for image in range(10):
        mine = [b for b in rows if b[1] == image]
        kept = []
        for b in sorted(mine, key=lambda b: -b[4] * b[5]):
            if not any(iou(b, k) >= 0.6 for k in kept):
                kept.append(b)
        assert sorted(got[image]) == sorted(b[0] for b in kept)


def test_nothing_is_applied_twice(spark):
    r = spark.createDataFrame([(1, 1, 0, 5, "p", "S", "EN", "auto"), (2, 1, 0, 5, "p", "S", "EN", "auto"), (3, 2, 0, None, None, "S", None, "auto"), (4, 3, 1, 6, None, "S", "PT", "auto")], "result_id long, image_id long, crop long, card_id long, print_id string, set_code string, language string, decision string")
    none = spark.createDataFrame([], "image_id long, crop long, item_id long")
    prints = spark.createDataFrame([], "card_id long, print_id string, set_prefix string, number string, region string, rarity string")
    over = spark.createDataFrame([(6, "PT", "chosen")], "card_id long, language string, print_id string")
    target = spark.createDataFrame([], "card_id long, print_id string, pending_set string, pending_rarity string, condition string, language string, quantity long")
    items, after = review.apply_auto(target, r, none, none.select("item_id"), prints, over)
    assert sorted((x.card_id, x.print_id, x.quantity) for x in items.collect()) == [(5, "p", 1), (6, "chosen", 1)]
    assert sorted((x.result_id, x.applied) for x in after.collect()) == [(1, True), (2, False), (3, False), (4, True)]
    again = after.filter("applied").selectExpr("image_id", "crop", "result_id as item_id")
    items, _ = review.apply_auto(items.drop("action"), r, again, again.select("item_id"), prints, over)
    assert sum(x.quantity for x in items.collect()) == 2


def test_forget_removes_what_was_written(spark):
    kept, shared._made[spark.sparkContext.applicationId] = shared._made.get(spark.sparkContext.applicationId, []), []
    df = shared.written(spark.range(3), "some")
    assert df.count() == 3
    path = shared._made[spark.sparkContext.applicationId][0]
    shared.forget(spark)
    shared._made[spark.sparkContext.applicationId] = kept
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()


def test_bounds_of_distances(spark):
    """The counts of characters never say more than the distance, and the banded distance is the distance where it counts."""
    from recordlink.functions import text

    r = random.Random(6)
    pairs = [tuple("".join(r.choice("aaab cd019-é") for _ in range(r.randrange(25))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    low = text.least_distance(text.counts_of_characters(a), text.counts_of_characters(b), F.length("a"), F.length("b"))
    rows = df.select("a", "b", low.alias("low"), text.edit_similarity(a, b).alias("whole"), text.edit_similarity_from(a, b, F.lit(0.6)).alias("near"), similarity.native(a, b).alias("native"), similarity.native_from(a, b, text.token_sort(a), text.token_sort(b), F.lit(0.6)).alias("native_near")).collect()
    for x in rows:
        assert x.low <= lev(x.a, x.b)
        assert x.near == (pytest.approx(x.whole) if x.whole >= 0.6 else 0.0)
        assert x.native_near == pytest.approx(x.native) if x.native >= 0.6 else x.native_near < 0.6


def test_full_text_is_the_scan_of_all_terms(spark, monkeypatch):
    """Also in many shards and blocks, with words that nearly all names have, and with ties."""
    import math

    monkeypatch.setattr(ladder, "SHARD_DOCS", 40)
    monkeypatch.setattr(ladder, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ladder, "FEW_POSTINGS", 0)
    r = random.Random(9)
    words = ["brand"] * 8 + ["blue", "red", "ring", "rings", "dragon", "of", "a1", "a12"]
    names = sorted({(i, " ".join(["brand", *r.choices(words, k=r.randrange(1, 6))])) for i in range(150)})
    asked = sorted({" ".join(r.choices(words + ["a", "ri", "zzz"], k=r.randrange(1, 5))) for _ in range(40)})
    index = shared.written(ladder.name_index(spark.createDataFrame(names, "doc long, strict string"), ["doc"]), "index")
    ph = shared.written(ladder.phrases(spark.createDataFrame([(x,) for x in asked], "q string"), "q", "q"), "phrases")
    docs = {i: n.split() for i, n in names}
    average = sum(map(len, docs.values())) / len(docs)
    for k in (3, 10_000):
        got: dict = {}
        for x in ladder.text_search(index, ladder.totals(index, ["doc"]), ph, "q", "doc", k).orderBy("q", "rank").collect():
            got.setdefault(x.q, []).append((x.doc, round(x.score, 7)))
        for q in asked:
            terms = {(t, i == len(q.split()) - 1 and len(t) >= 2) for i, t in enumerate(q.split())}
            score: dict = {}
            for t, prefix in terms:
                tf = {i: n for i, ws in docs.items() if (n := sum(w.startswith(t) if prefix else w == t for w in ws))}
                idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
                for i, n in tf.items():
                    score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / average))
            want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
            assert got.get(q, []) == [(i, round(s, 7)) for i, s in want], q


def test_copies_of_names_are_compared_once(spark, monkeypatch):
    """Cards that share a name: the index and the comparisons have each name once, and the results are those of all cards."""
    r = random.Random(4)
    words = "blue red ring rings dragon of the bolt silver knight".split()
    names = [" ".join(r.choices(words, k=3)) for _ in range(30)]
    cards = [(i, names[i % 30] if i < 270 else names[0]) for i in range(420)]
    card = spark.createDataFrame(cards, "card_id long, name string")
    alt = spark.createDataFrame([(i, "PT", names[(i + 7) % 30]) for i in range(0, 420, 3)], "card_id long, language string, name string")
    variants = shared.written(match.name_variants(card, alt), "copies")
    asked = sorted({n[:-1] for n in names} | {n.replace(" ", "") for n in names} | {"dragon", "red ring"})
    typed = shared.written(spark.createDataFrame([(x, x) for x in asked], "typed string, fuzzy string"), "asked")
    searched, search = [], ladder.text_search

    def seen(index, *more):
        searched.append((index.select("doc").distinct().count(), index.agg({"copies": "max"}).first()[0]))
        return search(index, *more)

    monkeypatch.setattr(ladder, "text_search", seen)
    got = sorted(map(tuple, ladder.shortlist(typed, variants).collect()))
    english, other = len({n for _, n in cards}), len({names[(i + 7) % 30] for i in range(0, 420, 3)})
    assert [n for n, _ in searched] == [english, other] and searched[0][1] > 100
    lists, ph = [], shared.written(ladder.phrases(typed, "typed", "typed"), "phrases")
    for condition in ("language = 'EN'", "language <> 'EN'"):
        index = shared.written(ladder.name_index(variants.filter(condition), ["card_id", "language"]).withColumn("doc", F.struct("card_id", "language")), "all-cards")
        lists.append(search(index, ladder.totals(index, ["doc"]), ph, "typed", "doc", ladder.SHORTLIST).select("typed", "doc.card_id", "rank"))
    assert got == sorted(map(tuple, ladder.fused(lists, "typed", "card_id", ladder.SHORTLIST).collect()))

    compared, deal = [], ladder.dealt
    monkeypatch.setattr(ladder, "dealt", lambda rows: (compared.append(rows.count()), deal(rows))[1])
    got = sorted(map(tuple, ladder.whole_catalogue(typed, variants).collect()))
    assert compared[-1] <= len(asked) * len({v.fuzzy for v in variants.collect()})
    pairs = variants.filter(F.length("fuzzy") >= 4).select("card_id", "language", "fuzzy").crossJoin(typed.select("typed", F.col("fuzzy").alias("asked")).filter(F.length("asked") >= 4))
    assert got == sorted(map(tuple, ladder._best(pairs.withColumn("score", similarity.native(F.col("asked"), F.col("fuzzy"))), "typed", ladder.CUTOFF, ladder.TOP).collect())) and len(got) > 100


def test_a_contour_of_exactly_the_share_counts(spark):
    """0.75 of a box as (0.75 * w) * h can be a bit less than 0.75 * (w * h)."""
    r = random.Random(1)
    sizes = [(h * 0.69, h) for h in (r.uniform(0.3, 0.7) for _ in range(300))]
    assert any(0.75 * w * h < 0.75 * (w * h) for w, h in sizes)
    df = spark.createDataFrame([(i, w, h, 0.75 * w * h) for i, (w, h) in enumerate(sizes)], "box_id long, w double, h double, filled double")
    assert rules.candidate_boxes(df).count() == 300


@pytest.mark.parametrize("name", ["mat_similar", "mat_exact"])
def test_each_name_is_normalised_once(spark, monkeypatch, name):
    """What is normalised is a written table of the different names."""
    from recordlink.plans import catalog_of_queries as q

    sizes, written = {}, shared.written
    monkeypatch.setattr(shared, "written", lambda df, what: (t := written(df, what), sizes.setdefault(what, (t.count(), t.distinct().count())))[0])
    q.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    n, different = sizes["different-raw-name"]
    assert n == different < q.view(spark, "/root/testdata/sf0.001", "reading").count()
