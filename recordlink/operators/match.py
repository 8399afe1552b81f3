"""Resolution of readings to catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import decide, shared, similarity, text
from recordlink.operators import ladder, lookup


def name_variants(card: DataFrame, alt: DataFrame) -> DataFrame:
    """(card_id, language, strict, fuzzy): all names under which a card is found; alternative names need four characters."""
    rows = card.select("card_id", F.lit("EN").alias("language"), "name").unionByName(alt.select("card_id", "language", "name"))
    forms = shared.different(rows, "name").select(F.col("name").alias("raw"), text.normalize_strict(F.col("name")).alias("strict"))
    forms = shared.written(forms.withColumn("fuzzy", text.normalize_fuzzy(F.col("strict"))), "normal-names")  # each name is normalised once, however many cards share it
    rows = rows.join(shared.small(forms), F.col("name") == F.col("raw"), "left").select("card_id", "language", "name", "strict", "fuzzy")
    return rows.filter((F.col("language") == "EN") | (F.length("strict") >= 4))


def exact_names(readings: DataFrame, variants: DataFrame) -> DataFrame:
    """(reading_id, name_card, name_language): equal strict forms of at least four characters; English first, then the smallest card_id."""
    names = shared.different(readings, "raw_name").select(F.col("raw_name").alias("raw"), text.normalize_strict(F.col("raw_name")).alias("strict"))
    names = shared.written(names, "strict-names").filter(F.length("strict") >= 4)  # each name is normalised once, however often it was read
    # one record per name before the join: a name that many cards share stays one row for each reading
    best = variants.groupBy("strict").agg(F.min(F.struct((F.col("language") != "EN").cast("int").alias("other"), "card_id", "language")).alias("m"))
    found = names.join(best, "strict").select("raw", F.col("m.card_id").alias("name_card"), F.col("m.language").alias("name_language"))
    found = shared.small(shared.written(found, "found-names"))
    return readings.select("reading_id", "raw_name").join(found, F.col("raw_name") == F.col("raw")).select("reading_id", "name_card", "name_language")


def code_catalogue(prints: DataFrame) -> DataFrame:
    """(code, code_card, code_print, n_cards, n_prints): card and print where the code names exactly one, else null."""
    card = F.col("card_id")
    g = prints.groupBy(F.col("set_code_full").alias("code")).agg(F.countDistinct(card).alias("n_cards"), F.count("*").alias("n_prints"), F.min(card).alias("c"), F.max(card).alias("last"), F.min("print_id").alias("p"))
    return g.select("code", F.when(F.col("c") == F.col("last"), F.col("c")).alias("code_card"), F.when(F.col("n_prints") == 1, F.col("p")).alias("code_print"), "n_cards", "n_prints")


def _region_of_hit() -> Column:
    return F.nullif(F.regexp_extract("code", f"-({'|'.join(text.REGIONS_TWO)}|[{''.join(text.REGIONS_ONE)}](?=[0-9]+$))", 1), F.lit(""))


def code_meanings(codes: DataFrame, prints: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """One row per different raw_code of ``codes`` (nulls left out): code, position, code_card, code_print, n_cards, n_prints (null without a hit), region, parsed, prefix_known and code_score (1 hit, 0.5 known prefix, 0).

    The first variant of the read code that the catalogue has wins. Without one, a code of another region is tried as an English one. A region of two letters or none is taken as read;
    one of a single letter only with a hit. Each code is parsed once, however often it was read, and of its variants only those whose beginning the catalogue has travel.
    """
    r = text.with_code(codes.select("raw_code").filter("raw_code is not null").distinct(), "raw_code")
    r = shared.written(r.select("raw_code", "code.prefix", "code.region", "code.number", "code_variants"), "read-codes")
    english = F.when(F.col("region") != "EN", F.concat("prefix", F.lit("-EN"), "number"))
    tried = F.concat("code_variants", F.array_compact(F.array(english)))
    rows = r.select("raw_code", F.posexplode_outer(tried).alias("position", "code"))  # outer: an inferred filter would be pushed down and run the expressions again
    head = lambda c: F.substring_index(c, "-", 1)
    begins = shared.written(prints.select(head("set_code_full").alias("head"), "set_prefix").distinct(), "code-beginnings")  # some thousands
    heads = shared.small(begins.select("head").distinct())
    rows = rows.join(heads, head("code") == F.col("head"), "left_semi")
    catalogue = code_catalogue(prints) if catalogue is None else catalogue
    cols = ["position", *catalogue.columns]
    hits = rows.join(catalogue, "code")
    best = hits.groupBy("raw_code").agg(F.min(F.struct(*cols)).alias("m")).select("raw_code", "m.*")
    known = shared.small(begins.select(F.col("set_prefix").alias("k_prefix")).distinct())
    j = r.select("raw_code", "prefix", F.col("region").alias("read_region"), F.size("code_variants").alias("own")).join(known, F.col("prefix") == F.col("k_prefix"), "left").join(best, "raw_code", "left")
    # with a hit of its own the region is the hit's; a hit of the English code keeps the region that was read
    region = F.when(F.col("position") < F.col("own"), _region_of_hit()).when(F.length("read_region") >= 2, F.col("read_region"))
    score = F.when(F.col("code").isNotNull(), 1.0).when(F.col("k_prefix").isNotNull(), 0.5).otherwise(0.0)
    return j.select("raw_code", *cols, region.alias("region"), F.col("prefix").isNotNull().alias("parsed"), F.col("k_prefix").isNotNull().alias("prefix_known"), score.alias("code_score"))


def code_resolution(readings: DataFrame, prints: DataFrame) -> DataFrame:
    """One row per reading (reading_id, raw_code) with the columns of ``code_meanings``; a reading without a code has no hit and the score 0."""
    j = readings.select("reading_id", "raw_code").join(code_meanings(readings, prints), "raw_code", "left").drop("raw_code")
    return j.withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "prefix_known": F.coalesce("prefix_known", F.lit(False)), "code_score": F.coalesce("code_score", F.lit(0.0))})


def resolve_codes(readings: DataFrame, prints: DataFrame) -> DataFrame:
    """(reading_id, position, code, code_card, code_print, n_cards, n_prints) of the readings whose code the catalogue has."""
    found = code_meanings(readings, prints).filter("code is not null").select("raw_code", "position", "code", "code_card", "code_print", "n_cards", "n_prints")
    return readings.select("reading_id", "raw_code").join(found, "raw_code").drop("raw_code")


def resolve_ids(readings: DataFrame, card: DataFrame) -> DataFrame:
    """(reading_id, id_card): the cleaned numeric id is a card's."""
    ids = readings.select("reading_id", F.expr("1").alias("one"), text.clean_id(F.col("raw_id")).alias("t")).select("reading_id", F.expr("try_cast(t AS bigint)").alias("card_id"))
    return ids.filter("card_id is not null").join(card.select("card_id"), "card_id").select("reading_id", F.col("card_id").alias("id_card"))


def with_code_cards(readings: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``readings`` written, and the same with code, code_card, code_print, region and code_score as in ``code_resolution``, without a join by ids.

    A code that the catalogue has as it was read is its own first variant; only the others are parsed and looked up by variants.
    """
    cols = ["code", "code_card", "code_print"]
    catalogue = shared.written(code_catalogue(prints).select(*cols), "code-catalogue")
    j = readings.withColumn("_clean", text.code_clean(F.col("raw_code")))
    j = shared.written(j.join(catalogue, (F.col("_clean") == F.col("code")) & (F.col("code") != ""), "left").drop("_clean"), "readings")
    missed = F.col("code").isNull() & F.col("raw_code").isNotNull()
    hits = j.filter(~missed).withColumns({"region": _region_of_hit(), "code_score": F.when(F.col("code").isNotNull(), 1.0).otherwise(0.0)})
    found = shared.written(code_meanings(j.filter(missed), prints, catalogue).select("raw_code", *cols, "region", "code_score"), "code-meanings")
    return j.select(*readings.columns), hits.unionByName(j.filter(missed).drop(*cols).join(found, "raw_code", "left"))


def match(readings: DataFrame, card: DataFrame, alt: DataFrame, prints: DataFrame, scorer=similarity.native, lengths: bool = True, beside: tuple[str, ...] = ()) -> DataFrame:
    """One row per reading: card, print, name score, margin, language, tier, confidence and decision from name, code and id together.

    The name runs through the tiers of ``ladder``; its best candidate is reconciled with the code's card, and the margin is measured after promotion. A valid id fixes the card unless the code, or the
    name where no code confirms, says another one; then a person decides. A code without any name candidate always goes to a person. Names, codes and ids are looked up by value;
    only readings whose reading_id is null or comes again are joined by it. ``beside``: columns of the readings that are joined to the result by reading_id.
    """
    more = [c for c in ("truth",) if c in readings.columns]
    shown = ["reading_id", "card_id", "print_id", "name_score", "margin", "language", "tier", "confidence", "decision", *more]
    base, coded = with_code_cards(readings.select("reading_id", "raw_name", "raw_code", "raw_id", *more), prints)
    names = shared.different(base, "raw_name").select(F.col("raw_name").alias("raw"), text.normalize_strict(F.col("raw_name")).alias("typed"))
    names = shared.written(names, "names-read")  # each name is normalised once, however often it was read
    found = ladder.candidates(names.select("typed"), name_variants(card, alt), scorer, lengths=lengths)
    lists = found.groupBy("typed").agg(F.sort_array(F.collect_list(F.struct("place", "card_id", "score", "language", "tier"))).alias("names"))  # at most ladder.TOP
    lists = shared.written(names.join(lists, "typed"), "name-candidates")

    number = F.xxhash64("reading_id").alias("number")
    again = shared.written(base.select(number).groupBy("number").agg(F.count("*").alias("n")).filter("n > 1").select("number"), "numbers-again")
    again = shared.small(again)
    alone = coded.filter("reading_id is not null").withColumn("number", number).join(again, "number", "left_anti")
    read = F.expr("try_cast(_id AS bigint)")
    # parsed ids are not negative: readings without one get keys that no card has, dealt over many tasks
    alone = alone.withColumn("_id", text.clean_id(F.col("raw_id"))).withColumn("_id", F.coalesce(read, -1 - F.pmod("number", F.lit(1_000_000))))
    cards = shared.small(card.select(F.col("card_id").alias("id_card")).filter("id_card >= 0"), 1_000_000)
    j = alone.join(cards, F.col("_id") == F.col("id_card"), "left").join(shared.small(lists.select("raw", "names")), F.col("raw_name") == F.col("raw"), "left")
    out = decided(j).select(*shown, *beside)

    odd = base.filter("reading_id is not null").withColumn("number", number).join(again, "number", "left_semi").drop("number").unionByName(base.filter("reading_id is null"))
    odd = shared.written(odd, "readings-again")
    if not odd.limit(1).count():
        return out
    j = odd.join(lists.select("raw", "names"), F.col("raw_name") == F.col("raw"), "left").drop("raw_code", "raw_id")
    j = decided(j.join(code_resolution(odd, prints), "reading_id", "left").join(resolve_ids(odd, card), "reading_id", "left")).select(*shown)
    return out.unionByName(j.join(odd.select("reading_id", *beside), "reading_id") if beside else j)


def decided(j: DataFrame) -> DataFrame:
    """Target, scores and route from columns names (candidates in order), code, code_card, code_print, code_score, region and id_card."""
    first, second = F.get("names", F.lit(0)), F.get("names", F.lit(1))
    own = F.get(F.filter("names", lambda x: x["card_id"] == F.col("code_card")), F.lit(0))
    j = j.withColumns({"_f": first, "_s": second["score"], "_o": own["score"]})
    top = F.col("_f.score")
    promoted = F.coalesce((F.col("code_card") != F.col("_f.card_id")) & (top - F.col("_o") <= lookup.PROMOTE_GAP + 1e-9), F.lit(False))
    j = j.withColumn("_p", promoted)
    j = j.withColumns({
        "by_name": F.when(F.col("_p"), F.col("code_card")).otherwise(F.col("_f.card_id")), "_score": F.when(F.col("_p"), F.col("_o")).otherwise(top),
        "margin": F.when(F.col("_f").isNotNull(), F.round(F.coalesce(F.when(F.col("_p"), F.col("_o") - top).otherwise(top - F.col("_s")), F.lit(1.0)), 9)),
        "agreement": F.when(F.col("code_card").isNotNull() & F.col("_f").isNotNull(), F.col("_p") | (F.col("code_card") == F.col("_f.card_id"))),
    })
    by_id, by_code, by_name = F.col("id_card"), F.col("code_card"), F.col("by_name")
    conflict = F.coalesce(by_code != by_id, F.lit(False)) | (F.coalesce(by_name != by_id, F.lit(False)) & ~F.coalesce(by_code == by_id, F.lit(False)))
    j = j.withColumn("_c", decide.confidence(by_name.isNotNull(), F.col("_score"), F.coalesce("code_score", F.lit(0.0)), F.col("agreement"), F.col("margin")))
    route = decide.decision(by_name.isNotNull(), F.col("_c"), F.col("agreement"), F.col("margin"))
    target = F.when(by_id.isNotNull(), by_id).when(by_name.isNotNull(), by_name).otherwise(by_code)
    j = j.withColumn("_t", target)
    return j.withColumns({
        "card_id": F.col("_t"), "print_id": F.when(F.col("_t") == by_code, F.col("code_print")), "name_score": F.col("_score"), "language": F.coalesce("region", F.col("_f.language")), "tier": F.col("_f.tier"),
        "confidence": F.round(F.when(by_id.isNotNull(), F.when(conflict, 0.45).otherwise(1.0)).when(by_name.isNotNull(), F.col("_c")).otherwise(0.0), 9),
        "decision": F.when(by_id.isNotNull(), F.when(conflict, "manual").otherwise("auto")).when(by_name.isNotNull(), route).when(F.col("code").isNotNull() & by_code.isNotNull(), "manual").otherwise("unmatched"),
    })


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(token, key, tf, dl): the full-text index."""
    t = docs.select(key, text.tokens(F.col(body)).alias("t"))
    return t.select(key, F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("token", key, "dl").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, docs_count: DataFrame, queries: DataFrame, key: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` documents of each query (query_id, token): score = sum of idf * tf part; idf is at least 1e-6. Ties: smaller key first.

    ``docs_count``: one row with n (documents) and avgdl. Only postings of query tokens are kept (written once), and the frequency of each is counted there.
    """
    wanted = shared.written(queries.select("query_id", "token").distinct(), "query-tokens")
    hit = shared.written(index.join(shared.small(wanted.select("token").distinct()), "token", "left_semi"), "query-postings")
    df = hit.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs_count))  # one row of totals
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    df = wanted.join(df, "token").select("query_id", "token", "avgdl", idf.alias("idf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hit.join(df, "token").groupBy("query_id", key).agg(F.sum(F.col("idf") * part).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def blocked_similarity(left: DataFrame, right: DataFrame, cutoff: float = 0.7, grams: int = 3) -> DataFrame:
    """(l_id, r_id, score) with edit similarity >= cutoff; complete.

    ``left`` and ``right``: (id, name), ids unique. A name of n characters may differ by at most d = n * (1 - cutoff) / cutoff edits from one it matches, and each edit touches at most ``grams`` of its different grams. A name with more
    than ``grams * d`` of them shares one of its ``grams * d + 1`` rarest with each match, if that one has as many too; such names meet by grams, near the same place. The others meet by length.
    Only ids and numbers take part in the joins: counts of characters, packed in four longs, bound the distance; names are fetched for the pairs that are left.
    """
    size, counts_of = lambda: F.length("name"), ["s0", "s1", "s2", "s3"]

    def prepared(d: DataFrame, side: str) -> DataFrame:
        g = F.transform(F.sequence(F.lit(1), F.greatest(size() - grams + 1, F.lit(1))), lambda i: F.struct(F.substring(F.col("name"), i, F.lit(grams)).alias("gram"), i.alias("at")))
        d = d.select("id", "name", size().alias("n"), F.floor(size() * ((1 - cutoff) / cutoff) + 1e-9).cast("int").alias("d"), g.alias("g"))
        few = F.size(F.array_distinct(F.transform("g", lambda x: x["gram"]))) <= grams * F.col("d")
        return shared.written(d.withColumns({"few": few, **dict(zip(counts_of, text.counts_of_characters(F.col("name"))))}), f"names-{side}")

    a, b = prepared(left, "left"), prepared(right, "right")
    each = lambda d: d.filter("not few").select("id", "n", "d", *counts_of, F.explode("g").alias("g")).select("id", "n", "d", *counts_of, "g.gram", "g.at")
    counts = shared.written(each(a).select("gram").unionByName(each(b).select("gram")).groupBy("gram").agg(F.count("*").alias("k")), "gram-counts")
    counts = shared.small(counts, 1_000_000)  # a gram and a number

    def keyed(d: DataFrame, p: str) -> DataFrame:
        rows = each(d).join(counts, "gram").groupBy("id", "n", "d", *counts_of).agg(F.sort_array(F.collect_list(F.struct("k", "gram", "at"))).alias("g"))  # a name's grams
        rarest = F.array_distinct(F.transform("g", lambda x: F.struct(x["k"], x["gram"])))
        limit = F.get(rarest, grams * F.col("d"))  # the last gram of the prefix; equal grams stand at several places
        kept = F.filter("g", lambda x: F.struct(x["k"], x["gram"]) <= limit)
        own = [F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "d", *counts_of)]
        return rows.select(*own, F.explode(kept).alias("g")).select(*[f"{p}_{c}" for c in ("id", "n", "d", *counts_of)], "g.gram", F.col("g.at").alias(f"{p}_at"))

    def can_match() -> Column:
        """By the lengths and the counts of characters: most pairs end here, as numbers."""
        side = lambda p: [F.col(f"{p}_{c}") for c in counts_of]
        n, m = F.col("l_n"), F.col("r_n")
        return (F.least(n, m) >= cutoff * F.greatest(n, m) - 1e-9) & (text.least_distance(side("l"), side("r"), n, m) <= (1 - cutoff) * F.greatest(n, m) + 1e-9)

    # the place is part of the key: a gram that neither name's edits touch moved by d places at most
    near = keyed(a, "l").withColumn("at", F.explode(F.sequence(F.col("l_at") - F.col("l_d"), F.col("l_at") + F.col("l_d"))))
    by_gram = near.join(keyed(b, "r").withColumnRenamed("r_at", "at"), ["gram", "at"]).filter(can_match()).select("l_id", "r_id")
    spread = lambda d: d.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * cutoff - 1e-9).cast("int"), F.floor(F.col("n") / cutoff + 1e-9).cast("int"))))
    ids = lambda d, p, *more: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "few", *counts_of)], *more)
    by_length = ladder.dealt(ids(spread(a), "l", "m")).join(ids(b, "r", F.col("n").alias("m")), "m").filter(F.col("l_few") | F.col("r_few")).filter(can_match()).select("l_id", "r_id")
    pairs = by_gram.unionByName(by_length).distinct()
    named = pairs.join(a.select(F.col("id").alias("l_id"), F.col("name").alias("l_name")), "l_id").join(b.select(F.col("id").alias("r_id"), F.col("name").alias("r_name")), "r_id")
    score = text.edit_similarity_from(F.col("l_name"), F.col("r_name"), F.lit(cutoff - 1e-9))
    return named.withColumn("score", score).filter(F.col("score") >= cutoff).select("l_id", "r_id", "score")
