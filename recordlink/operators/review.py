"""Scan results on their way into the collection: print in the read language, apply once, confirm, payloads, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import decide, text
from recordlink.operators import changes, collection, match, search

# ---- fixed values -------------------------------------------------------------------------------
WAITING = ("pending", "manual", "unmatched")
DEFAULT_CONDITION = "Near Mint"
AUTO_SWEEP, REVIEW_SWEEP = tuple(round(0.80 + 0.01 * i, 2) for i in range(20)), tuple(round(0.50 + 0.02 * i, 2) for i in range(21))
# -------------------------------------------------------------------------------------------------


def waiting(results: DataFrame) -> DataFrame:
    """Results that wait for a person and have not been applied (a null ``applied`` has not); one without any candidate waits too."""
    return results.filter(F.col("decision").isin(*WAITING) & ~F.coalesce("applied", F.lit(False)))


def siblings(results: DataFrame, prints: DataFrame) -> DataFrame:
    """(result_id, sibling) of ``results`` (result_id, card_id, print_id, language): the print of the same card, set prefix and number in the language; of the same rarity if there is one, else the first. None for English or without a print."""
    own = prints.select(F.col("print_id").alias("o_id"), F.col("set_prefix").alias("o_prefix"), F.col("number").alias("o_number"), F.col("rarity").alias("o_rarity")).repartition("o_id").distinct()  # cards share print ids: each print once, or the results multiply
    r = results.filter("language <> 'EN' and print_id is not null").join(own, F.col("print_id") == F.col("o_id")).select("result_id", "card_id", "language", "o_prefix", "o_number", "o_rarity").filter("o_prefix is not null")
    place = ["card_id", "set_prefix", "number", "region"]
    other = prints.filter("set_prefix is not null and region is not null and region <> 'EN'").groupBy(*[F.col(c).alias(f"s_{c}") for c in place], F.col("rarity").alias("s_rarity")).agg(F.min("print_id").alias("sibling"))
    fits = (F.col("card_id") == F.col("s_card_id")) & (F.col("o_prefix") == F.col("s_set_prefix")) & F.col("o_number").eqNullSafe(F.col("s_number")) & (F.col("language") == F.col("s_region"))
    order = F.struct((~F.col("s_rarity").eqNullSafe(F.col("o_rarity"))).cast("int"), "sibling")
    return r.join(other, fits).groupBy("result_id").agg(F.min_by("sibling", order).alias("sibling"))


def in_language(results: DataFrame, prints: DataFrame, overrides: DataFrame) -> DataFrame:
    """``results`` with print_id in the read language: what a person chose for (card, language) first, then the sibling, else as it is. English stays."""
    o = overrides.select(F.col("card_id").alias("v_card"), F.col("language").alias("v_language"), F.col("print_id").alias("chosen"))
    j = results.join(o, (F.col("card_id") == F.col("v_card")) & (F.col("language") == F.col("v_language")), "left").join(siblings(results, prints), "result_id", "left")
    new = F.when(F.coalesce("language", F.lit("EN")) != "EN", F.coalesce("chosen", "sibling"))
    return j.withColumn("print_id", F.coalesce(new, "print_id")).select(results.columns)


def already_applied(results: DataFrame, applied: DataFrame, items: DataFrame) -> DataFrame:
    """(image_id, crop) of applied results whose collection row still exists."""
    live = applied.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return results.select("image_id", "crop").join(live.select("image_id", "crop"), ["image_id", "crop"], "left_semi").distinct()


def apply_auto(target: DataFrame, results: DataFrame, applied: DataFrame, items: DataFrame, prints: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collection, results with the print used and applied) after accepted results (result_id, image_id, crop, card_id, print_id, set_code, language, decision) added a copy each, once per image and crop.

    Of several accepted results of a crop the first counts. Without a print the set that was read is kept as pending.
    """
    done = already_applied(results, applied, items).withColumn("done", F.lit(True))
    r = results.join(done, ["image_id", "crop"], "left")
    can = (F.col("decision") == "auto") & F.col("card_id").isNotNull() & F.col("done").isNull()
    first = F.row_number().over(W.partitionBy("image_id", "crop", "can").orderBy("result_id"))
    r = r.withColumn("can", F.coalesce(can, F.lit(False))).withColumn("applied", F.col("can") & (first == 1)).select(*results.columns, "applied")
    # the read language decides only for what is applied; the rest keeps its print and meets no print at all
    asked = r.withColumns({"was_print": F.col("print_id"), "was_language": F.col("language"), "language": F.when(F.col("applied"), F.col("language"))})
    moved = in_language(asked, prints, overrides)
    out = moved.withColumns({"print_id": F.when(F.col("applied"), F.col("print_id")).otherwise(F.col("was_print")), "language": F.col("was_language")}).select(*results.columns, "applied")
    delta = out.filter("applied").select("card_id", "print_id", F.when(F.col("print_id").isNull(), F.col("set_code")).alias("pending_set"), F.lit(None).cast("string").alias("pending_rarity"), F.lit(DEFAULT_CONDITION).alias("condition"), F.coalesce("language", F.lit("EN")).alias("language"), F.lit(1).alias("quantity"))
    return collection.add(target, delta), out


def with_rarity(asked: DataFrame, prints: DataFrame) -> DataFrame:
    """``asked`` (ask_id, card_id, print_id, set_code, rarity): a set code and a rarity that name exactly one print of the card become it, and are cleared."""
    p = prints.select(F.col("card_id").alias("p_card"), F.col("set_code_full").alias("p_code"), F.lower("rarity").alias("p_rarity"), F.col("print_id").alias("found"))
    fits = (F.col("card_id") == F.col("p_card")) & (F.col("set_code") == F.col("p_code")) & (F.lower("rarity") == F.coalesce("p_rarity", F.lit(""))) & F.col("print_id").isNull()
    one = asked.join(p, fits).groupBy("ask_id").agg(F.count("*").alias("n"), F.min("found").alias("found")).filter("n = 1").drop("n")
    j = asked.join(one, "ask_id", "left")
    clear = lambda c: F.when(F.col("found").isNull() & F.col("print_id").isNull(), F.col(c)).alias(c)
    return j.select(*[c for c in asked.columns if c not in ("print_id", "set_code", "rarity")], F.coalesce("print_id", "found").alias("print_id"), clear("set_code"), clear("rarity"))


def confirm(target: DataFrame, results: DataFrame, asked: DataFrame, prints: DataFrame, overrides: DataFrame) -> dict[str, DataFrame]:
    """A batch of confirmations by persons: the new ``collection``, ``results``, ``overrides`` and the ``outcome`` of each.

    ``asked``: ask_id, result_id, card_id, print_id, set_code, rarity, quantity, language. ``results``: result_id, decision, applied, language, card_id, print_id. A result that is unknown or was applied before (also by an earlier
    confirmation of the batch) is an error row. Language: the given one, that of the reading, the print's region, English; one that is not two or three capitals is English. A print confirmed in another language is learnt.
    """
    # of a print that cards share each row is an outcome; they travel as one list and become rows after everything else
    regions = prints.filter("print_id is not null").select(F.col("print_id").alias("r_id"), "region").repartition("r_id").groupBy("r_id").agg(F.sort_array(F.collect_list(F.struct("region"))).alias("regions"))
    a = with_rarity(asked, prints)
    a = a.join(regions, F.col("print_id") == F.col("r_id"), "left").drop("r_id").join(results.select("result_id", F.col("applied").alias("was"), F.col("language").alias("read"), F.lit(True).alias("known")), "result_id", "left")
    in_ = lambda region: search.stored_language(F.coalesce("asked_language", "read", region, F.lit("EN")))
    a = a.withColumnRenamed("language", "asked_language").withColumn("language", in_(F.get("regions", F.lit(0))["region"]))
    turn = F.row_number().over(W.partitionBy("result_id").orderBy("ask_id"))
    outcome = F.when(F.col("known").isNull(), "unknown").when(F.col("was") | (turn > 1), "already_applied").otherwise("confirmed")
    a = a.withColumn("outcome", outcome)
    each = a.select("ask_id", "outcome", "print_id", "asked_language", "read", F.posexplode_outer("regions").alias("n", "r"))
    again = F.when((F.col("n") > 0) & (F.col("outcome") == "confirmed"), "already_applied").otherwise(F.col("outcome"))
    outcomes = each.select("ask_id", again.alias("outcome"), in_(F.col("r")["region"]).alias("language"), "print_id")
    good = a.filter("outcome = 'confirmed'")
    pending = lambda c, n: F.when(F.col("print_id").isNull(), F.col(c)).alias(n)
    delta = good.select("card_id", "print_id", pending("set_code", "pending_set"), pending("rarity", "pending_rarity"), F.lit(DEFAULT_CONDITION).alias("condition"), "language", "quantity")
    marks = good.select("result_id", F.col("card_id").alias("c_card"), F.col("print_id").alias("c_print"), F.lit(True).alias("c"))
    r = results.join(marks, "result_id", "left")
    new = r.withColumns({"decision": F.when(F.col("c"), "confirmed").otherwise(F.col("decision")), "applied": F.col("applied") | F.coalesce("c", F.lit(False)), "card_id": F.coalesce("c_card", "card_id"), "print_id": F.when(F.col("c"), F.col("c_print")).otherwise(F.col("print_id"))}).select(results.columns)
    learnt = good.filter("print_id is not null and language <> 'EN'").select("card_id", "language", "print_id", F.col("ask_id").alias("at"))
    both = overrides.select("card_id", "language", "print_id", F.lit(None).cast("long").alias("at")).unionByName(learnt.withColumn("at", F.col("at").cast("long")))
    return {"collection": collection.add(target, delta), "results": new, "overrides": changes.overrides(both.withColumn("at", F.coalesce("at", F.lit(-1))), ["card_id", "language"], "print_id", "at", "print_id"), "outcome": outcomes}


def set_notes(target: DataFrame, wanted: DataFrame) -> DataFrame:
    """``target`` (item_id, print_id, notes, pending_rarity) after ``wanted`` (item_id, op, value, seq): op notes or rarity, a null value clears, the last of each counts; a rarity is only taken by items without a print."""
    last = lambda op: F.max_by(F.struct("value"), F.when(F.col("op") == op, F.col("seq"))).alias(f"new_{op}")
    w = wanted.groupBy("item_id").agg(last("notes"), last("rarity"), *[F.bool_or(F.col("op") == op).alias(f"has_{op}") for op in ("notes", "rarity")])
    j = target.join(w, "item_id", "left")
    notes = F.when(F.col("has_notes"), F.col("new_notes.value")).otherwise(F.col("notes"))
    rarity = F.when(F.col("has_rarity") & F.col("print_id").isNull(), F.col("new_rarity.value")).otherwise(F.col("pending_rarity"))
    return j.select("item_id", "print_id", notes.alias("notes"), rarity.alias("pending_rarity"))


def deck_cards(deck: DataFrame, changed: DataFrame) -> DataFrame:
    """``deck`` (deck_id, card_id, zone, quantity) after ``changed`` (deck_id, card_id, zone, op, quantity): add sums, set (the largest, if several) replaces, remove deletes; a row at zero or below disappears. Of one key's changes set comes before add, and remove last."""
    key = ["deck_id", "card_id", "zone"]
    n = lambda op, f: f(F.when(F.col("op") == op, F.col("quantity")))
    c = changed.repartition(*key).groupBy(*key).agg(n("add", F.sum).alias("more"), n("set", F.max).alias("to"), F.bool_or(F.col("op") == "remove").alias("gone"))  # keys meet once: sums beside the scan would hold a whole file part
    j = deck.join(c, key, "full")
    out = F.coalesce("to", "quantity", F.lit(0)) + F.coalesce("more", F.lit(0))
    return j.filter(~F.coalesce("gone", F.lit(False))).select(*key, out.cast("long").alias("quantity")).filter("quantity > 0")


def latest_images(known: DataFrame, read: DataFrame) -> DataFrame:
    """Images by content hash after a batch: (file_hash, path, status, action); the latest reading (largest read_at) overwrites path and status."""
    last = read.groupBy("file_hash").agg(F.max_by(F.struct("path", "status"), F.struct("read_at", "path")).alias("new"))
    j = known.select("file_hash", F.struct("path", "status").alias("old")).join(last, "file_hash", "full")
    now = F.coalesce("new", "old")
    return j.select("file_hash", now["path"].alias("path"), now["status"].alias("status"), F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated").alias("action"))


def label(path: Column, crop: Column, crops: Column) -> Column:
    """The file, with [i/N] where it holds several crops."""
    return F.when(crops > 1, F.concat(path, F.lit(" ["), (crop + 1).cast("string"), F.lit("/"), crops.cast("string"), F.lit("]"))).otherwise(path)


def shown_candidates(candidates: Column, card_id: Column, name: Column, confidence: Column) -> Column:
    """The stored candidates, or one from the resolved card, or none."""
    one = F.array(F.struct(card_id.alias("card_id"), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Carta #"), card_id.cast("string"))).alias("name"), confidence.alias("score")))
    none = F.filter(one, lambda x: F.lit(False))
    return F.when(F.size(F.coalesce(candidates, none)) > 0, candidates).when(card_id.isNotNull(), one).otherwise(none)


def with_identity(candidates: Column, card_id: Column, name: Column, marker: Column) -> Column:
    """The candidates with a card that a code or an id named, in front, unless it is among them."""
    one = F.struct(card_id.alias("card_id"), text.identity_label(name, card_id, marker).alias("name"), F.lit(1.0).alias("score"))
    return F.when(card_id.isNull() | F.exists(candidates, lambda x: x["card_id"] == card_id), candidates).otherwise(F.concat(F.array(one), candidates))


def result_payload(results: DataFrame) -> DataFrame:
    """Results (result_id, raw_id, name_score, confidence, margin, left, top, right, bottom and others) as stored payloads: rounded scores, the cleaned id, and the box nested or null."""
    box = F.when(F.col("left").isNotNull(), F.struct("left", "top", "right", "bottom"))
    return results.withColumns({c: text.stored_score(F.col(c)) for c in ("name_score", "confidence", "margin")} | {"clean_id": text.clean_id(F.col("raw_id")), "box": box}).drop("left", "top", "right", "bottom", "raw_id")


def attached(results: DataFrame, card: DataFrame, prints: DataFrame) -> DataFrame:
    """``results`` (result_id, card_id, print_id, code) with card_name, print_set, print_rarity and code_prints, all prints that the code names, in order."""
    p = prints.select(F.col("print_id").alias("p_id"), F.col("set_code_full").alias("print_set"), F.col("rarity").alias("print_rarity"))
    of = prints.groupBy(F.col("set_code_full").alias("code")).agg(F.sort_array(F.collect_list(F.struct("print_id", "card_id", "rarity"))).alias("code_prints"))  # a code has a few prints
    j = results.join(card.select("card_id", F.col("name").alias("card_name")), "card_id", "left").join(p, F.col("print_id") == F.col("p_id"), "left").join(of, "code", "left")
    return j.select(*results.columns, "card_name", "print_set", "print_rarity", F.coalesce("code_prints", F.array().cast(of.schema["code_prints"].dataType)).alias("code_prints"))


def print_options(resolved: DataFrame, prints: DataFrame) -> DataFrame:
    """(reading_id, options) of ``resolved`` (reading_id, card_id, code), one row per reading: the prints of the card that the code names, where there are several of the code. Only such codes meet the readings."""
    every = F.sort_array(F.collect_list(F.struct("print_id", "rarity", "card_id")))  # a code has a few prints
    p = prints.groupBy(F.col("set_code_full").alias("code")).agg(every.alias("every")).filter(F.size("every") > 1)
    own = F.transform(F.filter("every", lambda x: x["card_id"] == F.col("card_id")), lambda x: F.struct(x["print_id"].alias("print_id"), x["rarity"].alias("rarity")))
    return resolved.join(p, "code").select("reading_id", own.alias("options"))


def backfilled(results: DataFrame, images: DataFrame) -> DataFrame:
    """``results`` with a job_id from their image where they have none."""
    i = images.select("image_id", F.col("job_id").alias("i_job"))
    return results.join(i, "image_id", "left").withColumn("job_id", F.coalesce("job_id", "i_job")).drop("i_job")


def job_report(results: DataFrame) -> DataFrame:
    """Per job: total, skipped, processed, auto, already_applied, pending, failed, empty_cells, and percentages of the crops (null without any), of ``results`` (job_id, status, decision, applied_before)."""
    is_ = lambda c: F.coalesce(c, F.lit(False))
    s, dec = F.col("status"), F.col("decision")
    crop = is_(s == "ok")
    g = results.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(is_(s == "skipped")).alias("skipped"), F.count_if(crop).alias("processed"), F.count_if(crop & is_(dec == "auto") & ~is_(F.col("applied_before"))).alias("auto"),
        F.count_if(crop & is_(dec == "auto") & is_(F.col("applied_before"))).alias("already_applied"), F.count_if(crop & is_(dec.isin(*WAITING))).alias("pending"), F.count_if(is_(s == "failed")).alias("failed"), F.count_if(is_(s == "empty")).alias("empty_cells"),
    )
    share = lambda c: F.bround(F.try_divide(100.0 * F.col(c), F.col("processed"))).cast("long").alias(f"{c}_percent")
    return g.select("*", share("auto"), share("pending"), share("failed"))


def review_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("decision") == "confirmed").alias("confirmed"), F.count_if(F.col("decision") == "rejected").alias("rejected"), F.count_if(F.col("decision").isin(*WAITING)).alias("skipped"))


def image_status(crops: DataFrame) -> DataFrame:
    """(image_id, status) of crops (image_id, crop, status): ok if any is, else the first crop's."""
    return crops.groupBy("image_id").agg(F.when(F.bool_or(F.col("status") == "ok"), "ok").otherwise(F.min_by("status", "crop")).alias("status"))


def region_text(lines: DataFrame, regions: tuple[str, ...], fallback: str) -> DataFrame:
    """Per image: for each region the lines (image_id, region, x, text, confidence) joined by x, the most confident line (the first in order, if equal) and the mean confidence; an empty region takes the ``fallback`` region's."""
    kept = lines.filter("trim(text) <> ''")
    best = F.max_by("text", F.struct("confidence", -F.col("x")))
    g = kept.groupBy("image_id", "region").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY x)").alias("joined"), best.alias("best"), F.avg("confidence").alias("mean"))
    wide = g.groupBy("image_id").agg(*[F.max(F.when(F.col("region") == r, F.struct("joined", "best", "mean"))).alias(f"r{i}") for i, r in enumerate((*regions, fallback))])
    wide = lines.select("image_id").distinct().join(wide, "image_id", "left")
    last = F.col(f"r{len(regions)}")
    each = F.array(*[F.struct(F.lit(r).alias("region"), F.coalesce(f"r{i}", last).alias("t"), F.col(f"r{i}").isNull().alias("empty")) for i, r in enumerate(regions)])
    return wide.select("image_id", F.explode(each).alias("e")).select("image_id", "e.region", "e.t.joined", "e.t.best", "e.t.mean", "e.empty")


def against_truth(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """``matched`` (file, card_id, code, ...) beside ``expected`` (file, card_id, code or null): name_ok, and code_ok (true where none is expected). Files without a reading are wrong."""
    e = expected.select("file", F.col("card_id").alias("want_card"), F.col("code").alias("want_code"))
    j = e.join(matched, "file", "left")
    return j.withColumns({"name_ok": F.coalesce(F.col("card_id") == F.col("want_card"), F.lit(False)), "code_ok": F.col("want_code").isNull() | F.coalesce(F.col("code") == F.col("want_code"), F.lit(False))})


def errors(judged: DataFrame) -> DataFrame:
    return judged.filter(~F.col("name_ok") | ~F.col("code_ok"))


def sure_errors(readings: DataFrame, cards: DataFrame, variants: DataFrame, prints: DataFrame) -> DataFrame:
    """(file, name_ok, code_ok) of ``readings`` (reading_id, kind, truth, raw_code) whose name or code is not what was expected, for ids that do not repeat: nothing is joined by them.

    ``cards``: (truth, kind, raw_name), the one name that such readings have; it is looked up once for all of them. What a code resolves to is the code that was read only if that is clean and the catalogue has it.
    """
    asked = cards.select(F.struct("truth", "kind").alias("reading_id"), "raw_name", "truth")
    right = match.exact_names(asked, variants).filter(F.col("name_card") == F.col("reading_id.truth")).groupBy("reading_id.truth").agg(F.collect_set("reading_id.kind").alias("kinds"))  # by card, as the readings lie
    known = prints.select(F.col("set_code_full").alias("raw_code")).distinct().withColumn("known", F.lit(True))
    j = readings.join(right, "truth", "left").withColumn("right", F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)))
    j = j.select("reading_id", "raw_code", "right", (F.col("kind") == 2).alias("without")).join(known, "raw_code", "left")
    clean = F.col("known") & (text.code_clean(F.col("raw_code")) == F.col("raw_code")) & (F.col("raw_code") != "")
    return errors(j.select(F.col("reading_id").alias("file"), F.col("right").alias("name_ok"), (F.col("without") | F.coalesce(clean, F.lit(False))).alias("code_ok")))


def threshold_sweep(judged: DataFrame, auto: tuple = AUTO_SWEEP, review: tuple = REVIEW_SWEEP) -> DataFrame:
    """Every pair of thresholds with review <= auto: each reading is decided again; auto_count, auto_correct, manual_count, precision (null without any) and recall.

    ``judged``: confidence, agreement, margin, has_candidate, name_ok and code_ok. Equal rows are counted before they meet the grid, whose size is fixed.
    """
    spark = judged.sparkSession
    rows = judged.groupBy("confidence", "agreement", "margin", "has_candidate", (F.col("name_ok") & F.col("code_ok")).alias("right")).agg(F.count("*").alias("k"))
    grid = spark.createDataFrame([(float(a), float(r)) for a in auto for r in review if r <= a], "auto double, review double")
    x = rows.crossJoin(F.broadcast(grid))
    agreed_at = F.least(F.lit(decide.AGREED), F.col("auto"))
    is_auto = decide.decision(F.col("has_candidate"), F.col("confidence"), F.col("agreement"), F.col("margin"), F.col("auto"), F.col("review"), agreed_at) == "auto"
    n = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    g = x.groupBy("auto", "review").agg(n(is_auto).alias("auto_count"), n(is_auto & F.col("right")).alias("auto_correct"), n(~is_auto).alias("manual_count"))
    return g.withColumns({"precision": F.try_divide("auto_correct", "auto_count"), "recall": F.try_divide("auto_correct", F.col("auto_count") + F.col("manual_count"))})


def best_thresholds(sweep: DataFrame, least: float = 1.0, top: int = 5) -> DataFrame:
    """The thresholds without a wrong acceptance that accept most: recall, then the larger auto (then the smaller review)."""
    order = [F.col("recall").desc(), F.col("auto").desc(), F.col("review")]
    return sweep.filter(F.col("precision") >= least).orderBy(*order).limit(top).withColumn("place", F.row_number().over(W.orderBy(*order)))


def truth_rows(matched: DataFrame) -> dict[str, DataFrame]:
    """Ground truth from made readings (file, read_name, read_code, legible, error, card_id, name, code, confidence, decision): the whole ``state``, and of it ``expected`` (resolved, nothing to review) and ``unresolved``."""
    resolved = F.col("card_id").isNotNull() & F.col("error").isNull()
    review = F.col("error").isNotNull() | ~F.coalesce("legible", F.lit(False)) | F.col("card_id").isNull() | (F.col("decision") != "auto")
    state = matched.select("file", F.when(resolved, F.col("name")).otherwise(F.nullif("read_name", F.lit(""))).alias("name"), F.when(resolved, F.col("code")).alias("set_code"), review.alias("needs_review"), resolved.alias("resolved"), F.round(F.coalesce("confidence", F.lit(0.0)).cast("decimal(20,9)"), 3).cast("double").alias("match_confidence"), F.coalesce("decision", F.lit("unmatched")).alias("match_decision"))
    return {"state": state, "expected": state.filter("not needs_review").select("file", "name", "set_code"), "unresolved": state.filter("needs_review")}


def write_truth(rows: dict[str, DataFrame], path: str) -> None:
    for name, df in rows.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
