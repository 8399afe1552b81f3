"""Lookups that a person types, promotion of lower candidates, second opinions, and what may go into a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.functions import text
from recordlink.operators import rules

# ---- fixed values -------------------------------------------------------------------------------
PROMOTE_GAP, MANUAL_CUTOFF, MANUAL_GAP = 0.10, 0.85, 0.05
EXTRA_FRAMES = ("fusion", "synchro", "xyz", "link", "fusion_pendulum", "synchro_pendulum", "xyz_pendulum")
NEVER_IN_DECK = ("token", "skill")
# -------------------------------------------------------------------------------------------------


def reconcile(candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """(reading_id, card_id, score, margin, agreement) from ``candidates`` (reading_id, card_id, score) and ``codes`` (reading_id, code_card).

    The best candidate stands, with a null agreement without a code card. If the code's card is a lower candidate within ``PROMOTE_GAP`` it is promoted;
    else the code contradicts. The margin is measured after promotion to the best other candidate, 1 if there is none. Ties: smaller card_id.
    """
    c = candidates.join(codes.select("reading_id", "code_card"), "reading_id", "left")
    order = F.struct(-F.col("score"), F.col("card_id"))
    # the two best and the code's own candidate are all that is needed, whatever the number of candidates
    own = F.max(F.when(F.col("card_id") == F.col("code_card"), F.col("score")))
    g = c.groupBy("reading_id").agg(F.min(order).alias("first"), F.first("code_card").alias("code_card"), own.alias("code_score"))
    rest = c.join(g.select("reading_id", F.col("first.card_id").alias("first_card")), "reading_id").filter("card_id <> first_card")
    rest = rest.groupBy("reading_id").agg(F.max("score").alias("second"))
    top = -F.col("first.col1")
    promoted = F.col("code_score").isNotNull() & (F.col("code_card") != F.col("first.card_id")) & (top - F.col("code_score") <= PROMOTE_GAP + 1e-9)
    agreement = F.when(F.col("code_card").isNotNull(), (F.col("code_card") == F.col("first.card_id")) | promoted)
    score = F.when(promoted, F.col("code_score")).otherwise(top)
    other = F.when(promoted, top).otherwise(F.col("second"))
    out = g.join(rest, "reading_id", "left")
    return out.select("reading_id", F.when(promoted, F.col("code_card")).otherwise(F.col("first.card_id")).alias("card_id"), score.alias("score"), F.coalesce(score - other, F.lit(1.0)).alias("margin"), F.coalesce(agreement, F.when(F.col("code_card").isNotNull(), F.lit(False))).alias("agreement"))


def manual_names(scored: DataFrame, key: str = "typed") -> DataFrame:
    """(key, status, card_id, choices) from ``scored`` (key, card_id or null, score): found, ambiguous (others within ``MANUAL_GAP``) or not_found."""
    best = scored.groupBy(key).agg(F.max("score").alias("best"))
    near = scored.join(best, key).filter("card_id is not null").filter(F.col("score") > F.col("best") - MANUAL_GAP)
    n = near.groupBy(key).agg(F.countDistinct("card_id").alias("choices"), F.min("card_id").alias("card_id"))
    j = best.join(n, key, "left")
    status = F.when(F.col("choices").isNull(), "not_found").when(F.col("choices") > 1, "ambiguous").otherwise("found")
    return j.select(key, status.alias("status"), F.when(F.col("choices") == 1, F.col("card_id")).alias("card_id"), F.coalesce("choices", F.lit(0)).alias("choices"))


def manual_prints(asked: DataFrame, prints: DataFrame) -> DataFrame:
    """``asked`` (ask_id, card_id, code, rarity or null) to (ask_id, code, status, print_id, pending_set, pending_rarity): found only if exactly one print of that card has the code (and the rarity, whatever its case)."""
    p = prints.select(F.col("card_id").alias("p_card"), F.col("set_code_full").alias("p_code"), "print_id", F.lower("rarity").alias("p_rarity"))
    a = asked.select("ask_id", "card_id", "code", "rarity")
    fits = (F.col("card_id") == F.col("p_card")) & (F.col("code") == F.col("p_code")) & (F.col("rarity").isNull() | (F.lower("rarity") == F.col("p_rarity")))
    g = a.join(p, fits, "left").groupBy("ask_id", "code", "rarity").agg(F.count("print_id").alias("n"), F.min("print_id").alias("print_id"))
    one = F.col("n") == 1
    status = F.when(one, "found").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return g.select("ask_id", "code", status.alias("status"), F.when(one, F.col("print_id")).alias("print_id"), F.when(~one, F.col("code")).alias("pending_set"), F.when(~one, F.col("rarity")).alias("pending_rarity"))


def second_opinion(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first`` and ``second`` (key, decision, confidence): the second reading replaces one that was not accepted, if it is at least as sure."""
    s = second.select(F.col(key).alias("_k"), F.col("decision").alias("d2"), F.col("confidence").alias("c2"))
    better = F.coalesce((F.col("decision") != "auto") & (F.col("c2") >= F.col("confidence")), F.lit(False))
    j = first.join(s, F.col(key) == F.col("_k"), "left")
    return j.select(key, F.when(better, F.col("d2")).otherwise(F.col("decision")).alias("decision"), F.when(better, F.col("c2")).otherwise(F.col("confidence")).alias("confidence"), better.alias("replaced"))


def admission(asked: DataFrame, deck_cards: DataFrame, card: DataFrame, owned: DataFrame) -> DataFrame:
    """``asked`` (ask_id, deck_id, card_id, zone, quantity, collection_only) to (ask_id, reason): the first rule that forbids it, null if it may go in.

    Rules in order: frame never in a list, frame not for the zone, zone full, limit of copies over all zones, copies owned. Unknown cards: ``unknown``.
    """
    zones = deck_cards.groupBy("deck_id", "zone").agg(F.sum("quantity").alias("in_zone"))
    copies = deck_cards.groupBy("deck_id", "card_id").agg(F.sum("quantity").alias("in_deck"))
    j = asked.join(card.select("card_id", "frame_type", "ban_tcg"), "card_id", "left").join(zones, ["deck_id", "zone"], "left").join(copies, ["deck_id", "card_id"], "left").join(owned.select("card_id", "copies"), "card_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    extra = F.col("frame_type").isin(*EXTRA_FRAMES)
    most = F.when(F.col("zone") == "main", rules.MAIN_MOST).when(F.col("zone") == "extra", rules.EXTRA_MOST).otherwise(rules.SIDE_MOST)
    reason = (
        F.when(F.col("frame_type").isNull(), "unknown").when(F.col("frame_type").isin(*NEVER_IN_DECK), "frame").when((F.col("zone") == "extra") & ~extra, "zone").when((F.col("zone") == "main") & extra, "zone")
        .when(n("in_zone") + F.col("quantity") > most, "full").when(n("in_deck") + F.col("quantity") > text.copy_limit(F.col("ban_tcg")), "limit")
        .when(F.col("collection_only") & (n("in_deck") + F.col("quantity") > n("copies")), "owned")
    )
    return j.select("ask_id", reason.alias("reason"))


def remaining(owned: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """(deck_id, card_id, remaining): copies owned that the list does not use yet, at least 0."""
    used = deck_cards.groupBy("deck_id", "card_id").agg(F.sum("quantity").alias("used"))
    j = used.join(owned.select("card_id", "copies"), "card_id", "left")
    return j.select("deck_id", "card_id", F.greatest(F.lit(0), F.coalesce("copies", F.lit(0)) - F.col("used")).cast("long").alias("remaining"))


def pool(items: DataFrame) -> DataFrame:
    """One row per card of items that passed the filters, before any page is cut."""
    return items.groupBy("card_id").agg(F.min("name").alias("name"), F.count("*").alias("items"))
