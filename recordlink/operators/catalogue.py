"""Loading the catalogue: documents to rows, merges that never delete, enrichment, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import text
from recordlink.operators import collection

# ---- fixed values -------------------------------------------------------------------------------
PRIMARY, ENRICHED = "primary", "enrichment"
#: languages of an enrichment document and of the catalogue
ENRICHED_LANGUAGES = {"fr": "FR", "de": "DE", "it": "IT", "pt": "PT", "ja": "JA", "ko": "KO"}
# -------------------------------------------------------------------------------------------------


def stable_id(*key: Column) -> Column:
    """A number that follows from the logical key, nulls included, and stays between loads."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in key])


def print_rows(raw: DataFrame, sets: DataFrame) -> DataFrame:
    """Print rows of ``raw`` (card_id, pos, set_code, set_name, rarity, price).

    Codes are trimmed and in capitals, blank ones dropped. Of a card's equal (code, rarity) the first stays. A prefix that ``sets`` (set_code) lacks is null, the row stays; a code that cannot be read stays as text with parsed false.
    """
    r = raw.withColumn("set_code_full", F.upper(F.trim("set_code"))).filter("set_code_full <> ''")
    first = F.row_number().over(W.partitionBy("card_id", "set_code_full", F.coalesce("rarity", F.lit(""))).orderBy("pos"))
    r = text.with_code(r.withColumn("_n", first).filter("_n = 1").drop("_n"), "set_code_full")
    known = sets.select(F.col("set_code").alias("set_prefix")).distinct()
    j = r.withColumn("prefix", F.col("code.prefix")).join(known, F.col("prefix") == F.col("set_prefix"), "left")
    price = F.try_to_number(F.nullif(F.trim("price"), F.lit("")), F.lit("999999.99")).cast("double")
    return j.select("card_id", "set_code_full", F.col("code_canonical").alias("set_code_normalized"), "set_prefix", "set_name", "rarity", F.col("code.region").alias("region"), F.col("code.number").alias("number"), price.alias("price"), F.col("code").isNotNull().alias("parsed"))


def merged(existing: DataFrame, incoming: DataFrame, key: list[str], columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The new snapshot: ``key``, ``columns`` and an action for each key of both sides (insert, update, same or stale). Of incoming rows with one key the last (largest ``pos``, if there is one) counts.

    Stale rows stay as they are, ``keep`` columns are never overwritten, keys compare null with null, and nothing is deleted.
    """
    if "pos" in incoming.columns:
        last = F.row_number().over(W.partitionBy(*key).orderBy(F.col("pos").desc()))
        incoming = incoming.withColumn("_n", last).filter("_n = 1").drop("_n", "pos")
    e = existing.select(*key, F.struct(*columns).alias("old"))
    i = incoming.select(*[F.col(k).alias(f"i_{k}") for k in key], F.struct(*[c for c in columns if c not in keep]).alias("new"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"i_{k}"))
    j = e.join(i, same, "full")
    fresh = [c for c in columns if c not in keep]
    unchanged = F.lit(True)
    for c in fresh:
        unchanged = unchanged & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "stale").when(unchanged, "same").otherwise("update")
    value = lambda c: F.col(f"old.{c}") if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    is_new = F.col("old").isNull()
    return j.select(*[F.when(is_new, F.col(f"i_{k}")).otherwise(F.col(k)).alias(k) for k in key], *[value(c).alias(c) for c in columns], action.alias("action"))


def import_report(labelled: dict[str, DataFrame]) -> DataFrame:
    """(kind, inserted, updated, stale) of merged snapshots."""
    out = None
    for kind, df in labelled.items():
        n = lambda a: F.count_if(F.col("action") == a)
        row = df.agg(F.lit(kind).alias("kind"), n("insert").alias("inserted"), n("update").alias("updated"), n("stale").alias("stale"))
        out = row if out is None else out.unionByName(row)
    return out


def unparsed_sample(prints: DataFrame, most: int = 10) -> DataFrame:
    """One row: how many codes could not be read, and the first of them in order. Each task keeps its own first ones only."""
    bad = prints.filter("not parsed").select("set_code_full").distinct()
    top = bad.orderBy("set_code_full").limit(most).agg(F.array_sort(F.collect_list("set_code_full")).alias("sample"))
    return bad.agg(F.count("*").alias("codes")).crossJoin(top)  # two single rows


def known_cards(enriched: DataFrame, card: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The enrichment documents of known cards, and one row with how many were matched and unmatched; no card is created."""
    ids = card.select("card_id").distinct()
    known = enriched.join(ids, "card_id", "left_semi")
    n = enriched.join(ids.withColumn("hit", F.lit(True)), "card_id", "left").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))
    return known, n


def enriched_names(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Alternative names after an enrichment: (card_id, language, name, source, action). ``existing``: card_id, language, name, source; ``names``: card_id, language (as the document writes it), name, unofficial.

    Names of the primary source are never overwritten; unofficial and blank ones, and other languages, are skipped.
    """
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in ENRICHED_LANGUAGES.items() for x in kv]), F.col("language"))
    new = names.withColumn("language", lang).filter("language is not null and name <> '' and not coalesce(unofficial, false)").select("card_id", "language", "name", F.lit(ENRICHED).alias("source"))
    primary = existing.filter(F.col("source") == PRIMARY)
    new = new.join(primary.select("card_id", "language"), ["card_id", "language"], "left_anti")
    return merged(existing, new, ["card_id", "language"], ["name", "source"])


def enriched_prints(existing: DataFrame, prints: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prints and sets after an enrichment. ``existing``: card_id, set_code_full, rarity, region, source; ``prints``: card_id, language, set_code, set_name, rarities (an array, may be null).

    No rarity gives one row with a null one; what a run repeats counts once; rows of the primary source stay; the region is the document's language; prefixes that no set has become sets.
    """
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in ENRICHED_LANGUAGES.items() for x in kv]), F.col("language"))
    rows = prints.withColumns({"region": lang, "set_code_full": F.upper(F.trim("set_code")), "rarity": F.explode_outer("rarities")}).filter("region is not null and set_code_full <> ''")
    one = rows.groupBy("card_id", "set_code_full", "rarity").agg(F.min("region").alias("region"), F.min("set_name").alias("set_name"))
    primary = existing.filter(F.col("source") == PRIMARY).select("card_id", F.col("set_code_full").alias("p_code"), F.col("rarity").alias("p_rarity"), F.col("card_id").alias("p_card")).drop("card_id")
    same = (F.col("card_id") == F.col("p_card")) & (F.col("set_code_full") == F.col("p_code")) & (F.coalesce("rarity", F.lit("")) == F.coalesce("p_rarity", F.lit("")))
    new = one.join(primary, same, "left_anti").withColumn("source", F.lit(ENRICHED))
    found = text.with_code(one.select("set_code_full", "set_name"), "set_code_full").select(F.col("code.prefix").alias("set_code"), "set_name").filter("set_code is not null")
    fresh = found.join(sets.select("set_code"), "set_code", "left_anti").groupBy("set_code").agg(F.min("set_name").alias("set_name"))
    return merged(existing, new, ["card_id", "set_code_full", "rarity"], ["region", "source"]), fresh


def restored(target: DataFrame, backup: DataFrame) -> DataFrame:
    """The collection after a backup's rows were added by key: ``collection.add`` of rows with a positive quantity, pending set and rarity, edition, source and notes included."""
    rows = backup.filter("quantity > 0").withColumns({
        "print_id": F.col("card_print_id"), "pending_set": F.when(F.col("card_print_id").isNull(), F.col("set_code_full")), "pending_rarity": F.when(F.col("card_print_id").isNull(), F.col("rarity")),
    })
    rows = collection.keyed(rows)
    return collection.add(target, rows.select(*collection.KEY, "quantity", *[c for c in collection.CARRIED if c in rows.columns]))
