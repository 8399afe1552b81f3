"""The collection: deltas merged by a null-aware key, listings, statistics and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import text

# ---- fixed values -------------------------------------------------------------------------------
DEFAULT_EDITION = "Unlimited"
# -------------------------------------------------------------------------------------------------
KEY = ["card_id", "print_id", "pending_set", "pending_rarity", "condition", "edition", "language"]
#: What an item carries besides its key and quantity: where it came from first, the first notes, and when it was added.
CARRIED = ("source", "notes", "added_at")


def keyed(items: DataFrame) -> DataFrame:
    """``items`` with the whole key: no edition is the default one, and an empty pending set or rarity is none."""
    edition = F.coalesce(F.nullif(F.col("edition"), F.lit("")), F.lit(DEFAULT_EDITION)) if "edition" in items.columns else F.lit(DEFAULT_EDITION)
    pending = {c: F.nullif(F.col(c), F.lit("")) for c in ("pending_set", "pending_rarity") if c in items.columns}
    return items.withColumns({"edition": edition, **pending})


def _same(keys=KEY):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}"))
    return cond


def _carried(columns: list[str], turn: str) -> list:
    """First source, first notes that are not empty and first time of rows that become one item, in the order of ``turn``."""
    first = {"source": F.min_by("source", F.when(F.col("source").isNotNull(), F.col(turn))), "notes": F.min_by("notes", F.when(F.coalesce("notes", F.lit("")) != "", F.col(turn))), "added_at": F.min("added_at")} if columns else {}
    return [first[c].alias(c) for c in CARRIED if c in columns]


def items(deltas: DataFrame, order: str = "seq") -> DataFrame:
    """Deltas as items: quantities summed by key; the source, notes and time of each item are the first ones in ``order``."""
    d = keyed(deltas).repartition(*KEY)  # keys are nearly all different: sums beside the scan would hold a whole file part and save nothing
    return d.groupBy(*KEY).agg(F.sum("quantity").alias("quantity"), *_carried([c for c in CARRIED if c in d.columns], order))


def summed(deltas: DataFrame) -> DataFrame:
    """Quantities by the whole key, as it stands; memory is bounded by the parts of the shuffle, not by those of the file."""
    return deltas.select(*KEY, "quantity").repartition(*KEY).groupBy(*KEY).agg(F.sum("quantity").alias("quantity"))


def add(target: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """Quantities summed on the key (null equals null); the action says what happened. Sums are taken on the map side, so a key that many rows share costs one row for each task.

    Where both have a column of ``CARRIED``, an item keeps its own source, and its notes unless they are empty; new rows fill what is missing, in ``order`` if it is given (a column of ``delta``), else the least first.
    """
    t, d = keyed(target), keyed(delta)
    more = [c for c in CARRIED if c in t.columns and c in d.columns]
    turn = lambda which, by: F.struct(F.lit(which).alias("which"), by.alias("by"))
    late = F.col(order).cast("string") if order else F.concat_ws("|", *[F.col(c).cast("string") for c in more]) if more else F.lit("")
    late = F.lpad(late, 20, "0") if order else late
    old = t.select(*KEY, F.col("quantity").alias("old"), F.lit(None).cast("long").alias("new"), *more, turn(0, F.lit("")).alias("turn"))
    new = d.select(*KEY, F.lit(None).cast("long").alias("old"), F.col("quantity").cast("long").alias("new"), *more, turn(1, late).alias("turn"))
    g = old.unionByName(new).groupBy(*KEY).agg(F.sum("old").alias("old"), F.sum("new").alias("new"), *_carried(more, "turn"))  # groupBy puts nulls together
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated")
    return g.select(*KEY, (F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("quantity"), *more, action.alias("action"))


def remove(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Copies taken away (all where the delta's quantity is null); rows at zero disappear."""
    d = keyed(delta).groupBy(*KEY).agg(F.sum("quantity").alias("less"), F.max(F.col("quantity").isNull()).alias("all"))
    j = keyed(target).alias("t").join(d.alias("d"), _same(), "left")
    left = F.when(F.coalesce(F.col("d.all"), F.lit(False)), 0).otherwise(F.col("t.quantity") - F.least(F.coalesce("d.less", F.lit(0)), F.col("t.quantity")))
    return j.select(*[F.col(f"t.{k}") for k in KEY], left.cast("long").alias("quantity")).filter("quantity > 0")


def resolve_prints(target: DataFrame, choice: DataFrame) -> DataFrame:
    """Rows without a print get ``choice`` (card_id, pending_set, chosen); pending fields are cleared, and rows that now share a key, the edition included, are merged. The row that had the print keeps its source and notes."""
    target = keyed(target)
    more = [c for c in CARRIED if c in target.columns]
    j = target.join(choice.withColumnRenamed("pending_set", "c_set").withColumnRenamed("card_id", "c_card"), (F.col("card_id") == F.col("c_card")) & (F.col("pending_set") == F.col("c_set")) & F.col("print_id").isNull(), "left")
    hit = F.col("chosen").isNotNull()
    j = j.withColumns({"print_id": F.coalesce("chosen", "print_id"), "pending_set": F.when(~hit, F.col("pending_set")), "pending_rarity": F.when(~hit, F.col("pending_rarity"))})
    j = j.withColumn("turn", F.struct(hit.alias("late"), F.concat_ws("|", *[F.col(c).cast("string") for c in more]).alias("by"))) if more else j
    return j.groupBy(*KEY).agg(F.sum("quantity").alias("quantity"), *_carried(more, "turn"))


def one_per_id(prints: DataFrame) -> DataFrame:
    """One print for each print_id, the least by its code, where cards share ids: with it a listing shows every item once."""
    first = F.min(F.struct("set_code_full", "set_prefix", "rarity"))
    return prints.groupBy("print_id").agg(first.alias("p")).select("print_id", "p.*")


def listing(items: DataFrame, card: DataFrame, prints: DataFrame) -> DataFrame:
    """Items with card name and the set and rarity to show: the print's if there is one (even a null rarity), else the pending text."""
    p = prints.select(F.col("print_id").alias("p_id"), "set_code_full", "set_prefix", "rarity")
    j = items.join(card.select("card_id", "name", "type", "archetype", "level"), "card_id").join(p, F.col("print_id") == F.col("p_id"), "left")
    has = F.col("p_id").isNotNull()
    return j.select(*[F.col(c) for c in items.columns], "name", "type", "archetype", "level", F.when(has, F.col("set_code_full")).otherwise(F.col("pending_set")).alias("show_set"), F.when(has, F.col("rarity")).otherwise(F.col("pending_rarity")).alias("show_rarity"), "set_prefix", has.alias("has_print"))


def stats(shown: DataFrame) -> DataFrame:
    return shown.agg(
        F.countDistinct("card_id").alias("cards"), F.sum("quantity").alias("copies"), F.count_if(F.col("print_id").isNull() & F.col("pending_set").isNull()).alias("without_set"),
        F.countDistinct("set_prefix").alias("sets"), F.count_if(F.col("show_rarity").isNull()).alias("without_rarity"),
    )


def search(shown: DataFrame, alt: DataFrame, term: str, language: str) -> DataFrame:
    """Items whose normalised name has ``term``, or whose alternative name in ``language`` has it."""
    hit = alt.filter((F.col("language") == language) & text.normalize_strict(F.col("name")).contains(term)).select(F.col("card_id").alias("a_id")).distinct()
    j = shown.join(hit, F.col("card_id") == F.col("a_id"), "left")
    return j.filter(text.normalize_strict(F.col("name")).contains(term) | F.col("a_id").isNotNull()).drop("a_id")


def export_text(shown: DataFrame, profile: str) -> DataFrame:
    """Lines of the text profiles: ``list`` (one per item), ``deck`` (one per copy), ``count`` (quantity and name)."""
    if profile == "deck":
        return shown.select(F.explode(F.sequence(F.lit(1), F.col("quantity").cast("int"))), F.col("name").alias("line")).select("line")
    if profile == "count":
        return shown.select(F.concat_ws(" ", F.col("quantity").cast("string"), "name").alias("line"))
    place = F.when(F.col("has_print"), F.concat(F.lit("["), "show_set", F.lit("]"))).otherwise("[set desconhecido]")
    rarity = F.when(F.coalesce(F.col("show_rarity") != "", F.lit(False)), F.concat(F.lit(" ("), "show_rarity", F.lit(")"))).otherwise("")
    return shown.select(F.concat(F.col("quantity").cast("string"), F.lit("x "), "name", F.lit(" "), place, rarity).alias("line"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))).filter("_n = 1").drop("_n")


def labelled(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both sides with insert, update, same or stale; nothing is deleted."""
    e = existing.select(F.col(key).alias("k1"), F.struct(*columns).alias("old"))
    i = incoming.select(F.col(key).alias("k2"), F.struct(*columns).alias("new"))
    action = F.when(F.col("k1").isNull(), "insert").when(F.col("k2").isNull(), "stale").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return e.join(i, F.col("k1") == F.col("k2"), "full").select(F.coalesce("k1", "k2").alias(key), action.alias("action"))


def item_payload(items: DataFrame) -> DataFrame:
    """Items with ``rarity_pending``: a rarity was typed that no print stands for."""
    return items.withColumn("rarity_pending", F.col("print_id").isNull() & F.col("pending_rarity").isNotNull())


def primary_images(images: DataFrame) -> DataFrame:
    """(card_id, url): of a card's images (position, is_primary, image_url, image_url_small) the flagged one, else the first; its small variant if there is one."""
    order = F.struct((~F.coalesce("is_primary", F.lit(False))).cast("int"), "position")
    return images.groupBy("card_id").agg(F.min_by(F.coalesce(F.nullif("image_url_small", F.lit("")), F.col("image_url")), order).alias("url"))


def card_detail(card: DataFrame, prints: DataFrame, items: DataFrame, alt: DataFrame) -> DataFrame:
    """(card_id, name, prints, owned, languages): the prints in order with an owned flag, the copies owned over all prints, and English with the languages of its names."""
    have = items.filter("print_id is not null").select(F.col("print_id").alias("h_id")).distinct()
    p = prints.join(have, F.col("print_id") == F.col("h_id"), "left").groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("set_code_full", "print_id", "rarity", F.col("h_id").isNotNull().alias("owned")))).alias("prints"))
    n = items.groupBy("card_id").agg(F.sum("quantity").alias("owned"))
    a = alt.groupBy("card_id").agg(F.array_sort(F.collect_set("language")).alias("others"))
    j = card.select("card_id", "name").join(p, "card_id", "left").join(n, "card_id", "left").join(a, "card_id", "left")
    none = F.array().cast("array<string>")
    return j.select("card_id", "name", F.coalesce("prints", F.array().cast(p.schema["prints"].dataType)).alias("prints"), F.coalesce("owned", F.lit(0)).cast("long").alias("owned"), F.concat(F.array(F.lit("EN")), F.coalesce("others", none)).alias("languages"))


def nested_decks(deck_cards: DataFrame, card: DataFrame) -> DataFrame:
    """(deck_id, cards): the cards of a list in order of zone and id; a list holds some dozens."""
    j = deck_cards.join(card.select("card_id", "name"), "card_id")
    return j.groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("zone", "card_id", "name", "quantity"))).alias("cards"))
