"""Export profiles of the collection: CSV and text lines, and a report of what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.functions import shared, text
from recordlink.operators import collection

# ---- fixed values: column order of the two CSV formats ------------------------------------------
POCKET_COLUMNS = (
    "card_id", "card_name", "quantity", "set_code", "rarity", "art_variant", "variant_label", "condition", "language", "printing_region", "notes", "storage_location",
    "grading_company", "grade", "certification_number", "subgrade_centering", "subgrade_corners", "subgrade_edges", "subgrade_surface", "sealed", "signed", "altered",
    "source", "edition", "purchase_price", "market_value_override",
)
BACKUP_COLUMNS = ("item_id", "card_id", "card_name", "card_print_id", "set_code_full", "set_prefix", "region", "rarity", "quantity", "condition", "edition", "language", "source", "added_at", "notes")
PARTNER_COLUMNS = ("Card Name", "Card Quantity", "Card Rarity", "Card Condition", "Card Edition", "Card Set", "Card Set Code")
CONDITIONS = {"Near Mint": "NM", "Lightly Played": "LP", "Moderately Played": "MP", "Heavily Played": "HP", "Damaged": "DMG"}
FLAGS = ("sealed", "signed", "altered")
# -------------------------------------------------------------------------------------------------


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _text(c: Column) -> Column:
    return text.safe_cell(F.coalesce(c.cast("string"), F.lit("")))


def pocket(shown: DataFrame) -> DataFrame:
    """The 26 columns as strings; what the collection does not hold is empty, flags are ``false``."""
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("EN"))
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv]), F.col("condition")), F.col("condition"))
    known = {
        "card_id": F.col("card_id").cast("string"), "card_name": text.safe_cell(F.col("name")), "quantity": F.col("quantity").cast("string"), "set_code": F.coalesce("show_set", F.lit("")), "rarity": _text(F.col("show_rarity")),
        "condition": short, "language": F.upper(language), "printing_region": F.lower(language), "notes": _text(_has(shown, "notes")), "edition": F.when(_has(shown, "edition") == "1st Edition", "1st Edition").otherwise(""),
    }
    return shown.select(*[known.get(c, F.lit("false" if c in FLAGS else "")).alias(c) for c in POCKET_COLUMNS])


def backup(shown: DataFrame) -> DataFrame:
    """The 15 columns with ids, from which a collection can be restored. ``item_id`` is a digest of the logical key, so that it stays the same; region is that of the print's code, null if it has none."""
    shown = shown if "edition" in shown.columns else shown.withColumn("edition", F.lit(collection.DEFAULT_EDITION))
    item = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in collection.KEY]))
    shown = text.with_code(shown.withColumn("_code", F.when(F.col("has_print"), F.col("show_set"))), "_code")
    known = {"item_id": item, "card_name": F.col("name"), "card_print_id": F.col("print_id"), "set_code_full": F.col("show_set"), "rarity": F.col("show_rarity"), "region": F.col("code.region")}
    return shown.select(*[known.get(c, _has(shown, c)).alias(c) for c in BACKUP_COLUMNS])


def _partner_cells(shown: DataFrame) -> list[Column]:
    known = (text.safe_cell(F.col("name")), F.col("quantity"), _text(F.col("show_rarity")), text.safe_cell(F.col("condition")), _text(_has(shown, "edition")), _text(_has(shown, "set_name")), F.coalesce("show_set", F.lit("")))
    return [v.alias(c) for c, v in zip(PARTNER_COLUMNS, known)]


def partner(shown: DataFrame) -> DataFrame:
    """The seven columns of the exchange format; what is unknown is empty."""
    return shown.select(*_partner_cells(shown))


def partner_in_sets(shown: DataFrame, sets: DataFrame) -> DataFrame:
    """``partner`` in the order of every export, with the name of each set (set_code, set_name) that an item's prefix names.

    Items are put in order before the names come: where sets share a code, an item is sorted once and becomes as many rows afterwards. The names of a table of bounded size are broadcast, which keeps the order.
    """
    names = shared.written(sets.groupBy("set_code").agg(F.collect_list(F.struct(_text(F.col("set_name")).alias("name"))).alias("names")), "set-names")
    near = shared.small(names)
    if near is names:  # too many codes to broadcast
        return partner(ordered(shown.join(sets.select(F.col("set_code").alias("set_prefix"), "set_name"), "set_prefix", "left")))
    rows = ordered(shown).filter(F.monotonically_increasing_id() >= 0)  # always true: Spark drops a sort that lies directly below a join
    cells = rows.select("set_prefix", *_partner_cells(rows)).join(near, F.col("set_prefix") == F.col("set_code"), "left").withColumn("name", F.explode_outer("names"))
    return cells.select(*[F.coalesce("name.name", F.lit("")).alias(c) if c == "Card Set" else F.col(f"`{c}`") for c in PARTNER_COLUMNS])


def ordered(shown: DataFrame) -> DataFrame:
    """By name, then by the whole key: the order of every export."""
    return shown.orderBy(F.lower("name"), "name", *[F.col(k).asc_nulls_first() for k in collection.KEY if k in shown.columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV text (column ``line``): cells with a quote, comma or line break are quoted, nulls are empty."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str, newline: str = "\n", bom: bool = False) -> None:
    """A folder of CSV files, each with a header, ``newline`` line ends and, if asked for, a byte order mark."""
    columns = [F.col(f"`{c}`").cast("string").alias(("﻿" if bom and not i else "") + c) for i, c in enumerate(df.columns)]
    df.select(*columns).write.option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", newline).csv(path)


#: (format, name) -> rows to export; the first of a format is its default.
PROFILES: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("csv", "partner"): partner,
    ("csv", "pocket"): pocket,
    ("csv", "backup"): backup,
    ("text", "list"): lambda df: collection.export_text(df, "list"),
    ("text", "deck"): lambda df: collection.export_text(df, "deck"),
    ("text", "count"): lambda df: collection.export_text(df, "count"),
}


def profile(kind: str, name: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The rows of a profile, in the order of every export."""
    found = [f for (k, n), f in PROFILES.items() if k == kind and name in (None, n)]
    if not found:
        raise ValueError(f"no profile {name!r} for {kind!r}; known: {sorted(PROFILES)}")
    return lambda shown: found[0](ordered(shown))


def profiles(shown: DataFrame) -> DataFrame:
    """(format, name, is_default, columns) of each profile."""
    rows, seen = [], set()
    for (kind, name), f in PROFILES.items():
        rows.append((kind, name, kind not in seen, f(shown).columns))
        seen.add(kind)
    return shown.sparkSession.createDataFrame(rows, "format string, name string, is_default boolean, columns array<string>")


def report(shown: DataFrame, skip_unresolved: bool) -> DataFrame:
    """One row: items an export writes and those it leaves out because they have no print."""
    out = F.col("print_id").isNull() & F.lit(skip_unresolved)
    return shown.agg(F.count_if(~out).alias("written"), F.count_if(out).alias("skipped"))
