"""Filters, search, order and pages over the catalogue and the collection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import shared, text
from recordlink.operators import collection, ladder

# ---- fixed values -------------------------------------------------------------------------------
EQUAL, BOUNDED = ("type", "attribute", "race"), ("atk", "defense", "level", "scale", "linkval")
LANGUAGES, DEFAULT_LANGUAGE = ("EN", "FR", "DE", "IT", "PT", "JA", "KO"), "EN"
UI_LANGUAGES = {"en": "EN", "pt_br": "PT"}
# -------------------------------------------------------------------------------------------------


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def card_filter(archetype: str | None = None, **wanted) -> Column:
    """One predicate of the given arguments: equality of type, attribute and race; a part of the archetype in any case; ``<stat>_min`` and ``<stat>_max``, inclusive. None means no filter; a null stat passes no bound."""
    out = [F.col(c) == wanted.pop(c) for c in EQUAL if wanted.get(c) is not None]
    if archetype and archetype.strip():
        out.append(F.contains(F.lower("archetype"), F.lit(archetype.strip().lower())))
    for c in BOUNDED:
        low, high = wanted.pop(f"{c}_min", None), wanted.pop(f"{c}_max", None)
        out += [F.col(c) >= low] if low is not None else []
        out += [F.col(c) <= high] if high is not None else []
    unknown = [k for k, v in wanted.items() if v is not None and k not in EQUAL]
    if unknown:
        raise ValueError(f"no such filters: {unknown}")
    return _all(out)


def item_filter(term: str | None = None, set_prefix: str | None = None, no_set: bool = False, no_rarity: bool = False) -> Column:
    """The predicate that a collection's listing and its count share, over ``collection.listing`` rows."""
    out = []
    if term:
        out.append(F.contains(text.normalize_strict(F.col("name")), text.normalize_strict(F.lit(term))))
    if set_prefix:
        out.append(F.col("set_prefix") == set_prefix.upper())
    if no_set:
        out.append(F.col("print_id").isNull() & F.col("pending_set").isNull())
    if no_rarity:
        out.append(F.when(F.col("has_print"), F.col("show_rarity").isNull()).otherwise(F.col("pending_set").isNotNull() & F.col("pending_rarity").isNull()))
    return _all(out)


def in_set(card: DataFrame, prints: DataFrame, set_prefix: str | None) -> DataFrame:
    return card.join(prints.filter(F.col("set_prefix") == set_prefix.upper()).select("card_id"), "card_id", "left_semi") if set_prefix else card


def tolerant_int(c: Column) -> Column:
    """A whole number as typed, or null."""
    return F.trim(c).try_cast("int")


def display_language(c: Column) -> Column:
    """A known language in any case, else English."""
    known = F.upper(F.trim(c))
    return F.when(known.isin(*LANGUAGES), known).otherwise(DEFAULT_LANGUAGE)


def language_of_ui(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UI_LANGUAGES.items() for x in kv]), F.lower(F.trim(c))), F.lit(DEFAULT_LANGUAGE))


def stored_language(c: Column) -> Column:
    """Two or three capital letters as they are, else English."""
    return F.when(c.rlike("^[A-Z]{2,3}$"), c).otherwise(DEFAULT_LANGUAGE)


def sort_key(name: Column, locale: str = "EN") -> list[Column]:
    """Order by name without case (and in Portuguese without accents), ties by the name itself."""
    return [F.lower(text.strip_accents(name) if locale == "PT_BR" else name), name]


def item_order(by: str = "name", descending: bool = False, backwards: bool = False) -> list[Column]:
    """The orders of a collection's listing, with the whole key as the last tie-break; ``backwards`` is the same order from its end."""
    first = {"name": [F.lower("name"), F.col("name")], "quantity": [F.col("quantity")], "added": [F.col("added_at")], "set": [F.col("show_set")]}[by]
    rest = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in collection.KEY]
    return [c.desc_nulls_last() if descending != backwards else c.asc_nulls_first() for c in first] + rest


#: Rows up to a page that a top-k may hold; deeper pages are found by ranges.
SHALLOW = 100_000


def page(df: DataFrame, order: list[Column], number: int, size: int, backwards: list[Column] | None = None) -> DataFrame:
    """Rows of a page with their place; a page beyond the last one is the last, and there is always a first one. Order by what tells rows apart.

    Of a page near the beginning the rows up to it are taken (a top-k, no full sort), and of one near the end those from it on, if ``backwards``, the same order from the end, is given. For one in between all rows are dealt out by ranges of the order and counted by range: only the ranges in which the page lies are sorted and numbered.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    lo, hi = (number - 1) * size, number * size
    if hi <= SHALLOW:
        rows, before = df.orderBy(*order).limit(hi), 0
    elif backwards and total - lo <= SHALLOW:
        rows, before = df.orderBy(*backwards).limit(total - lo), lo
    else:
        rows = shared.written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "page-ranges")
        ranges, start, before = [], 0, 0
        for r in rows.groupBy("_range").count().orderBy("_range").collect():  # one row for each range
            if start < hi and start + r["count"] > lo:
                before = before if ranges else start
                ranges.append(r["_range"])
            start += r["count"]
        rows = rows.filter(F.col("_range").isin(ranges)).drop("_range")
    rows = rows.withColumn("place", (F.row_number().over(W.orderBy(*order)) + before).cast("int")).filter((F.col("place") > lo) & (F.col("place") <= hi))
    return rows.withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def localised(card: DataFrame, alt: DataFrame, language: str) -> DataFrame:
    """``card`` (card_id, name, description) in a language: name, description and is_translated; what is not translated, or only with a blank description, stays English."""
    a = alt.filter(F.col("language") == language).select("card_id", F.col("name").alias("a_name"), F.col("description").alias("a_description"))
    j = card.join(a, "card_id", "left")
    return j.withColumns({"name": F.coalesce("a_name", "name"), "description": F.coalesce(F.when(F.trim("a_description") != "", F.col("a_description")), F.col("description")), "is_translated": F.col("a_name").isNotNull()}).drop("a_name", "a_description")


def search_cards(queries: DataFrame, card: DataFrame, alt: DataFrame, prints: DataFrame, language: str = "EN", wanted: Column | None = None, set_prefix: str | None = None, cap: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(query_id, card_id, place) of ``queries`` (query_id, query): the card whose id was typed, then English names by relevance, then names in ``language``.

    The filter comes before the ranking, so pages are never short; ``cap`` keeps so many candidates before the filter.
    """
    kept = in_set(card, prints, set_prefix)
    kept = kept.filter(wanted) if wanted is not None else kept
    every = shared.written(card.select("card_id", F.lit("EN").alias("language"), text.normalize_strict(F.col("name")).alias("strict")).unionByName(alt.filter(F.col("language") == language).select("card_id", "language", text.normalize_strict(F.col("name")).alias("strict"))), "search-names")
    asked = shared.written(ladder.phrases(queries, "query_id", "query"), "search-phrases")
    by_id = queries.select("query_id", F.when(F.trim("query").rlike("^[0-9]+$"), F.trim("query")).try_cast("long").alias("card_id")).join(card.select("card_id"), "card_id").select("query_id", "card_id", F.lit(1).alias("rank"))
    lists = [by_id]
    for names in (every.filter("language = 'EN'"), every.filter("language <> 'EN'")) if language != "EN" else (every.filter("language = 'EN'"),):
        index = shared.written(ladder.name_index(names, ["card_id"]), "search-index")
        lists.append(ladder.text_search(index, ladder.totals(index, ["card_id"]), asked, "query_id", "card_id", cap or 2**31 - 1).select("query_id", "card_id", "rank"))
    found = ladder.fused(lists, "query_id", "card_id", cap or 2**31 - 1).join(kept.select("card_id"), "card_id", "left_semi")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("place"))
    return found.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + limit)).select("query_id", "card_id", "place")


def facets(card: DataFrame) -> DataFrame:
    """(facet, value, place): the different types, attributes and races, each sorted."""
    rows = card.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in EQUAL])).alias("f")).select("f.facet", "f.value").filter("value is not null").distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy("value")))


def profile(tables: dict[str, DataFrame], items: DataFrame, state: DataFrame) -> DataFrame:
    """(name, value): rows of each table, copies in the collection, and the state's keys."""
    rows = [t.agg(F.lit(f"rows:{n}").alias("name"), F.count("*").cast("string").alias("value")) for n, t in tables.items()]
    rows.append(items.agg(F.lit("copies").alias("name"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("string").alias("value")))
    rows.append(state.select(F.concat(F.lit("state:"), "key").alias("name"), F.col("value").cast("string").alias("value")))
    return functools.reduce(DataFrame.unionByName, rows)
