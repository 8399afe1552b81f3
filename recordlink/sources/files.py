"""Nested JSON and CSV files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.functions import text

# ---- fixed values: shapes of the files ----------------------------------------------------------
PAGE = """data array<struct<
    id: bigint, name: string, type: string, frameType: string, `desc`: string, race: string, atk: int, def: int, level: int, attribute: string, archetype: string, scale: int, linkval: int,
    typeline: array<string>, linkmarkers: array<string>, name_en: string,
    banlist_info: struct<ban_tcg: string, ban_ocg: string, ban_goat: string>,
    misc_info: array<struct<tcg_date: string, ocg_date: string, konami_id: bigint, has_effect: int>>,
    card_sets: array<struct<set_name: string, set_code: string, set_rarity: string, set_rarity_code: string, set_price: string>>,
    card_images: array<struct<id: bigint, image_url: string, image_url_small: string, image_url_cropped: string>>>>"""
SETS = "set_name string, set_code string, num_of_cards int, tcg_date string, set_image string"
ENRICHED = "password bigint, name map<string,string>, sets map<string, array<struct<set_number: string, set_name: string, rarities: array<string>>>>, is_translation_unofficial struct<name: map<string, boolean>>"
TRUTH = "file string, name string, set_code string, grid_size string, cells array<struct<name: string, set_code: string, passcode: string, card_back: boolean>>"
READING = "map<string, struct<name: string, set_code: string, language: string, legible: boolean>>"
RAW_LINES = "map<string, array<struct<text: string, confidence: double, x: double>>>"
IMAGES = ("jpg", "jpeg", "png")
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A"}
BACKUP = "item_id string, card_id bigint, card_name string, card_print_id string, set_code_full string, set_prefix string, region string, rarity string, quantity int, condition string, edition string, language string, source string, added_at string, notes string"
# -------------------------------------------------------------------------------------------------


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def card_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per card of the pages under ``path`` (one JSON document per file)."""
    return _json(spark, path, PAGE).select(F.explode("data").alias("c")).select("c.*")


def translated_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cards of the pages in ``path``/language=XX: (card_id, language, name, normalised, description, name_en)."""
    c = _json(spark, path, PAGE).select("language", F.explode("data").alias("c"))
    return c.select(F.col("c.id").alias("card_id"), F.upper("language").alias("language"), "c.name", text.normalize_strict(F.col("c.name")).alias("normalised"), F.col("c.desc").alias("description"), "c.name_en")


def cards_of(pages: DataFrame) -> DataFrame:
    """Flat card rows: normalised name, the first misc entry, blank dates as null, ban fields."""
    m = F.get("misc_info", F.lit(0))
    date = lambda c: F.expr(f"try_cast(nullif(trim(misc_info[0].{c}), '') AS date)").alias(c)
    return pages.select(
        F.col("id").alias("card_id"), "name", text.normalize_strict(F.col("name")).alias("normalised"), "type", F.col("frameType").alias("frame_type"), F.col("desc").alias("description"), "race", "atk", F.col("def").alias("defense"), "level", "attribute", "archetype", "scale", "linkval",
        "typeline", "linkmarkers", date("tcg_date"), date("ocg_date"), m["konami_id"].alias("konami_id"), (m["has_effect"] == 1).alias("has_effect"), "banlist_info.ban_tcg", "banlist_info.ban_ocg",
    )


def prints_of(cards: DataFrame) -> DataFrame:
    """(card_id, pos, set_name, set_code, rarity, rarity_code, price as text): one row per print, for ``catalogue.print_rows``; cards without any have none."""
    p = cards.select(F.col("id").alias("card_id"), F.posexplode("card_sets").alias("pos", "s"))
    return p.select("card_id", "pos", "s.set_name", "s.set_code", F.col("s.set_rarity").alias("rarity"), F.col("s.set_rarity_code").alias("rarity_code"), F.col("s.set_price").alias("price"))


def images_of(cards: DataFrame) -> DataFrame:
    """(card_id, position, is_primary, ...): the first image is the primary one."""
    i = cards.select(F.col("id").alias("card_id"), F.posexplode("card_images").alias("position", "i"))
    return i.select("card_id", "position", (F.col("position") == 0).alias("is_primary"), F.col("i.id").alias("image_id"), "i.image_url", "i.image_url_small", "i.image_url_cropped")


def card_sets(spark: SparkSession, path: str) -> DataFrame:
    """The set catalogue; codes trimmed and in capitals, a blank or unreadable date is null."""
    s = _json(spark, path, SETS)
    return s.withColumns({"set_code": F.upper(F.trim("set_code")), "tcg_date": F.expr("try_cast(nullif(trim(tcg_date), '') AS date)")})


def enriched_names(enriched: DataFrame) -> DataFrame:
    """(card_id, language, name, unofficial) of the documents' names."""
    n = enriched.select(F.col("password").alias("card_id"), F.explode("name").alias("language", "name"), F.col("is_translation_unofficial.name").alias("u"))
    return n.select("card_id", "language", "name", F.coalesce(F.try_element_at("u", F.col("language")), F.lit(False)).alias("unofficial")).filter("name is not null")


def enriched_prints(enriched: DataFrame) -> DataFrame:
    """(card_id, language, set_code, set_name, rarities): null rarities are an empty array."""
    s = enriched.select(F.col("password").alias("card_id"), F.explode("sets").alias("language", "of")).select("card_id", "language", F.explode("of").alias("s"))
    return s.select("card_id", "language", F.col("s.set_number").alias("set_code"), "s.set_name", F.coalesce("s.rarities", F.array().cast("array<string>")).alias("rarities"))


def enrichment(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, ENRICHED)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, name, set_code, passcode, card_back): flat entries are cell 0."""
    t = _json(spark, path, TRUTH)
    flat = t.filter("cells is null").select("file", F.lit(0).alias("cell"), "name", "set_code", F.lit(None).cast("string").alias("passcode"), F.lit(False).alias("card_back"))
    nested = t.select("file", F.posexplode("cells").alias("cell", "c")).select("file", "cell", "c.name", "c.set_code", "c.passcode", F.coalesce("c.card_back", F.lit(False)).alias("card_back"))
    return flat.unionByName(nested)


def backup_csv(spark: SparkSession, path: str) -> DataFrame:
    """A backup: the header must be exact, blank cells are null, a blank source is ``import``."""
    names = [c.split()[0] for c in BACKUP.split(", ")]
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()  # one line
    if head is None or head[0].lstrip("﻿").strip().split(",") != names:
        raise ValueError(f"not a backup: its header is {head and head[0]!r}")
    df = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).schema(BACKUP).csv(path)
    kinds = dict(df.dtypes)
    blank: dict[str, Column] = {c: text.blank_to_null(F.col(c)) for c in names if kinds[c] == "string"}
    return df.withColumns(blank).withColumn("source", F.coalesce("source", F.lit("import")))


def newer(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, decision): ``state`` (name, version, rows) against ``incoming`` (name, version); an empty or unknown catalogue always loads."""
    s = state.select("name", F.col("version").alias("have"), F.col("rows").alias("n"))
    j = incoming.join(s, "name", "left")
    decision = F.when(F.coalesce("n", F.lit(0)) == 0, "load_empty").when(F.col("version").eqNullSafe(F.col("have")), "unchanged").otherwise("load_newer")
    return j.select("name", decision.alias("decision"))


def image_files(spark: SparkSession, folder: str, recursive: bool = False, most: int | None = None) -> DataFrame:
    """(path, size, file_hash, kind) of the images in a folder, in order of their paths, at most ``most``: kind is jpeg, png or null, by the first bytes. Contents are hashed where they are read; they do not travel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.filter(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGES))
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith(MAGIC["jpeg"]), "jpeg").when(head == MAGIC["png"], "png")
    out = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), kind.alias("kind")).orderBy("path")
    return out if most is None else out.limit(most)


def made_readings(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, set_code, language, legible) of documents {file: reading}."""
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.explode(F.from_json("value", READING)).alias("file", "r")).select("file", "r.*")


def raw_lines(images: DataFrame, column: str = "ocr_raw") -> DataFrame:
    """(image_id, region, position, text, confidence, x) of the stored raw text of images (image_id, ``column``); what is no JSON gives nothing."""
    r = images.select("image_id", F.explode(F.from_json(column, RAW_LINES)).alias("region", "lines"))
    return r.select("image_id", "region", F.posexplode("lines").alias("position", "l")).select("image_id", "region", "position", "l.text", "l.confidence", "l.x")
