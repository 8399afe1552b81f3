"""Queries of catalogue loads, merges, enrichment, restore and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlink.operators import catalogue, collection, exports, rules
from recordlink.plans.catalog_of_queries import _KEYS, _OLD, _ON, _SHOWN, _SV, _shown, _target, query
from recordlink.sources.views import view

_RAW = """raw AS (SELECT l_partkey AS card_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_orderkey % 13 = 0 THEN 'jump' WHEN l_orderkey % 17 = 0 THEN ' ' ELSE concat(' s', lpad(CAST(l_suppkey * (CASE WHEN l_orderkey % 5 = 0 THEN 7 ELSE 1 END) AS STRING), 4, '0'), '-en', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')) END AS set_code,
 CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS rarity, CASE WHEN l_orderkey % 4 = 0 THEN '' WHEN l_orderkey % 4 = 1 THEN 'n/a' ELSE CAST(l_linenumber AS STRING) || '.25' END AS price FROM lineitem),
k AS (SELECT *, upper(trim(set_code)) AS c, row_number() OVER (PARTITION BY card_id, upper(trim(set_code)), coalesce(rarity, '') ORDER BY pos, set_code) AS o FROM raw WHERE trim(set_code) <> ''),
pr AS (SELECT card_id, c AS set_code_full, s.set_code AS set_prefix, rarity, CASE WHEN c <> 'JUMP' THEN 'EN' END AS region, CASE WHEN c <> 'JUMP' THEN right(c, 3) END AS number, TRY_CAST(nullif(price, '') AS DOUBLE) AS price, c <> 'JUMP' AS parsed FROM k LEFT JOIN card_set s ON s.set_code = regexp_extract(c, '^(S[0-9]+)-', 1) WHERE o = 1)"""


def _raw(spark, d):
    o = F.col("l_orderkey")
    number = F.lpad((F.col("l_suppkey") * F.when(o % 5 == 0, 7).otherwise(1)).cast("string"), 4, "0")
    code = F.when(o % 13 == 0, "jump").when(o % 17 == 0, " ").otherwise(F.concat(F.lit(" s"), number, F.lit("-en"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")))
    price = F.when(o % 4 == 0, "").when(o % 4 == 1, "n/a").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".25")))
    return view(spark, d, "lineitem").select(F.col("l_partkey").alias("card_id"), (o * 10 + F.col("l_linenumber")).alias("pos"), code.alias("set_code"), F.lit("x").alias("set_name"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("rarity"), price.alias("price"))


#: Sets whose codes are equal (numbers of five digits and more are cut to four) give a print one row.
_RAW_ONCE = _RAW.replace("LEFT JOIN card_set s ON", "LEFT JOIN (SELECT DISTINCT set_code FROM card_set) s ON")


@query("prj_prints", f"WITH {_RAW_ONCE} SELECT card_id, set_code_full, set_prefix, rarity, region, number, parsed FROM pr", ("card_set",))
def prj_prints(spark, d):
    """Raw print codes to rows: blanks dropped, repeats in a card once, unknown prefixes null, unreadable codes kept as text."""
    return catalogue.print_rows(_raw(spark, d), view(spark, d, "card_set")).select("card_id", "set_code_full", "set_prefix", "rarity", "region", "number", "parsed")


_MORE = "nw AS (SELECT set_code, CASE WHEN CAST(substr(set_code, 2) AS INT) % 3 = 0 THEN upper(set_name) || '!' ELSE set_name END AS set_name FROM card_set WHERE CAST(substr(set_code, 2) AS INT) % 4 <> 1 UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation), ol AS (SELECT set_code, set_name, 'path/' || set_code AS cached FROM card_set WHERE CAST(substr(set_code, 2) AS INT) % 5 <> 2)"


def _sets(spark, d):
    s = view(spark, d, "card_set").withColumn("n", F.substring("set_code", 2, 9).cast("int"))
    new = s.filter("n % 4 <> 1").select("set_code", F.when(F.col("n") % 3 == 0, F.concat(F.upper("set_name"), F.lit("!"))).otherwise(F.col("set_name")).alias("set_name"), F.lit(None).cast("string").alias("cached"))
    new = new.unionByName(view(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("set_code"), F.col("n_name").alias("set_name"), F.lit(None).cast("string").alias("cached")))
    return catalogue.merged(s.filter("n % 5 <> 2").select("set_code", "set_name", F.concat(F.lit("path/"), "set_code").alias("cached")), new, ["set_code"], ["set_name", "cached"], ("cached",))


@query("ups_catalogue", f"WITH {_MORE} SELECT coalesce(o.set_code, n.set_code) AS set_code, CASE WHEN n.set_code IS NULL THEN o.set_name ELSE n.set_name END AS set_name, cached, CASE WHEN o.set_code IS NULL THEN 'insert' WHEN n.set_code IS NULL THEN 'stale' WHEN o.set_name = n.set_name THEN 'same' ELSE 'update' END AS action FROM ol o FULL JOIN nw n ON n.set_code = o.set_code", ("card_set",))
def ups_catalogue(spark, d):
    """A load of sets over the ones that are there: nothing is deleted, cached paths stay."""
    return _sets(spark, d)


@query("agg_import", f"WITH {_MORE}, {_RAW}, j AS (SELECT CASE WHEN o.set_code IS NULL THEN 'insert' WHEN n.set_code IS NULL THEN 'stale' WHEN o.set_name = n.set_name THEN 'same' ELSE 'update' END AS action FROM ol o FULL JOIN nw n ON n.set_code = o.set_code) SELECT 'sets' AS kind, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'stale') AS stale, (SELECT count(DISTINCT set_code_full) FROM pr WHERE NOT parsed) AS codes, (SELECT min(set_code_full) FROM pr WHERE NOT parsed) AS sample FROM j", ("card_set",))
def agg_import(spark, d):
    """What a load did, with a sample of the codes it could not read."""
    bad = catalogue.unparsed_sample(catalogue.print_rows(_raw(spark, d), view(spark, d, "card_set"))).select("codes", F.array_join("sample", ",").alias("sample"))
    return catalogue.import_report({"sets": _sets(spark, d)}).crossJoin(bad)


_DOCS = """doc AS (SELECT p_partkey + 60 AS card_id, p_name AS name, p_partkey % 7 AS k, p_brand AS brand FROM part), nm AS (SELECT card_id, l AS language, CASE WHEN k = 3 AND l = 'it' THEN '' ELSE name || ' ' || l END AS name, k = 5 AND l = 'fr' AS unofficial FROM doc, (VALUES ('fr'), ('de'), ('it'), ('pt'), ('en'), ('hr')) v(l) WHERE card_id IN (SELECT card_id FROM card)),
ex AS (SELECT card_id, language, name, CASE WHEN card_id % 2 = 0 THEN 'primary' ELSE 'enrichment' END AS source FROM alt_name), go AS (SELECT card_id, upper(language) AS language, name FROM nm WHERE language NOT IN ('en', 'hr') AND name <> '' AND NOT unofficial AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.card_id = nm.card_id AND ex.language = upper(nm.language) AND ex.source = 'primary'))"""


def _documents(spark, d):
    k = F.col("k")
    doc = view(spark, d, "part").select((F.col("p_partkey") + 60).alias("card_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("k"), "p_brand")
    names = doc.select("card_id", "k", "name", F.explode(F.array(*map(F.lit, ("fr", "de", "it", "pt", "en", "hr")))).alias("language"))
    return names.select("card_id", "language", F.when((k == 3) & (F.col("language") == "it"), "").otherwise(F.concat_ws(" ", "name", "language")).alias("name"), ((k == 5) & (F.col("language") == "fr")).alias("unofficial"))


def _sourced(spark, d):
    return view(spark, d, "alt_name").withColumn("source", F.when(F.col("card_id") % 2 == 0, catalogue.PRIMARY).otherwise(catalogue.ENRICHED))


@query("ups_enrich_names", f"WITH {_DOCS} SELECT coalesce(ex.card_id, go.card_id) AS card_id, coalesce(ex.language, go.language) AS language, coalesce(go.name, ex.name) AS name, CASE WHEN go.card_id IS NOT NULL THEN 'enrichment' ELSE ex.source END AS source, CASE WHEN ex.card_id IS NULL THEN 'insert' WHEN go.card_id IS NULL THEN 'stale' WHEN ex.name = go.name THEN 'same' ELSE 'update' END AS action FROM ex FULL JOIN go ON ex.card_id = go.card_id AND ex.language = go.language", ("card", "alt_name"))
def ups_enrich_names(spark, d):
    """Names of an enrichment: only known cards, no unofficial ones, none over the primary source's."""
    known, _ = catalogue.known_cards(_documents(spark, d), view(spark, d, "card"))
    return catalogue.enriched_names(_sourced(spark, d), known)


@query("jon_enriched", "WITH d AS (SELECT p_partkey + 60 AS card_id FROM part, range(6)) SELECT count(*) FILTER (card_id IN (SELECT card_id FROM card)) AS matched, count(*) FILTER (card_id NOT IN (SELECT card_id FROM card)) AS unmatched FROM d", ("card",))
def jon_enriched(spark, d):
    return catalogue.known_cards(_documents(spark, d), view(spark, d, "card"))[1]


_PRINTS = """rw AS (SELECT l_partkey AS card_id, CASE l_linenumber % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'xx' END AS language, concat('q', lpad(CAST(l_suppkey % 20 AS STRING), 3, '0'), '-de', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')) AS set_code, CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN ['R', 'R'] ELSE ['C', l_returnflag] END AS rarities FROM lineitem),
nw AS (SELECT card_id, upper(set_code) AS set_code_full, rarity, min(CASE language WHEN 'de' THEN 'DE' ELSE 'FR' END) AS region FROM (SELECT card_id, language, set_code, unnest(coalesce(rarities, [NULL])) AS rarity FROM rw) WHERE language <> 'xx' GROUP BY 1, 2, 3),
ex AS (SELECT card_id, set_code_full, rarity, 'XX' AS region, CASE WHEN card_id % 3 = 0 THEN 'primary' ELSE 'enrichment' END AS source FROM nw WHERE card_id % 3 <> 2),
go AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.card_id = nw.card_id AND ex.set_code_full = nw.set_code_full AND coalesce(ex.rarity, '') = coalesce(nw.rarity, '') AND source = 'primary'))"""


def _enriched_prints(spark, d):
    o, n = F.col("l_orderkey") % 4, F.col("l_linenumber") % 3
    code = F.concat(F.lit("q"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0"), F.lit("-de"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))
    rw = view(spark, d, "lineitem").select(F.col("l_partkey").alias("card_id"), F.when(n == 0, "de").when(n == 1, "fr").otherwise("xx").alias("language"), code.alias("set_code"), F.concat(F.lit("Set "), F.col("l_suppkey") % 20).alias("set_name"), F.when(o == 1, F.array(F.lit("R"), F.lit("R"))).when(o > 1, F.array(F.lit("C"), F.col("l_returnflag"))).alias("rarities"))
    keys = rw.filter("language <> 'xx'").select("card_id", F.upper("set_code").alias("set_code_full"), F.explode_outer("rarities").alias("rarity")).distinct()
    ex = keys.filter("card_id % 3 <> 2").select("card_id", "set_code_full", "rarity", F.lit("XX").alias("region"), F.when(F.col("card_id") % 3 == 0, catalogue.PRIMARY).otherwise(catalogue.ENRICHED).alias("source"))
    return catalogue.enriched_prints(ex, rw, view(spark, d, "card_set"))


@query("ups_enrich_prints", f"WITH {_PRINTS} SELECT coalesce(ex.card_id, go.card_id) AS card_id, coalesce(ex.set_code_full, go.set_code_full) AS set_code_full, CASE WHEN ex.card_id IS NULL THEN go.rarity ELSE ex.rarity END AS rarity, coalesce(go.region, ex.region) AS region, CASE WHEN go.card_id IS NOT NULL THEN 'enrichment' ELSE ex.source END AS source, CASE WHEN ex.card_id IS NULL THEN 'insert' WHEN go.card_id IS NULL THEN 'stale' ELSE 'update' END AS action FROM ex FULL JOIN go ON ex.card_id = go.card_id AND ex.set_code_full = go.set_code_full AND ex.rarity IS NOT DISTINCT FROM go.rarity")
def ups_enrich_prints(spark, d):
    return _enriched_prints(spark, d)[0]


@query("ups_enrich_sets", f"WITH {_PRINTS} SELECT DISTINCT split_part(set_code_full, '-', 1) AS set_code, 'Set ' || CAST(substr(split_part(set_code_full, '-', 1), 2) AS INT) AS set_name FROM nw WHERE split_part(set_code_full, '-', 1) NOT IN (SELECT set_code FROM card_set)", ("card_set",))
def ups_enrich_sets(spark, d):
    return _enriched_prints(spark, d)[1]


@query("ups_restore", f"""WITH {_SHOWN}, o AS (SELECT {_KEYS}, sum(quantity) AS q FROM delta WHERE batch < 2 GROUP BY ALL), n AS (SELECT card_id, print_id, CASE WHEN print_id IS NULL THEN show_set END AS pending_set, CASE WHEN print_id IS NULL THEN show_rarity END AS pending_rarity, condition, edition, language, sum(quantity) AS q FROM s GROUP BY ALL)
SELECT {', '.join(f'coalesce(o.{k}, n.{k}) AS {k}' for k in collection.KEY)}, CAST(coalesce(o.q, 0) + coalesce(n.q, 0) AS BIGINT) AS quantity, CASE WHEN o.card_id IS NULL THEN 'created' WHEN n.card_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN n ON {_ON}""", _SV)
def ups_restore(spark, d):
    """A backup of the whole collection added to a part of it."""
    return catalogue.restored(_target(spark, d), exports.backup(_shown(spark, d)))


@query("dq_vocabulary", """SELECT 'condition' AS rule, count(*) FILTER (condition IS NULL OR condition NOT IN ('F', 'O')) AS violations FROM delta UNION ALL SELECT 'language', count(*) FILTER (NOT regexp_matches(language, '^[A-Z]{2,3}$')) FROM delta UNION ALL SELECT 'quantity', count(*) FILTER (quantity <= 10) FROM delta
UNION ALL SELECT 'ban', count(*) FILTER (ban_tcg NOT IN ('Forbidden', 'Limited')) FROM card UNION ALL SELECT 'unique', count(*) FROM (SELECT card_id, print_id, pending_set, condition FROM delta GROUP BY ALL HAVING count(*) > 1)""", ("delta", "card"))
def dq_vocabulary(spark, d):
    """Closed vocabularies, formats, bounds, and a key where null equals null."""
    x, c = view(spark, d, "delta"), view(spark, d, "card")
    found = rules.violations(x, {"condition": ~F.coalesce(F.col("condition").isin("F", "O"), F.lit(False)), "language": ~F.col("language").rlike("^[A-Z]{2,3}$"), "quantity": F.col("quantity") <= 10})
    return found.unionByName(rules.violations(c, {"ban": ~F.col("ban_tcg").isin("Forbidden", "Limited")})).unionByName(rules.repeated_keys(x, ["card_id", "print_id", "pending_set", "condition"], "unique"))


@query("dq_translation", "SELECT a.card_id, a.language, a.name_en, c.name FROM alt_text a JOIN card c ON c.card_id = a.card_id WHERE a.name_en IS DISTINCT FROM c.name", ("alt_text", "card"))
def dq_translation(spark, d):
    """Translations whose English name is not the card's."""
    return rules.wrong_translations(view(spark, d, "alt_text"), view(spark, d, "card"))


_FIRST = "arg_min(source, seq) AS source, arg_min(notes, seq) FILTER (notes <> '') AS notes, min(added_at) AS added_at"
_FIRSTS = f"""a AS (SELECT {_KEYS}, sum(quantity) AS q, {_FIRST} FROM delta WHERE batch < 2 GROUP BY ALL), b AS (SELECT {_KEYS}, sum(quantity) AS q, {_FIRST} FROM delta WHERE batch = 2 GROUP BY ALL)"""


@query(
    "ups_add_carried",
    f"""WITH {_FIRSTS}
SELECT {', '.join(f'coalesce(o.{k}, n.{k}) AS {k}' for k in collection.KEY)}, CAST(coalesce(o.q, 0) + coalesce(n.q, 0) AS BIGINT) AS quantity,
  coalesce(o.source, n.source) AS source, coalesce(o.notes, n.notes) AS notes, least(o.added_at, n.added_at) AS added_at,
  CASE WHEN o.card_id IS NULL THEN 'created' WHEN n.card_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM a o FULL JOIN b n ON {_ON}""",
    ("delta",),
)
def ups_add_carried(spark, d):
    """Copies added to items that keep their first source, and their notes unless they are empty."""
    deltas = view(spark, d, "delta")
    return collection.add(collection.items(deltas.filter("batch < 2")), deltas.filter("batch = 2"), "seq")


_ITEM_ID = ", ".join(f"coalesce(CAST(s.{k} AS STRING), '~')" for k in collection.KEY)


@query(
    "snk_backup_carried",
    f"""WITH {_SHOWN}, f AS (SELECT {_KEYS}, {_FIRST} FROM delta GROUP BY ALL)
SELECT md5(concat_ws('|', {_ITEM_ID})) AS item_id, s.card_id, name AS card_name, s.print_id AS card_print_id, show_set AS set_code_full, set_prefix,
  CASE WHEN has_print THEN substr(split_part(show_set, '-', 2), 1, 2) END AS region, show_rarity AS rarity, quantity, s.condition, s.edition, s.language, source, added_at, notes
FROM s JOIN f ON {' AND '.join(f's.{k} IS NOT DISTINCT FROM f.{k}' for k in collection.KEY)}""",
    _SV,
)
def snk_backup_carried(spark, d):
    """The backup with edition, source, time and notes of every item."""
    every = collection.items(view(spark, d, "delta"))
    return exports.profile("csv", "backup")(collection.listing(every, view(spark, d, "card"), view(spark, d, "card_print")))


@query("ups_restore_empty", f"SELECT {_KEYS}, CAST(sum(quantity) AS BIGINT) AS quantity, {_FIRST} FROM delta GROUP BY ALL", ("delta",))
def ups_restore_empty(spark, d):
    """A backup that is read into an empty collection gives the same collection again."""
    every = collection.items(view(spark, d, "delta"))
    saved = exports.backup(collection.listing(every, view(spark, d, "card"), collection.one_per_id(view(spark, d, "card_print"))))
    return catalogue.restored(every.limit(0), saved).drop("action")
