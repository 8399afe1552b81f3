"""Queries of filters, search, order, pages and counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import text
from recordlink.operators import collection, lookup, rules, search
from recordlink.plans.catalog_of_queries import _KEYS, _SHOWN, _SV, _shown, _strict, query
from recordlink.plans.more_queries import _OWNED, _owned
from recordlink.sources.views import view

_WANTED = {"type": None, "attribute": "DARK", "race": "Beast", "archetype": " brand#1", "atk_min": 905, "atk_max": 990, "level_min": 5, "defense_max": 500}
_WHERE = "attribute = 'DARK' AND race = 'Beast' AND contains(lower(archetype), 'brand#1') AND atk >= 905 AND atk <= 990 AND level >= 5 AND defense <= 500"


@query("flt_attributes", f"SELECT card_id, name, atk, defense FROM catalogue WHERE {_WHERE}", ("catalogue",))
def flt_attributes(spark, d):
    """Equality, part of the archetype and bounds in one predicate; a null stat passes no bound."""
    return view(spark, d, "catalogue").filter(search.card_filter(**_WANTED)).select("card_id", "name", "atk", "defense")


@query("flt_link", "SELECT card_id, scale, linkval FROM catalogue WHERE linkval BETWEEN 2 AND 4 UNION ALL SELECT card_id, scale, linkval FROM catalogue WHERE scale BETWEEN 3 AND 9", ("catalogue",))
def flt_link(spark, d):
    c = view(spark, d, "catalogue")
    return c.filter(search.card_filter(linkval_min=2, linkval_max=4)).unionByName(c.filter(search.card_filter(scale_min=3, scale_max=9))).select("card_id", "scale", "linkval")


@query("flt_name_part", f"SELECT card_id, name FROM card WHERE contains({_strict('name')}, 'ring')", ("card",))
def flt_name_part(spark, d):
    return view(spark, d, "card").filter(search.item_filter("Ring")).select("card_id", "name")


@query("flt_tolerant", "SELECT o_orderkey, TRY_CAST(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN ' ' || o_custkey || ' ' END) AS INT) AS number FROM orders")
def flt_tolerant(spark, d):
    k = F.col("o_orderkey") % 3
    return view(spark, d, "orders").select("o_orderkey", search.tolerant_int(F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.concat(F.lit(" "), "o_custkey", F.lit(" ")))).alias("number"))


@query("flt_job_results", "SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS place FROM scan_result WHERE job_id % 10 = 7", ("scan_result",))
def flt_job_results(spark, d):
    """Results of some jobs, by the job that made them, in the order of their ids."""
    r = view(spark, d, "scan_result").filter("job_id % 10 = 7")
    return r.select("job_id", "event_id", F.row_number().over(W.partitionBy("job_id").orderBy("event_id")).alias("place"))


@query("col_without_set", f"WITH {_SHOWN} SELECT {_KEYS}, quantity FROM s WHERE print_id IS NULL AND pending_set IS NULL", _SV)
def col_without_set(spark, d):
    return _shown(spark, d).filter(search.item_filter(no_set=True)).select(*collection.KEY, "quantity")


@query("col_without_rarity", f"WITH {_SHOWN} SELECT {_KEYS}, quantity FROM s WHERE CASE WHEN has_print THEN show_rarity IS NULL ELSE pending_set IS NOT NULL AND pending_rarity IS NULL END", _SV)
def col_without_rarity(spark, d):
    return _shown(spark, d).filter(search.item_filter(no_rarity=True)).select(*collection.KEY, "quantity")


@query("agg_count", f"WITH {_SHOWN} SELECT count(*) AS rows_, CAST(sum(quantity) AS BIGINT) AS copies FROM s WHERE contains({_strict('name')}, 'ring') AND set_prefix = 'S0007'", _SV)
def agg_count(spark, d):
    """The count under the predicate of the listing."""
    return _shown(spark, d).filter(search.item_filter("ring", "s0007")).agg(F.count("*").alias("rows_"), F.sum("quantity").alias("copies"))


_ORDER = "card_id NULLS FIRST, print_id NULLS FIRST, pending_set NULLS FIRST, pending_rarity NULLS FIRST, condition NULLS FIRST, edition NULLS FIRST, language NULLS FIRST"


@query("srt_items", f"WITH {_SHOWN} SELECT {_KEYS}, quantity, show_set, place, 3 AS page, greatest(1, CAST(ceil((SELECT count(*) FROM s) / 48.0) AS INT)) AS pages FROM (SELECT *, row_number() OVER (ORDER BY show_set DESC NULLS LAST, {_ORDER}) AS place FROM s) WHERE place BETWEEN 97 AND 144", _SV)
def srt_items(spark, d):
    """The third page of 48 items by set code, last first."""
    return search.page(_shown(spark, d), search.item_order("set", True), 3, 48).select(*collection.KEY, "quantity", "show_set", "place", "page", "pages")


@query("srt_last_page", f"WITH {_SHOWN}, n AS (SELECT CAST(ceil(count(*) / 60.0) AS INT) AS pages FROM s) SELECT {_KEYS}, quantity, place, pages AS page, pages FROM (SELECT *, row_number() OVER (ORDER BY quantity, {_ORDER}) AS place FROM s), n WHERE place > (pages - 1) * 60", _SV)
def srt_last_page(spark, d):
    """A page far beyond the end is the last one."""
    return search.page(_shown(spark, d), search.item_order("quantity"), 10**6, 60, search.item_order("quantity", backwards=True)).select(*collection.KEY, "quantity", "place", "page", "pages")


_JOBS = "jobs AS (SELECT job_id, min(created_at) AS started_at, count(*) AS results FROM scan_result GROUP BY 1)"


def _jobs(spark, d):
    return view(spark, d, "scan_result").groupBy("job_id").agg(F.min("created_at").alias("started_at"), F.count("*").alias("results"))


@query("srt_jobs", f"WITH {_JOBS} SELECT job_id, results, place FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, job_id DESC) AS place FROM jobs) WHERE place <= 20", ("scan_result",))
def srt_jobs(spark, d):
    """The 20 jobs that started last."""
    order = [F.col("started_at").desc(), F.col("job_id").desc()]
    return _jobs(spark, d).orderBy(*order).limit(20).withColumn("place", F.row_number().over(W.orderBy(*order))).select("job_id", "results", "place")


@query("srt_sets", "SELECT set_code, set_name, row_number() OVER (ORDER BY lower(set_name), set_name, set_code) AS place FROM card_set", ("card_set",))
def srt_sets(spark, d):
    return view(spark, d, "card_set").withColumn("place", F.row_number().over(W.orderBy(*search.sort_key(F.col("set_name")), "set_code"))).select("set_code", "set_name", "place")


@query("srt_dashboard", f"""WITH {_SHOWN}, {_JOBS}, a AS (SELECT job_id, row_number() OVER (ORDER BY started_at DESC, job_id DESC) AS place FROM jobs),
n AS (SELECT seq, row_number() OVER (ORDER BY added_at DESC, seq DESC, card_id DESC, CAST(print_id AS STRING) DESC NULLS LAST) AS place FROM delta)
SELECT 'cards' AS part, 1 AS place, count(DISTINCT card_id) AS value FROM s UNION ALL SELECT 'copies', 1, CAST(sum(quantity) AS BIGINT) FROM s UNION ALL SELECT 'queue', 1, count(*) FROM scan_result WHERE decision IN ('pending', 'manual', 'unmatched')
UNION ALL SELECT 'job', place, job_id FROM a WHERE place <= 5 UNION ALL SELECT 'newest', place, seq FROM n WHERE place <= 8""", (*_SV, "scan_result"))
def srt_dashboard(spark, d):
    """Statistics, the queue's size, the five last jobs and the eight newest items."""
    stats = collection.stats(_shown(spark, d)).select(F.explode(F.array(F.struct(F.lit("cards").alias("part"), F.col("cards").alias("value")), F.struct(F.lit("copies").alias("part"), F.col("copies").alias("value")))).alias("x"))
    stats = stats.select("x.part", F.lit(1).alias("place"), "x.value")
    queue = view(spark, d, "scan_result").filter(F.col("decision").isin("pending", "manual", "unmatched")).agg(F.lit("queue").alias("part"), F.lit(1).alias("place"), F.count("*").alias("value"))

    def top(df, order, n, part, value):
        rows = df.orderBy(*order).limit(n)
        return rows.select(F.lit(part).alias("part"), F.row_number().over(W.orderBy(*order)).alias("place"), F.col(value).alias("value"))

    jobs = top(_jobs(spark, d), [F.col("started_at").desc(), F.col("job_id").desc()], 5, "job", "job_id")
    newest = top(view(spark, d, "delta"), [F.col("added_at").desc(), F.col("seq").desc(), F.col("card_id").desc(), F.col("print_id").desc_nulls_last()], 8, "newest", "seq")
    return stats.unionByName(queue).unionByName(jobs).unionByName(newest)


_ASKED = [(1, "ring"), (2, "Steel b"), (3, "17"), (4, " 42 "), (5, "áluminum"), (6, "zzz")]


def _asked(spark):
    return spark.createDataFrame(_ASKED, "query_id int, query string")  # what users typed


def _fts(docs: str, name: str) -> str:
    return f"""{name}x AS (SELECT card_id, dl, token, count(*) AS tf FROM (SELECT card_id, len(t) AS dl, unnest(t) AS token FROM (SELECT card_id, regexp_extract_all(strict, '[a-z0-9]+') AS t FROM {docs})) GROUP BY ALL), {name}n AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT card_id, dl FROM {name}x)),
{name}h AS (SELECT term, prefix, card_id, dl, sum(tf) AS tf FROM {name}x JOIN (SELECT DISTINCT term, prefix FROM ph) p ON CASE WHEN prefix THEN starts_with(token, term) ELSE token = term END GROUP BY ALL), {name}f AS (SELECT term, prefix, count(*) AS df FROM {name}h GROUP BY ALL),
{name}s AS (SELECT query_id, card_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM ph JOIN {name}h USING (term, prefix) JOIN {name}f USING (term, prefix), {name}n GROUP BY ALL),
{name}r AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, card_id) AS rank FROM {name}s)"""


_SEARCH = f"""q AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in _ASKED)}) v(query_id, query)), ph AS (SELECT DISTINCT query_id, t[i] AS term, i = len(t) AND length(t[i]) >= 2 AS prefix FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT query_id, regexp_extract_all({_strict('query')}, '[a-z0-9]+') AS t FROM q))),
en AS (SELECT card_id, {_strict('name')} AS strict FROM catalogue), pt AS (SELECT card_id, {_strict('name')} AS strict FROM alt_name WHERE language = 'PT'), {_fts('en', 'e_')}, {_fts('pt', 'p_')},
every AS (SELECT query_id, card_id, 0 AS k, 1 AS rank FROM q JOIN catalogue ON regexp_matches(trim(query), '^[0-9]+$') AND CAST(card_id AS STRING) = trim(query) UNION ALL SELECT query_id, card_id, 1, rank FROM e_r UNION ALL SELECT query_id, card_id, 2, rank FROM p_r),
found AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY k, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, card_id ORDER BY k, rank) AS o FROM every) WHERE o = 1),
kept AS (SELECT query_id, f.card_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM found f JOIN catalogue c ON c.card_id = f.card_id AND c.level >= 10)"""


def _searched(spark, d, **more):
    return search.search_cards(_asked(spark), view(spark, d, "catalogue"), view(spark, d, "alt_name"), view(spark, d, "card_print"), "PT", search.card_filter(level_min=10), **more)


@query("srt_search", f"WITH {_SEARCH} SELECT * FROM kept WHERE place BETWEEN 6 AND 25", ("catalogue", "alt_name"))
def srt_search(spark, d):
    """Search by id, English and Portuguese names, filtered, then a page of 20 from the sixth on."""
    return _searched(spark, d, limit=20, offset=5)


@query("agg_search", f"WITH {_SEARCH} SELECT query_id, count(DISTINCT card_id) AS cards FROM kept GROUP BY 1", ("catalogue", "alt_name"))
def agg_search(spark, d):
    """How many different cards a search with filters finds."""
    return _searched(spark, d, limit=2**31 - 1).groupBy("query_id").agg(F.countDistinct("card_id").alias("cards"))


@query("agg_facet_values", " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, row_number() OVER (ORDER BY {c}) AS place FROM (SELECT DISTINCT {c} FROM catalogue WHERE {c} IS NOT NULL)" for c in search.EQUAL), ("catalogue",))
def agg_facet_values(spark, d):
    return search.facets(view(spark, d, "catalogue"))


@query("agg_profile", "SELECT 'rows:card' AS name, CAST(count(*) AS STRING) AS value FROM card UNION ALL SELECT 'rows:card_print', CAST(count(*) AS STRING) FROM card_print UNION ALL SELECT 'rows:card_set', CAST(count(*) AS STRING) FROM card_set UNION ALL SELECT 'copies', CAST(CAST(sum(quantity) AS BIGINT) AS STRING) FROM delta UNION ALL SELECT 'state:' || r_name, CAST(r_regionkey AS STRING) FROM region", ("card", "card_print", "card_set", "delta"))
def agg_profile(spark, d):
    state = view(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("value"))
    return search.profile({n: view(spark, d, n) for n in ("card", "card_print", "card_set")}, view(spark, d, "delta"), state)


@query("agg_rarities", "SELECT card_id, set_prefix, array_to_string(list_sort(list(DISTINCT rarity)), '|') AS rarities FROM card_print WHERE rarity IS NOT NULL GROUP BY 1, 2", ("card_print",))
def agg_rarities(spark, d):
    """The rarities catalogued for a card in a set."""
    return view(spark, d, "card_print").groupBy("card_id", "set_prefix").agg(F.array_join(F.array_sort(F.collect_set("rarity")), "|").alias("rarities"))


@query("prj_localised", "SELECT c.card_id, coalesce(a.name, c.name) AS name, CASE WHEN trim(a.description) <> '' THEN a.description ELSE c.description END AS description, a.name IS NOT NULL AS is_translated FROM catalogue c LEFT JOIN alt_text a ON a.card_id = c.card_id AND a.language = 'PT'", ("catalogue", "alt_text"))
def prj_localised(spark, d):
    return search.localised(view(spark, d, "catalogue").select("card_id", "name", "description"), view(spark, d, "alt_text"), "PT")


@query("fun_languages", """SELECT doc_id, CASE WHEN upper(trim(l)) IN ('EN', 'PT', 'FR', 'DE', 'IT', 'JA', 'KO') THEN upper(trim(l)) ELSE 'EN' END AS shown, CASE WHEN regexp_matches(l, '^[A-Z]{2,3}$') THEN l ELSE 'EN' END AS stored, CASE lower(trim(l)) WHEN 'pt_br' THEN 'PT' ELSE 'EN' END AS of_ui
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' || lang WHEN 2 THEN 'PT_BR' WHEN 3 THEN 'P' ELSE lang END AS l FROM documents)""")
def fun_languages(spark, d):
    k, lang = F.col("doc_id") % 5, F.col("lang")
    x = view(spark, d, "documents").select("doc_id", F.when(k == 0, F.upper(lang)).when(k == 1, F.concat(F.lit(" "), lang)).when(k == 2, "PT_BR").when(k == 3, "P").otherwise(lang).alias("l"))
    return x.select("doc_id", search.display_language(F.col("l")).alias("shown"), search.stored_language(F.col("l")).alias("stored"), search.language_of_ui(F.col("l")).alias("of_ui"))


@query("fun_layout", "SELECT card_id, CASE WHEN ok THEN CAST(regexp_extract(t, '^([0-9]+)', 1) AS INT) END AS rows_, CASE WHEN ok THEN CAST(regexp_extract(t, '([0-9]+)$', 1) AS INT) END AS cols FROM (SELECT *, coalesce(regexp_matches(t, '^[1-9][0-9]?x[1-9][0-9]?$'), false) AS ok FROM (SELECT card_id, lower(trim(CASE WHEN card_id % 4 = 0 THEN level || 'by3' ELSE ' ' || level || 'X' || (card_id % 7) END)) AS t FROM card))", ("card",))
def fun_layout(spark, d):
    t = F.when(F.col("card_id") % 4 == 0, F.concat("level", F.lit("by3"))).otherwise(F.concat(F.lit(" "), "level", F.lit("X"), F.col("card_id") % 7))
    return view(spark, d, "card").select("card_id", text.grid_layout(t).alias("g")).select("card_id", F.col("g.rows").alias("rows_"), "g.cols")


@query("chk_pool", f"WITH {_OWNED}, p AS (SELECT card_id, name, row_number() OVER (ORDER BY lower(name), name, card_id) AS place FROM catalogue WHERE card_id IN (SELECT card_id FROM w) AND level >= 10 AND frame_type = 'link') SELECT card_id, name, place, 2 AS page, greatest(1, CAST(ceil((SELECT count(*) FROM p) / 9.0) AS INT)) AS pages FROM p WHERE place BETWEEN 10 AND 18", ("catalogue", "delta"))
def chk_pool(spark, d):
    """Owned cards that a search with filters offers for a list: each card once, however many items it has, and then the second page of nine."""
    items = view(spark, d, "delta").join(view(spark, d, "catalogue"), "card_id").filter(search.card_filter(level_min=10) & (F.col("frame_type") == "link"))
    return search.page(lookup.pool(items), [*search.sort_key(F.col("name")), F.col("card_id")], 2, 9).select("card_id", "name", "place", "page", "pages")


@query("chk_issues", """WITH p AS (SELECT deck_id, card_id, sum(quantity) AS q, sum(CASE WHEN zone = 'main' THEN quantity ELSE 0 END) AS m, sum(CASE WHEN zone = 'extra' THEN quantity ELSE 0 END) AS e, sum(CASE WHEN zone = 'side' THEN quantity ELSE 0 END) AS s FROM deck_card GROUP BY 1, 2),
g AS (SELECT deck_id, sum(m) AS m, sum(e) AS e, sum(s) AS s, array_to_string(list(p.card_id || ':' || CAST(q AS BIGINT) ORDER BY p.card_id) FILTER (q > CASE ban_tcg WHEN 'Forbidden' THEN 0 WHEN 'Limited' THEN 1 WHEN 'Semi-Limited' THEN 2 ELSE 3 END), ',') AS over FROM p JOIN card ON card.card_id = p.card_id GROUP BY 1)
SELECT deck_id, concat_ws('; ', CASE WHEN m < 40 THEN 'main below 40' END, CASE WHEN m > 60 THEN 'main above 60' END, CASE WHEN e > 15 THEN 'extra above 15' END, CASE WHEN s > 15 THEN 'side above 15' END, CASE WHEN over <> '' THEN 'copies ' || over END) AS issues FROM g""", ("deck_card", "card"))
def chk_issues(spark, d):
    """What is wrong with each list."""
    return rules.deck_issues(view(spark, d, "deck_card"), view(spark, d, "card")).select("deck_id", F.array_join("issues", "; ").alias("issues"))
