"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Every (language, source) gets its own fences. They come from mergeable quantile sketches: a value falls
in a logarithmic bucket (relative error ``ACCURACY``, the DDSketch of Masson, Rim and Lee 2019) and a sketch is the table
of bucket counts, so merging two sketches is adding counts. The quartiles of a group of n documents are drawn to those of its language with weight
``PRIOR`` / (n + ``PRIOR``), and those of a language to those of all documents alike, so a group's size changes its fences smoothly.
A fence is a quartile widened by ``REACH`` times the distance of the quartiles, and leaves at least ``1 - TAIL`` of the group inside (for measures that are zero for most documents, whose quartiles coincide). A document is kept if it passes the base rules and no measure lies beyond its
group's fences by more than ``SIGMAS`` standard errors of its own count (a Poisson count c of n words or lines has the error sqrt(c) / n; repeated words come by the line, so their count has the error of as many lines), so that one odd line of a short text is no evidence.
No fence has a fixed floor or cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

#: Documents that the prior of a group counts for.
PRIOR = 200
REACH = 3.0
TAIL = 0.1
SIGMAS = 3.0
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: measure -> its count, and what it is counted in. ``LOWER`` ones have a lower fence too.
MEASURES = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
LOWER = ("word_length",)
LEAST = 1e-4


def _repeat_words(w: Column) -> dict[str, Column]:
    """Steps for the number of words covered by 3-word windows that occur twice or more."""
    n = F.size(w)
    zipped = F.arrays_zip(F.slice(w, 1, n - 2).alias("x"), F.slice(w, F.lit(2), n - 2).alias("y"), F.slice(w, F.lit(3), n - 2).alias("z"))
    hashed = F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x["x"], x["y"], x["z"]).alias("h"), i.alias("i")))
    return {"__win": F.when(n >= 3, F.sort_array(hashed))}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(common.WORD))
    df = docs.withColumns({"__w": common.word_array(F.col(text)), "__l": lines})
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, common.SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    } | _repeat_words(F.col("__w"))).drop("__w", "__l")
    win = F.col("__win")
    twice = F.filter(win, lambda x, i: x["h"].eqNullSafe(F.get(win, i - 1)["h"]) | x["h"].eqNullSafe(F.get(win, i + 1)["h"]))
    df = df.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__win")
    at, k = F.col("__at"), F.size("__at")
    steps = F.zip_with(F.slice(at, F.lit(2), k - 1), F.slice(at, F.lit(1), k - 1), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(k > 0, F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(F.lit(0))
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def sketches(df: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, measure, bucket, n) of every measured document that has a word: partial sums before the shuffle."""
    # a row without words may reach these expressions before the filter does: the division gives null then
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.try_divide(F.col(c).cast("double"), F.col(n).cast("double")).alias("value")) for k, (c, n) in MEASURES.items()])
    rows = df.filter("n_words > 0").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
    bucket = F.when(F.col("p.value") < LEAST, F.lit(-100_000)).otherwise(F.ceil(F.log(F.col("p.value")) / F.lit(math.log(GAMMA)))).cast("int")
    return rows.groupBy("lang", "source", F.col("p.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles (1 and 3 quarters; ``TAIL`` and ``1 - TAIL``) of every measure for each group of ``keys``, after merging the sketches by adding counts."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    cum = merged.withColumns({"up_to": F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)), "docs": F.sum("n").over(by)})
    value = F.when(F.col("bucket") == -100_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / F.lit(GAMMA + 1))
    at = lambda share, name: F.min(F.when(F.col("up_to") >= share * F.col("docs"), value)).alias(name)
    return cum.groupBy(*keys, "measure").agg(F.first("docs").alias("docs"), at(0.25, "q1"), at(0.75, "q3"), at(TAIL, "t1"), at(1 - TAIL, "t3"))


def fences(counts: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """One row per (lang, source): a lower and an upper fence for each measure, from quartiles shrunk to the language's and all documents'."""
    own, lang, whole = _quartiles(counts, ["lang", "source"]), _quartiles(counts, ["lang"]), _quartiles(counts, [])
    as_ = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    l, a = as_(lang, "l"), as_(whole, "a")
    df = own.join(l, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(a, F.col("measure") == F.col("a_measure"))

    def drawn(q: str) -> Column:
        wide = (F.col("l_docs") * F.col(f"l_{q}") + prior * F.col(f"a_{q}")) / (F.col("l_docs") + prior)
        return (F.col("docs") * F.col(q) + prior * wide) / (F.col("docs") + prior)

    df = df.select("lang", "source", "measure", *[drawn(q).alias(q) for q in ("q1", "q3", "t1", "t3")])
    df = df.withColumns({"low": F.least(F.col("q1") - reach * (F.col("q3") - F.col("q1")), "t1"), "high": F.greatest(F.col("q3") + reach * (F.col("q3") - F.col("q1")), "t3")})
    cols = [F.max(F.when(F.col("measure") == k, F.col(s))).alias(f"{k}_{s}") for k in MEASURES for s in ("low", "high")]
    return df.groupBy("lang", "source").agg(*cols)


def quality_rules(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``carry`` columns of ``docs`` as struct ``row``, the measures, base_failed and kept; one row per input row.

    Null, empty or blank text: no words, base_failed, not kept. Null language or source: a group of its own. Repeated rows are judged alike
    and counted each time. Empty input gives an empty table. Column names of ``docs`` cannot clash, as ``carry`` travels in a struct.
    """
    # the texts are carried only if asked for
    base = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    df = measured(base).drop("text")
    if text not in carry:  # a copy of all texts is not written: they are measured again instead
        df = common.written(df, "quality")
    counts = common.written(sketches(df.drop("row"), "lang", "source"), "sketches")  # read at three levels
    edges = common.small(common.written(fences(counts), "fences"))
    edges = edges.withColumnsRenamed({"lang": "e_lang", "source": "e_source"})
    df = df.join(edges, F.col("lang").eqNullSafe(F.col("e_lang")) & F.col("source").eqNullSafe(F.col("e_source")), "left")
    beyond = F.lit(False)
    for k, (c, n) in MEASURES.items():
        count, of = F.col(c).cast("double"), F.col(n).cast("double")
        error = SIGMAS * F.sqrt(count * F.try_divide(of, F.col("n_lines").cast("double")) if k == "repeat_share" else count)
        beyond = beyond | F.coalesce(count - error > F.col(f"{k}_high") * of, F.lit(False))
        if k in LOWER:
            beyond = beyond | F.coalesce(count + error < F.col(f"{k}_low") * of, F.lit(False))
    # one sum of both verdicts: as a conjunction, half of a filter on it would go below the measures and bring in their expressions again
    kept = F.col("base_failed").cast("int") + beyond.cast("int") == 0
    return df.withColumn("kept", kept).select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    df = quality_rules(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return df.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, docs.columns).filter("kept").select("row.*")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
o AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM a),
p AS (SELECT k, i, x, lead(x, 1) OVER v AS y, lead(x, 2) OVER v AS z FROM o WINDOW v AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, x, y, z) AS c FROM p WHERE z IS NOT NULL),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY k),
m AS (SELECT a.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM a LEFT JOIN r ON a.k = r.k),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        [{{'measure': 'word_length', 'c': CAST(word_chars AS DOUBLE), 'n': CAST(n_words AS DOUBLE), 'e': CAST(word_chars AS DOUBLE)}}, {{'measure': 'symbol_share', 'c': CAST(n_symbols AS DOUBLE), 'n': CAST(n_words AS DOUBLE), 'e': CAST(n_symbols AS DOUBLE)}},
         {{'measure': 'dup_line_share', 'c': CAST(n_dup_lines AS DOUBLE), 'n': CAST(n_lines AS DOUBLE), 'e': CAST(n_dup_lines AS DOUBLE)}}, {{'measure': 'repeat_share', 'c': CAST(n_repeat_words AS DOUBLE), 'n': CAST(n_words AS DOUBLE), 'e': CAST(n_repeat_words AS DOUBLE) * (CAST(n_words AS DOUBLE) / CAST(n_lines AS DOUBLE))}}] AS ms FROM m),
s AS (SELECT lang, source, u.measure AS measure, CASE WHEN u.c / u.n < {LEAST} THEN -100000 ELSE CAST(ceil(ln(u.c / u.n) / {math.log(GAMMA)!r}) AS INT) END AS bucket, count(*) AS n
      FROM (SELECT lang, source, unnest(ms) AS u FROM x WHERE n_words > 0) GROUP BY ALL),
lev AS (SELECT 0 AS lv, lang, source, measure, bucket, n FROM s UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL
        UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, measure ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY lv, lang, source, measure) AS docs FROM lev),
q AS (SELECT lv, lang, source, measure, any_value(docs) AS docs,
        min(CASE WHEN u >= 0.25 * docs THEN CASE WHEN bucket = -100000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / {GAMMA + 1!r} END END) AS q1, min(CASE WHEN u >= 0.75 * docs THEN CASE WHEN bucket = -100000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / {GAMMA + 1!r} END END) AS q3,
        min(CASE WHEN u >= {TAIL!r} * docs THEN CASE WHEN bucket = -100000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / {GAMMA + 1!r} END END) AS t1, min(CASE WHEN u >= {1 - TAIL!r} * docs THEN CASE WHEN bucket = -100000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / {GAMMA + 1!r} END END) AS t3 FROM c GROUP BY lv, lang, source, measure),
f AS (SELECT o.lang, o.source, o.measure, (o.docs * o.q1 + {PRIOR} * ((l.docs * l.q1 + {PRIOR} * g.q1) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS q1,
        (o.docs * o.q3 + {PRIOR} * ((l.docs * l.q3 + {PRIOR} * g.q3) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS q3,
        (o.docs * o.t1 + {PRIOR} * ((l.docs * l.t1 + {PRIOR} * g.t1) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS t1,
        (o.docs * o.t3 + {PRIOR} * ((l.docs * l.t3 + {PRIOR} * g.t3) / (l.docs + {PRIOR}))) / (o.docs + {PRIOR}) AS t3
      FROM q o JOIN q l ON o.lv = 0 AND l.lv = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN q g ON g.lv = 2 AND g.measure = o.measure),
e AS (SELECT lang, source, measure, least(q1 - {REACH} * (q3 - q1), t1) AS low, greatest(q3 + {REACH} * (q3 - q1), t3) AS high FROM f),
b AS (SELECT y.k, bool_or(y.u.c - {SIGMAS} * sqrt(y.u.e) > e.high * y.u.n OR (y.u.measure = 'word_length' AND y.u.c + {SIGMAS} * sqrt(y.u.e) < e.low * y.u.n)) AS beyond
      FROM (SELECT k, lang, source, unnest(ms) AS u FROM x WHERE n_words > 0) y
      JOIN e ON y.lang IS NOT DISTINCT FROM e.lang AND y.source IS NOT DISTINCT FROM e.source AND y.u.measure = e.measure GROUP BY y.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM x LEFT JOIN b ON x.k = b.k
"""
