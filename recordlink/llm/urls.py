"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

A url is expanded only into the expressions whose shape (number of host labels, path length) some rule has, which loses nothing.
Expressions and rules meet in an equi-join on the first ``PREFIX`` hex digits of SHA-256; the full digest confirms a hit, and
the longest rule wins (at equal length: block before allow, then the smaller rule text). Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm import common

PREFIX = 8
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Null url or one without ``://``: both empty. Host: A-Z lower-cased, with port and user if written."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge(urls: DataFrame, rules: DataFrame, carry: list[str], url: str = "url") -> DataFrame:
    """``carry`` columns of ``urls`` as struct ``row``, host, path, rule (null if none fits) and verdict; one row per input row.

    Null and empty urls and those without a host fit no rule. Rules with a null or empty host or a null path fit nothing; of equal rules with two verdicts block wins. Empty rules: all get ``DEFAULT``.
    Repeated rows are judged alike; empty input gives an empty table. Columns of ``urls`` may have any name, as ``carry`` travels in a struct.
    One very frequent host or url costs one row: (host, path) pairs are made distinct, with partial aggregation, before the expansion. Urls without a host, however many, take no part in a join.
    """
    host, path = split_url(F.col(url))
    urls = urls.select(F.struct(*[F.col(c) for c in carry]).alias("row"), host.alias("host"), path.alias("path"))
    rules = rules.filter("rule_host <> '' and rule_path is not null").withColumns({"text": F.concat("rule_host", "rule_path"), "labels": F.size(F.split("rule_host", r"\.", -1)), "chars": F.length("rule_path")})
    shapes = rules.groupBy().agg(F.collect_set(F.struct("labels", "chars")).alias("shapes"))  # at most labels x path lengths
    pairs = urls.filter("host <> ''").select("host", "path").distinct()
    parts = pairs.crossJoin(F.broadcast(shapes)).withColumns({"parts": F.split("host", r"\.", -1), "length": F.length("path")})  # one row of shapes
    wanted = parts.select("host", "path", "parts", F.explode("shapes").alias("s"), "length").filter((F.size("parts") >= F.col("s.labels")) & (F.col("length") >= F.col("s.chars")))
    suffix = F.array_join(F.slice("parts", F.size("parts") - F.col("s.labels") + 1, F.col("s.labels")), ".")
    wanted = wanted.withColumn("digest", F.sha2(F.concat(suffix, F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("s.chars"))), 256))
    keyed = rules.select(F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"), "text", "rule_verdict")
    short = lambda c: F.substring(c, 1, PREFIX)
    hits = wanted.withColumn("short", short("digest")).join(keyed.withColumn("short", short("rule_digest")), "short").filter("digest = rule_digest")
    rank = F.struct(F.length("text"), (F.col("rule_verdict") == "block").cast("int"), F.translate(F.hex(F.encode("text", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"))
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max_by(F.struct("text", "rule_verdict"), rank).alias("best"))
    hosted = urls.filter("host <> ''").join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")
    bare = urls.filter("host = ''").withColumn("best", F.lit(None).cast(hosted.schema["best"].dataType))
    return hosted.union(bare).select("row", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(DEFAULT)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), rule_table(spark), ["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH r(h, p, v) AS (VALUES {_VALUES}),
a AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS h0 FROM a),
u AS (SELECT k, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h0) + 1), '^([^?#]*)', 1) AS path FROM b),
m AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, v DESC, h || p) AS n
      FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, m.rule, coalesce(m.v, '{DEFAULT}') AS verdict FROM u LEFT JOIN m ON u.k = m.k AND m.n = 1
"""
