"""Source divergence audit: how the sources of a language differ in their words, by cubes of (group block, group block, term block).

Tasks count terms by group (language and source) and send sums. A language keeps its frequent terms; a group's profile gives each of them a smoothed integer
share, so that all arithmetic is exact. Groups are dealt to blocks by hash, and so are terms; a slice holds the shares of one group's terms of one block. Each slice is sent to every
cell (block, block, term block) that compares its group block with another, a cell adds up the differences of its pairs over its own terms, and the partial sums of a pair are added along
the term axis. Shares of terms that a group lacks are one number for each group and never travel: a cell adds what its terms change against them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

LEAST_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Groups and terms of a block, on average: a cell holds at most two blocks of groups over one of terms.
BLOCK_GROUPS, BLOCK_TERMS = 64, 4_096
#: Entries that a task counts before it sends their sums.
MOST_ENTRIES = 400_000
#: Letters: ASCII ones in lower case and every byte of other characters; all else separates terms.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8 text, A-Z lower-cased. Longer characters consist of bytes from 128 on, so bytes can be looked at one by one."""
    return text.translate(LETTERS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: occurrences and documents of each group's terms, and one row without term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = [None, *(t.decode() for t in n)]
            cols = [[lang] * len(names), [source] * len(names), names, [0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, COUNTS)], schema=COUNTS)

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(n), terms(text.as_py())
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size > MOST_ENTRIES:
                yield from sums()
                held, size = {}, 0
    yield from sums()


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept))`` in whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.try_divide(wide(F.lit(SCALE)) * wide(n + SMOOTH) - F.pmod(wide(F.lit(SCALE)) * wide(n + SMOOTH), wide(total + SMOOTH * kept)), wide(total + SMOOTH * kept)).cast("long") + 1


def _cell(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of a cell: what its terms change against the two shares of absent terms."""
    lang, i, j, _ = key
    codes, names = pd.factorize(np.concatenate([np.asarray(t, object) for t in pdf["terms"]]))
    none = pdf["none"].to_numpy(np.int64)
    dense = np.repeat(none[:, None], len(names), axis=1)
    rows = np.repeat(np.arange(len(pdf)), [len(t) for t in pdf["terms"]])
    dense[rows, codes] = np.concatenate([np.asarray(s, np.int64) for s in pdf["shares"]])
    block, source = pdf["block"].to_numpy(), pdf["source"].to_numpy()
    out = []
    for a in np.flatnonzero(block == i):
        others = np.flatnonzero(block == j)
        others = others[source[others] > source[a]] if i == j else others
        part = np.abs(dense[others] - dense[a]).sum(1) - len(names) * np.abs(none[others] - none[a])
        out += [(lang, source[a], source[b], int(p)) for b, p in zip(others, part)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "part"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: the divergence of each group from every other one of its language, and the terms it uses more than its language does.

    Null text, language and source count as empty. Repeated rows are documents each. A group without terms has the even profile; a language without frequent terms has divergences of 0.
    Empty input gives an empty table. Other columns are not read, so their names cannot clash.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    sums = docs.select(*read).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = common.written(sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= least_docs)
    kept = common.written(kept.select("lang", "term", "all"), "divergence-terms")
    entries = common.written(counts.filter("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-entries")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total_lang"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source")
    groups = groups.join(groups.groupBy("lang").agg(F.count("*").alias("g")), "lang").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "total", "total_lang"])
    spread = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    groups = groups.withColumns({"group_blocks": blocks("g", BLOCK_GROUPS), "term_blocks": blocks("v", BLOCK_TERMS), "none": F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0))})
    groups = common.written(groups.withColumn("block", spread("source", F.col("group_blocks"))), "divergence-groups")
    few = common.small(groups)
    entries = entries.join(few, ["lang", "source"]).withColumn("share", share(F.col("n"), F.col("total"), F.col("v")))

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = entries.select("lang", "source", F.col("term").alias("item"), (F.col("share") - share(F.col("all"), F.col("total_lang"), F.col("v"))).alias("value")).filter("value > 0")
    top = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)

    place = ["lang", "source", "block", "none", "group_blocks", "term_block"]
    heads = groups.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).select(*place, F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("share"))
    rows = entries.withColumn("term_block", spread("term", F.col("term_blocks"))).select(*place, "term", "share").unionByName(heads)
    held = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "share")))  # at most the terms of a block
    slices = rows.groupBy(*place).agg(held.alias("s")).select(*place, F.col("s.term").alias("terms"), F.col("s.share").alias("shares"))
    sent = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "term_block", "source", "block", "none", "terms", "shares")
    parts = sent.groupBy("lang", "i", "j", "term_block").applyInPandas(_cell, "lang string, a string, b string, part long")
    pairs = common.written(parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part")), "divergence-pairs")
    of = lambda side: few.select("lang", F.col("source").alias(side), F.col("none").alias(f"none_{side}"), *(["v"] if side == "a" else []))
    pairs = pairs.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    pairs = pairs.select("lang", "a", "b", (F.col("part") + F.col("v") * F.abs(F.col("none_a") - F.col("none_b"))).alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    ranked = both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(by_value))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked, "pair").unionByName(columns(top, "term"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, kept.n AS n_lang
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT cells.lang, source, term, n,
    1 + ({SCALE} * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY cells.lang, source) + {SMOOTH} * v) AS p,
    1 + ({SCALE} * (n_lang + {SMOOTH})) // (total + {SMOOTH} * v) AS q
  FROM cells JOIN l ON cells.lang = l.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
