"""Mixing sources to target weights by min-cost flow over overlapping sources.

The same text may stand in several sources: such an item's membership pattern is the set of its sources. Documents are aggregated to patterns, and word capacity
flows from patterns to sources. A pattern's n-th pass over its different words costs n*n more than none, whichever source it is counted for, so that words no source
has used yet are taken first and repetition is spread (convex costs). The flow graph holds patterns and sources only; then seeded hashes pick the documents: per pattern and
source a histogram over hash buckets finds the bucket at which the quota is met, and a running sum inside that one
bucket finds the last hash taken.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 17
#: Bits of a row's place: its text's hash, then its key's, so that equal texts can still be told apart; and those that make a bucket.
TEXT_BITS, KEY_BITS, BUCKET_BITS = 38, 24, 12
#: Overlap patterns that are nodes of their own: those with the most words. The words of rarer ones go to the nodes of their documents' own sources, so none is lost.
MOST_PATTERNS = 2_000


def targets(sizes: dict, weights: dict | None = None, share: float = SHARE, repeats: int = REPEATS) -> dict:
    """Words wanted of each source: ``share`` of all words by weight, at most ``repeats`` times the source's own; the excess is dealt again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    want, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), [s for s in names if weights[s] > 0]
    fixed: dict = {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > repeats * sizes[s]]
        if not over:
            want.update({s: left * weights[s] / total for s in open_})
            break
        for s in over:
            fixed[s] = want[s] = float(repeats * sizes[s])
        left -= sum(fixed[s] for s in over)
        open_ = [s for s in open_ if s not in fixed]
    return want


def passes(words: int, most: int) -> list[tuple[int, int]]:
    """(cost, capacity) of a pattern with ``words`` different words whose documents can give ``most``: one arc for each of the first passes, then for twice as many at a time (their mean cost, rounded up)."""
    out, k, wide = [], 0, 1
    while most > 0 and words > 0:
        out.append((max(out[-1][0] + 1, -(-sum(x * x for x in range(k, k + wide)) // wide)) if out else 0, min(most, words * wide)))
        most -= words * wide
        k += wide
        wide = wide if k < 4 else 2 * wide
    return out


def route(patterns: dict, cells: dict[tuple, int], want: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Min-cost flow: words that each pattern gives to each of its sources.

    ``patterns``: pattern -> its different words; ``cells``: (pattern, source) -> words of its documents there; ``want``: source -> words. Only the passes over a pattern cost,
    so the cheapest flow is a maximum flow over the passes of cost 0, enlarged over those of the next cost, and so on (Dinic's algorithm; the successive shortest paths come in this order).
    """
    pats, srcs = sorted(patterns, key=str), sorted(want, key=lambda s: (s is None, s or ""))
    at = {("p", p): i + 2 for i, p in enumerate(pats)} | {("s", s): i + 2 + len(pats) for i, s in enumerate(srcs)}
    to, cap, out = [], [], [[] for _ in range(len(at) + 2)]

    def arc(u, v, c):
        out[u].append(len(to)), out[v].append(len(to) + 1)
        to.extend((v, u)), cap.extend((c, 0))
        return len(to) - 2

    costs: dict[int, list] = {}
    total = dict.fromkeys(pats, 0)
    for (p, _), n in cells.items():
        total[p] += repeats * n
    for p in pats:
        for cost, c in passes(patterns[p], total[p]):
            costs.setdefault(cost, []).append((at["p", p], c))
    flows = {(p, s): arc(at["p", p], at["s", s], repeats * n) for (p, s), n in sorted(cells.items(), key=str)}
    for s in srcs:
        arc(at["s", s], 1, round(want[s]))

    def enlarge():
        while True:
            level, queue = {0: 0}, deque([0])
            while queue:
                u = queue.popleft()
                for e in out[u]:
                    if cap[e] > 0 and to[e] not in level:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if 1 not in level:
                return
            turn = dict.fromkeys(level, 0)  # the arc of each node that is tried next
            path: list[int] = []
            u = 0
            while True:  # a blocking flow, without recursion
                if u == 1:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, u = [], 0
                while turn[u] < len(out[u]) and not (cap[e := out[u][turn[u]]] > 0 and level.get(to[e]) == level[u] + 1):
                    turn[u] += 1
                if turn[u] < len(out[u]):
                    path.append(e)
                    u = to[e]
                elif path:
                    u = to[path.pop() ^ 1]
                    turn[u] += 1  # this arc leads nowhere
                else:
                    break

    for cost in sorted(costs):
        for v, c in costs[cost]:
            arc(0, v, c)
        enlarge()
    return {k: cap[e ^ 1] for k, e in flows.items()}


def overlaps(df: DataFrame, also: bool) -> DataFrame:
    """(d, shared): digests of texts that stand in several sources (with their ``also``), and these sources as one string. A table of its own, since texts of one source need no look-up."""
    per = df.select("digest", "members") if also else df.select("digest", F.array("source").alias("members"))
    sources = per.select("digest", F.explode("members").alias("s")).select("digest", F.coalesce(F.concat(F.lit("="), "s"), F.lit("-")).alias("s"))
    many = sources.groupBy("digest").agg(F.array_sort(F.collect_set("s")).alias("all")).filter(F.size("all") > 1)  # a set has at most the sources
    return common.written(many.select(F.col("digest").alias("d"), F.to_json("all").alias("shared")), "mix-shared")


def with_pattern(df: DataFrame, many: DataFrame) -> DataFrame:
    """Adds ``own`` (the pattern of a row's source alone) and ``pattern`` (that of all sources in which its text stands)."""
    own = F.to_json(F.array(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    return df.join(common.small(many), F.col("digest") == F.col("d"), "left").withColumn("own", own).withColumn("pattern", F.coalesce("shared", "own")).drop("d", "shared", "members")


def mix(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", key: str = "doc_id", also: str | None = None, weights: dict | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``carry`` columns as struct ``row``, source, size, source_size, target and times (copies taken, 0 to ``REPEATS``); one row per input row.

    Equal texts in several sources overlap; ``also`` names an array column of further sources in which a document's text counts as standing. Null text: size 0, never taken. Null source: a source of
    its own, last in order. Equal rows share a place and are taken alike. Reruns agree: all depends on seed, key and text only.
    Empty input gives an empty table.
    """
    members = [] if also is None else [F.concat(F.array(F.col(source)), F.coalesce(F.col(also), F.array().cast("array<string>"))).alias("members")]
    digest = F.when(F.col(text).isNotNull(), F.md5(F.col(text)))
    df = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(source).alias("source"), digest.alias("digest"), common.word_count(F.col(text)).alias("size"), F.pmod(F.xxhash64(F.lit(seed), F.col(text)), F.lit(1 << TEXT_BITS)).alias("t"), F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << KEY_BITS)).alias("k"), *members)
    # rows that carry their texts are not copied: the sums come from a table without them, and the same expressions run over the documents again
    every, heavy = df, text in carry
    df = common.written(df.drop("row") if heavy else df, "mix")
    spark = docs.sparkSession
    many = overlaps(df, also is not None)
    df = with_pattern(df, many)
    # the patterns with the most words stay; the documents of the others count for their own source's node
    big = df.filter("size > 0 and pattern <> own").groupBy("pattern").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "pattern").limit(MOST_PATTERNS).select(F.col("pattern").alias("big"))
    big = F.broadcast(common.written(big, "mix-patterns"))  # at most MOST_PATTERNS rows
    settled = lambda rows: rows.join(big, F.col("pattern") == F.col("big"), "left").withColumn("pattern", F.coalesce("big", "own")).drop("big", "own")
    df = common.written(settled(df), "mix-members")
    sums = df.groupBy("pattern", "source").agg(F.sum("size").alias("n")).collect()  # at most MOST_PATTERNS times the sources
    once = df.filter("size > 0").groupBy("pattern", "digest").agg(F.max("size").alias("n")).groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # one row per pattern
    sizes: dict = {}
    for r in sums:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    want = targets(sizes, weights, share)
    cells = {(r[0], r[1]): r[2] for r in sums if r[2]}
    flow = route({r[0]: r[1] for r in once}, cells, want)
    # the sources of a pattern take stretches of the hash circle one after another, so that the passes over its texts are spread evenly
    rows, at = [], {}
    for (p, s), n in flow.items():
        whole = min(REPEATS, n // cells[p, s])
        rest = n - whole * cells[p, s]
        rows.append((len(rows), p, s, whole, float(rest), int(at.get(p, 0.0) % 1 * (1 << TEXT_BITS))))
        at[p] = at.get(p, 0.0) + rest / cells[p, s]
    plan = spark.createDataFrame(rows, "cell int, p string, s string, whole int, rest double, shift long")
    same = (F.col("pattern") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(plan), same, "left")  # the cells, as bounded above
        rows = rows.withColumn("h", F.pmod(F.col("t") - F.coalesce("shift", F.lit(0)), F.lit(1 << TEXT_BITS)) * (1 << KEY_BITS) + F.col("k"))
        return rows.withColumn("b", F.shiftright("h", TEXT_BITS + KEY_BITS - BUCKET_BITS).cast("int")).drop("p", "s", "t", "k", "shift")

    df = placed(df)
    # bucket sums: bounded rows per cell, summed on the map side
    up = df.filter("rest > 0").groupBy("cell", "rest", F.col("b").alias("bucket")).agg(F.sum("size").alias("words"))
    up = up.withColumn("up_to", F.sum("words").over(W.partitionBy("cell").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    cut = up.filter("up_to > rest and up_to - words <= rest").select("cell", F.col("bucket").alias("cut"), (F.col("rest") - F.col("up_to") + F.col("words")).alias("room"))
    cut = F.broadcast(common.written(cut, "mix-cut"))  # one row per cell
    inside = df.select("cell", "b", "h", "size").join(cut, "cell").filter("b = cut").groupBy("cell", "cut", "room", "h").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(W.partitionBy("cell").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("up_to", run).filter("up_to - words / 2 <= room").groupBy("cell").agg(F.max("h").alias("last"))
    ends = F.broadcast(common.written(cut.drop("room").join(last, "cell", "left"), "mix-ends"))  # one row per cell
    info = F.broadcast(spark.createDataFrame([(s, sizes[s], want[s]) for s in sizes], "s string, source_size long, target double"))  # one row per source
    out = (placed(settled(with_pattern(every, many))) if heavy else df).join(ends, "cell", "left").join(info, F.col("source").eqNullSafe(F.col("s")), "left")
    taken = F.when(F.col("cut").isNull(), 1).when(F.col("b") < F.col("cut"), 1).when((F.col("b") == F.col("cut")) & (F.col("h") <= F.col("last")), 1).otherwise(0)
    extra = F.when(F.coalesce("rest", F.lit(0.0)) <= 0, 0).otherwise(taken)
    times = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(REPEATS), F.coalesce("whole", F.lit(0)) + extra))
    return out.withColumn("times", times.cast("int")).select("row", "source", "size", "source_size", "target", "times")


def query(spark, sf_dir: str) -> DataFrame:
    df = mix(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return df.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document appears as often as it is taken."""
    df = mix(docs, docs.columns)
    return df.filter("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
