"""N-gram Jaccard self-join with multiple global token orders.

Texts become sets of distinct five-word shingles (64-bit hashes). Equal sets form a class, and classes are joined:

1. A count sketch of fixed size estimates document frequencies; it only defines an order, so an estimate never changes the result.
2. Order one sorts a set's tokens by frequency, then hash. Two sets with Jaccard >= 0.8 share a token among the first ``n - ceil(0.8 n) + 1``
   of each, under every global order. Prefix tokens of order one are the join key.
3. Star rounds: within a token's bucket the members meet one pivot only, and pivots repeat between buckets. Each class first meets one pivot, then the others that are still in another
   component, so a group of k near copies gives about k pairs. A bucket of a token that is frequent even so is salted, and the pivots of its parts meet in turn.
4. Cross round: members of a bucket that are still in different components meet each other. With this no link between components is lost.
5. A pair must pass the length bound, the bitmap bound (parities of 512 hash buckets; Sandes et al. 2020), shared prefix tokens under
   orders two and three, and at last the exact intersection. All bounds are necessary conditions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

SHINGLE = 5
#: Similarity as a fraction NUM / DEN.
NUM, DEN = 80, 100
SKETCH_BITS, BLOCK = 20, 2048
#: Members of a bucket's part, as estimated; more frequent tokens are salted.
HOT = 4096
#: Rows of (class, id), 16 bytes each, that may be broadcast to pick candidates' texts; more go through a shuffle join.
MOST_BROADCAST = 1_000_000
#: Shingles that a task keeps while it compares texts, 32 MB; beyond that they are made again.
MEMO_TOKENS = 4_000_000
BITS = [f"b{i}" for i in range(8)]
#: Seed of the second key of a set, by which two sets of one class key are noticed.
SECOND = 77
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another pseudo-random permutation of 64-bit values for each salt."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_SEG = 1 << 20  # bytes of a text that are hashed at once
_rng = np.random.Generator(np.random.PCG64(20_26))
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(_SEG, base, np.uint64)], dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts: a polynomial in the bytes, A-Z as a-z, from prefix sums modulo 2**64; words of over half a segment by xxhash."""
    b = np.frombuffer(raw, np.uint8)
    word = np.concatenate(([False], ~_GAP[b], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(ends.searchsorted(base + _SEG, "right")))
            if ends[lo] - base > _SEG // 2:
                out[lo] = xxhash.xxh64_intdigest(raw[base : ends[lo]].lower())
                lo += 1
                continue
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b[base : ends[hi - 1]]] * _UP[: ends[hi - 1] - base], dtype=np.uint64)))
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mixed((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64), 3)
            for i in np.flatnonzero(e - s > _SEG // 2) + lo:
                out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].lower())
            lo = hi
    return out, starts


def _rolled(w: np.ndarray) -> np.ndarray:
    n = len(w) - SHINGLE + 1
    with np.errstate(over="ignore"):
        total = w[:n] * _MUL[0]
        for i in range(1, SHINGLE):
            total += w[i : i + n] * _MUL[i]
    return mixed(total, 1)


def line_shingles(lines: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines without line breaks, all at once: words of each; of those with ``least`` (5 or more) words, the distinct shingles sorted within each line, and their line numbers."""
    w, starts = word_hashes(b"\n".join(lines))
    ends = np.cumsum([len(x) + 1 for x in lines]) if lines else np.empty(0, np.int64)
    line = ends.searchsorted(starts, "right")
    n_words = np.bincount(line, minlength=len(lines))
    if len(w) < SHINGLE:
        return n_words, np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _rolled(w)
    good = (line[: len(h)] == line[SHINGLE - 1 :]) & (n_words[line[: len(h)]] >= least)
    h, line = h[good], line[: len(good)][good]
    o = np.lexsort((h, line))
    h, line = h[o], line[o]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return n_words, h[once], line[once]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the words between 0x20 and 0x09-0x0D; no words, no shingles."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
    with np.errstate(over="ignore"):
        if not len(w):
            return w
        if len(w) < SHINGLE:
            one = sum((w[i : i + 1] * _MUL[i] for i in range(len(w))), np.zeros(1, np.uint64))
            return mixed(one, 20 + len(w))
    h = np.sort(_rolled(w))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def class_key(tokens: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed) - 2**63


def parities(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((mixed(tokens, 9) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of a global order: 1 and 2 by frequency level, then differently mixed hashes; 3 by hash alone."""
    key = mixed(tokens, 10 + order)
    if order == 3:
        return key
    level = levels[(tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(56)) | (key >> np.uint64(8))


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    p = prefix_length(len(tokens))
    if p >= len(tokens):
        return tokens
    return tokens[np.argpartition(order_keys(tokens, levels, order), p - 1)[:p]]


_SCAN = "doc_id long, digest long, c long, c2 long, n long, " + ", ".join(f"{b} long" for b in BITS) + ", part int, block int, counts binary"


def _scan(seed: int):
    def run(batches):
        """Document rows (doc_id, digest, class, a second key of the set, size, parities) and, at the end of the task, its block counts."""
        counts, seen, some, held = np.zeros(1 << SKETCH_BITS, np.int32), set(), [], 0
        mask = np.uint64((1 << SKETCH_BITS) - 1)

        def add():
            nonlocal counts, held
            if some:
                counts += np.bincount((np.concatenate(some) & mask).astype(np.int64), minlength=len(counts)).astype(np.int32)
            some.clear()
            held = 0

        for pdf in common.parts(batches):
            rows = []
            for doc_id, digest, text in zip(pdf["doc_id"], pdf["digest"], pdf["text"]):
                s = shingles(text)
                c = class_key(s, seed)
                rows.append((doc_id, digest, c, class_key(s, SECOND), len(s), *(parities(s) if len(s) else [0] * 8)))
                if len(s) and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    some.append(s)
                    held += len(s)
                    if held > 2_000_000:
                        add()
            yield _frame(rows)
        add()
        part = TaskContext.get().partitionId()
        blocks = [(i, counts[i * BLOCK : (i + 1) * BLOCK]) for i in range(len(counts) // BLOCK)]
        blocks = [(i, x.tobytes()) for i, x in blocks if x.any()]
        out = _frame([(None, None, None, None, None, *([None] * 8))] * len(blocks))
        yield out.assign(part=pd.array([part] * len(blocks), "Int32"), block=pd.array([i for i, _ in blocks], "Int32"), counts=[x for _, x in blocks])

    return run


def _frame(rows) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_id", "digest", "c", "c2", "n", *BITS]).astype("Int64")
    return df.assign(part=pd.array([None] * len(df), "Int32"), block=pd.array([None] * len(df), "Int32"), counts=None)


def frequency_levels(blocks: DataFrame) -> np.ndarray:
    """One byte per sketch bucket (4 log2 of the count, rounded up): ``2**SKETCH_BITS`` bytes whatever the input. Sums go in two steps."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64 if len(x) == 8 * BLOCK else np.int32) for x in pdf["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"part": [-1], "block": [int(key[0])], "counts": [total.tobytes()]})

    def top(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(add(key, pdf)["counts"][0], np.int64)
        return pd.DataFrame({"block": [int(key[0])], "levels": [np.ceil(4 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()]})

    some = blocks.groupBy("block", F.expr("part div 64").alias("salt")).applyInPandas(add, "part int, block int, counts binary")
    rows = some.groupBy("block").applyInPandas(top, "block int, levels binary").collect()  # at most 2**SKETCH_BITS bytes in all
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        levels[r[0] * BLOCK : (r[0] + 1) * BLOCK] = np.frombuffer(r[1], np.uint8)
    return levels


def _postings(levels_of, seed: int = 0):
    def run(batches):
        levels, seen = levels_of.value, set()
        for pdf in common.parts(batches):
            out_t, out_s, out_c = [], [], []
            for text in pdf["text"]:
                s = shingles(text)
                c = class_key(s, seed)
                if not len(s) or c in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                p = prefix(s, levels, 1)
                level = levels[(p & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                p, level = p[level > 0], level[level > 0]  # level 0: this sketch bucket was hit once, so no other set has the token
                parts = np.ceil(2.0 ** (level / 4.0) / HOT).astype(np.int64)
                out_t.append(p.view(np.int64))
                out_s.append(np.where(parts > 1, 1 + (c % np.maximum(parts, 1)), 0))
                out_c.append(np.full(len(p), c, np.int64))
            if out_t:
                yield pd.DataFrame({"token": np.concatenate(out_t), "salt": np.concatenate(out_s).astype(np.int32), "c": np.concatenate(out_c)})

    return run


def _sets(seed: int = 0):
    def run(batches):
        """One text of each class, compressed: a third of its shingles' size or less; whoever compares it makes the shingles again."""
        seen: set = set()
        pack = zstandard.ZstdCompressor(level=3)
        for pdf in common.parts(batches):
            found = {}
            for c, text in zip(pdf["c"], pdf["text"]):
                if c not in seen and class_key(shingles(text), seed) == c:
                    seen.add(c)
                    found[c] = pack.compress((text or "").encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(list(found.items()), columns=["c", "tokens"])

    return run


def _verify(levels_of):
    def run(batches):
        levels = levels_of.value
        memo: dict = {}
        held = 0
        unpack = zstandard.ZstdDecompressor()

        def views(c, raw):
            nonlocal held
            if c not in memo:
                if held > MEMO_TOKENS:
                    memo.clear()
                    held = 0
                s = shingles(unpack.decompress(raw).decode("utf-8", "surrogatepass"))
                memo[c] = (s, np.sort(prefix(s, levels, 2)), np.sort(prefix(s, levels, 3)))
                held += len(s)
            return memo[c]

        for pdf in batches:

            links = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"]):
                (s, s2, s3), (t, t2, t3) = views(a, x), views(b, y)
                if not len(np.intersect1d(s2, t2, True)) or not len(np.intersect1d(s3, t3, True)):
                    continue
                common_ = len(np.intersect1d(s, t, True))
                if DEN * common_ >= NUM * (len(s) + len(t) - common_):
                    links.append((a, b))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _close(x: str, y: str, bits: list[str] = BITS) -> str:
    """Length bound and bitmap bound of two classes, as SQL; fewer parities give a weaker bound."""
    pop = " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in bits)
    # symmetric difference <= (1 - t) / (1 + t) of the summed sizes
    return f"{DEN} * least({x}.n, {y}.n) >= {NUM} * greatest({x}.n, {y}.n) AND {DEN + NUM} * ({pop}) <= {DEN - NUM} * ({x}.n + {y}.n)"


def live_buckets(posts: DataFrame) -> DataFrame:
    """(token, salt, c) to (token, salt, c, pivot p), without buckets of one class. One of four orders of the members holds in a bucket, so a group has four pivots and not one for each token."""
    bucket = W.partitionBy("token", "salt")
    turn = F.shiftleft(F.col("token"), 62)
    x = posts.withColumn("x", F.col("c").bitwiseXOR(turn))
    live = x.withColumns({"lo": F.min("x").over(bucket), "hi": F.max("x").over(bucket)}).filter("lo <> hi or salt > 0")
    return common.written(live.select("token", "salt", "c", F.col("lo").bitwiseXOR(turn).alias("p")).distinct(), "jaccard-live")


def linked_components(live: DataFrame, classes: DataFrame, fetch, verify) -> DataFrame:
    """(node, component) of the classes that link. ``classes``: c, n and parities; ``fetch(ids)``: (c, tokens) of the wanted classes, tokens in a form that ``verify`` reads; ``verify``: confirms (a, b, x, y).

    Star rounds: first each class meets one pivot, the smallest of its buckets; then it meets the other pivots of its buckets that are still in another component. What is left apart meets in the cross round.
    """
    every = common.written(fetch(live.select("c").distinct()), "jaccard-sets")
    if every.groupBy("c").count().filter("count > 1").limit(1).count():  # a class that was read in several places
        every = common.written(every.dropDuplicates(["c"]), "jaccard-sets")

    side = lambda name: classes.select(F.col("c").alias(f"{name}_c"), F.struct("n", *BITS).alias(name))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter("c <> p").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()

    def close(pairs: DataFrame, name: str) -> DataFrame:
        near = pairs.join(side("x"), F.col("a") == F.col("x_c")).join(side("y"), F.col("b") == F.col("y_c")).filter(_close("x", "y"))
        return common.written(near.select("a", "b"), name)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = common.small(common.written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "c"), "jaccard-wanted"), MOST_BROADCAST)
        sets = every.join(wanted, "c", "left_semi")  # only what is compared is shuffled
        both = pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("y")), "b")
        return common.written(both.select("a", "b", "x", "y").mapInPandas(verify, "a long, b long"), "jaccard-links")

    tried = close(ordered(live.groupBy("c").agg(F.min("p").alias("p"))), "jaccard-first")
    links = verified(tried)
    comp = common.components(links)
    of = lambda name: comp.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_comp"))
    parts = live.filter("salt > 0").select("token", "p").distinct()
    parts = parts.join(parts.groupBy("token").agg(F.min("p").alias("c")), "token").select("c", "p")
    more = ordered(live.select("c", "p").union(parts))
    more = more.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    more = more.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b").join(tried, ["a", "b"], "left_anti")
    more = close(more, "jaccard-stars")
    tried, links = tried.union(more), links.union(verified(more))

    comp = common.components(links)
    named = live.select("token", "c").distinct().join(comp, F.col("c") == F.col("node"), "left").select("token", "c", F.coalesce("component", "c").alias("comp"))
    named = common.written(named, "jaccard-named")
    open_ = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    open_ = common.written(named.join(open_, "token"), "jaccard-open")
    # a pair shares many open tokens: it is made once, at a token that comes first for both in one of four orders, or else at each of them
    flip = F.col("token").bitwiseXOR(F.lit(0x5555555555555555))
    first = open_.groupBy("c").agg(F.min("token").alias("t0"), F.max("token").alias("t1"), F.min(flip).alias("t2"), F.max(flip).alias("t3"))
    first = first.withColumns({k: F.col(k).bitwiseXOR(F.lit(0x5555555555555555)) for k in ("t2", "t3")})
    members = open_.join(first, "c").join(classes.select("c", "n", *BITS), "c")
    members = common.written(members, "jaccard-members")
    once = "CASE " + " ".join(f"WHEN x.t{k} = y.t{k} THEN x.token = x.t{k}" for k in range(4)) + " ELSE true END"
    cross = members.alias("x").join(members.alias("y"), F.expr(f"x.token = y.token AND x.c < y.c AND x.comp <> y.comp AND {once} AND {_close('x', 'y', BITS)}"))
    cross = common.written(cross.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), "jaccard-pairs").join(tried, ["a", "b"], "left_anti")
    return common.components(links.union(verified(common.written(cross, "jaccard-cross"))))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, group), one row per input row; digest is xxhash64 of the text, group tells components apart also where ids are null or repeat.

    Null or wordless text: empty set, linked with nothing, component_id = own id, group null. A class whose ids are all null links with
    nothing (component_id null). Repeated rows and equal texts share a class. Very long texts are read whole. Empty input gives an empty table. Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    for seed in range(3):
        scan = common.written(src.mapInPandas(_scan(seed), _SCAN), "jaccard-scan")
        rows = scan.filter("block is null").select("doc_id", "digest", "c", "c2", "n", *BITS)
        # two different sets of one 64-bit key: not to be expected below billions of sets, but then other keys are taken
        if not rows.groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).filter("lo <> hi").limit(1).count():
            break
    else:
        raise RuntimeError("class keys collide")
    levels = spark.sparkContext.broadcast(frequency_levels(scan.filter("block is not null").select("part", "block", "counts")))

    classes = rows.filter("n > 0 and doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in BITS])
    classes = common.written(classes, "jaccard-classes")

    posts = src.filter("doc_id is not null").select("text").mapInPandas(_postings(levels, seed), "token long, salt int, c long")
    live = live_buckets(posts)

    def fetch(ids: DataFrame) -> DataFrame:
        ids = common.small(common.written(ids.join(classes.select("c", "doc_id"), "c"), "jaccard-ids"), MOST_BROADCAST)
        return src.select("doc_id", "text").join(ids, "doc_id").select("c", "text").mapInPandas(_sets(seed), "c long, tokens binary")

    comp = linked_components(live, classes, fetch, _verify(levels))
    ends = classes.select("c", "doc_id").join(comp, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "c"))
    ends = ends.select("c", "doc_id", "comp")
    linked = ends.join(comp.select("component").distinct(), F.col("comp") == F.col("component"), "left_semi")
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("least"))
    final = ends.join(least, "comp", "left").select("c", "comp", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "digest", "c", "n").join(final, "c", "left")
    whole = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.when(F.col("n") > 0, F.coalesce("comp", "c")).alias("group"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (then the smallest digest); rows without an id or words all stay, and so do different texts under one id that do not link.

    Decided by ids and digests: the texts are not shuffled for it, but for rows that stand twice.
    """
    out = common.written(jaccard_components(docs), "jaccard").filter("doc_id is not null and group is not null")
    first = out.groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    per = out.groupBy("group", "doc_id", "digest").agg(F.count("*").alias("k")).join(first, "group")
    stays = F.struct("doc_id", "digest") == F.col("first")
    gone = common.small(common.written(per.filter(~stays).select("doc_id", "digest"), "jaccard-gone"))
    twice = common.small(common.written(per.filter(stays & (F.col("k") > 1)).select("doc_id", "digest"), "jaccard-twice"))
    keyed = docs.withColumns({"__d": F.xxhash64("text"), "__id": F.col("doc_id").cast("long")})
    on = lambda t: (F.col("__id") == t["doc_id"]) & (F.col("__d") == t["digest"])
    left = keyed.join(gone, on(gone), "left_anti")
    one = F.row_number().over(W.partitionBy("__id", "__d").orderBy(*[F.col(c) for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")]))
    again = left.join(twice, on(twice), "left_semi").withColumn("__n", one).filter("__n = 1")
    return left.join(twice, on(twice), "left_anti").select(docs.columns).union(again.select(docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d),
e AS (SELECT k, unnest(s) AS t FROM s),
i AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM e a JOIN e b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN s x ON i.a = x.k JOIN s y ON i.b = y.k WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(k, c) AS (SELECT k, k FROM d UNION SELECT u.b, r.c FROM r JOIN u ON r.k = u.a) SELECT k, c FROM r)
SELECT x.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM d x JOIN s ON x.k = s.k
JOIN (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON r.c = d.k GROUP BY r.k) m ON m.k = x.k
"""
