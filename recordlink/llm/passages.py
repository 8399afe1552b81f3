"""Substring dedup: repeated paragraphs by MinHash banding, and repeated word spans that do not depend on line ends.

A paragraph is a ``\n``-line; lines of fewer than ``LEAST_WORDS`` words go on in the next ones until there are as many, so that short lines are compared too (what is left at a text's end needs five words, one shingle). Paragraphs with the same set of five-word shingles form a class. ``BANDS`` bands of ``ROWS`` MinHash values
find colliding classes: a pair with Jaccard s collides with probability 1 - (1 - s**ROWS)**BANDS, 0.9986 at 0.8 and 0.9999 at 0.9. Colliding classes are
joined as in the n-gram join (pivots first, then what is still apart), the exact Jaccard confirms, and connected components are the clusters.
In each cluster the first occurrence (smallest doc_id, then position) stays and all others are removals.

A span is a run of ``SPAN`` words or more, over the whole text, of which each window of ``SPAN`` words also stands in another document:

1. Winnowing: of the ``GRAM``-word hashes in each window the smallest is the window's fingerprint. It follows from the window's words alone, so equal windows have equal fingerprints and none is missed.
   Windows in a row with one fingerprint are a group. Where all groups of a fingerprint have the same words, one hash of the group stands for its windows.
2. Groups and windows whose fingerprint stands in two documents are compared by the hash of all their words; those in two documents are hits.
3. Hits in a row with the same first document join, which extends them to the maximal common span.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common, jaccard

LEAST_WORDS = 20
BANDS, ROWS = 9, 3
#: Words of a window, and of the hashes that its fingerprint is taken from.
SPAN, GRAM = 50, 25
#: Fingerprints of 8 bytes that may be broadcast to pick candidates' texts; more go through a shuffle join.
MOST_FINGERPRINTS = 2_000_000


def _paragraphs(texts, group: int = 2_000_000):
    """Lists of (text number, index, start, end, words) of paragraphs, with their shingles one after another and where each one's begin; about ``group`` characters at a time."""
    spans: list = []
    raw: list[bytes] = []
    held = 0
    for k, text in enumerate(texts):
        i, at, start, n = 0, 0, 0, 0
        for line in (text or "").split("\n"):
            n += len(line.encode("utf-8", "surrogatepass").split(None, LEAST_WORDS))  # bytes are split at the ASCII spaces alone
            at += len(line) + 1
            if n >= LEAST_WORDS or (n >= jaccard.SHINGLE and at > len(text or "")):
                spans.append((k, i, start, at - 1))
                raw.append(text[start : at - 1].encode("utf-8", "surrogatepass"))
                held += at - start
                i, start, n = i + 1, at, 0
        if held >= group:
            yield _group(spans, raw)
            spans, raw, held = [], [], 0
    if spans:
        yield _group(spans, raw)


def _group(spans, raw):
    n_words, h, line = jaccard.line_shingles(raw, jaccard.SHINGLE)
    begins = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(h) else np.empty(0, np.int64)
    return [(*spans[j], int(n_words[j])) for j in line[begins].tolist()], h, begins


_ODD = jaccard.mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 31) | np.uint64(1)


def bands(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Band keys (paragraphs x BANDS) from the smallest of ``BANDS * ROWS`` permuted hashes of each paragraph."""
    keys = np.zeros((len(begins), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            # the hashes are well mixed already: an odd factor permutes them
            keys[:, i // ROWS] += np.minimum.reduceat(h * _ODD[i], begins) * jaccard._MUL[i % ROWS]
        return jaccard.mixed(keys + np.arange(BANDS, dtype=np.uint64), 5).view(np.int64)


_SCAN = "doc_id long, para int, start int, `end` int, n_words long, c long, n long, bands array<long>, " + ", ".join(f"{b} long" for b in jaccard.BITS)


def parities(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``jaccard.parities`` of each paragraph, many at a time."""
    ends = np.append(begins[1:], len(h))
    row = np.repeat(np.arange(len(begins)), ends - begins)
    slot = (jaccard.mixed(h, 9) & np.uint64(511)).astype(np.int64)
    out = np.empty((len(begins), len(jaccard.BITS)), np.int64)
    for lo in range(0, len(begins), 512):
        hi = min(lo + 512, len(begins))
        part = slice(begins[lo], ends[hi - 1])
        odd = np.bincount((row[part] - lo) * 512 + slot[part], minlength=(hi - lo) * 512) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8).reshape(hi - lo, 512), axis=1).view(np.int64)
    return out


def _scan(batches):
    """All paragraphs; bands and parities only where a task meets a class first."""
    seen: set = set()
    for pdf in batches:
        ids = pdf["doc_id"].to_numpy()
        for spans, h, begins in _paragraphs(pdf["text"]):
            if not spans:
                continue
            sizes = np.append(begins[1:], len(h)) - begins
            cs, new = [], np.zeros(len(spans), bool)
            for j, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
                c = jaccard.class_key(h[b : b + n])
                cs.append(c)
                new[j] = c not in seen
                if new[j] and len(seen) < 1_000_000:
                    seen.add(c)
            k, i, a, b, n = np.array(spans, np.int64).T
            band, bits = np.full(len(spans), None, object), np.zeros((len(spans), len(jaccard.BITS)), np.int64)
            if new.any():
                first = h[np.repeat(new, sizes)]
                at = np.cumsum(sizes[new]) - sizes[new]
                for j, x in zip(np.flatnonzero(new), bands(first, at)):
                    band[j] = x
                bits[new] = parities(first, at)
            df = {"doc_id": ids[k], "para": i, "start": a, "end": b, "n_words": n, "c": np.array(cs, np.int64), "n": sizes, "bands": band}
            yield pd.DataFrame(df | {x: pd.arrays.IntegerArray(bits[:, y].copy(), ~new) for y, x in enumerate(jaccard.BITS)})


def _sets(batches):
    for pdf in batches:
        wanted = [set(x) for x in pdf["cs"]]
        rows = []
        for spans, h, begins in _paragraphs(pdf["text"]):
            ends = np.append(begins[1:], len(h))
            for j, (k, *_) in enumerate(spans):
                s = h[begins[j] : ends[j]]
                c = jaccard.class_key(s)
                if c in wanted[k]:
                    wanted[k].discard(c)
                    rows.append((c, s.tobytes()))
        yield pd.DataFrame(rows, columns=["c", "tokens"])


def _verify(batches):
    for pdf in batches:
        links = []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"]):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, True))
            if jaccard.DEN * both >= jaccard.NUM * (len(s) + len(t) - both):
                links.append((a, b))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that repeats: doc_id, para, start, end, n_words, cluster, copies, first_doc_id and removed.

    cluster is the smallest class key of the component, copies its number of occurrences. Null text has no paragraphs; rows with a null id are left out. Rows that stand
    twice are occurrences of their own, and equal (doc_id, para) are removed or kept together. Empty input gives an empty table.
    """
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    scan = common.written(src.mapInPandas(_scan, _SCAN), "paragraphs")
    first = scan.filter("bands is not null")
    classes = first.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in jaccard.BITS])
    classes = common.written(classes, "paragraph-classes")
    live = jaccard.live_buckets(first.select(F.explode("bands").alias("token"), F.lit(0).alias("salt"), "c"))

    def fetch(ids: DataFrame) -> DataFrame:
        ids = ids.join(classes.select("c", "doc_id"), "c").groupBy("doc_id").agg(F.collect_list("c").alias("cs"))  # at most a text's paragraphs
        ids = common.small(common.written(ids, "paragraph-ids"), jaccard.MOST_BROADCAST // 4)
        return src.join(ids, "doc_id").select("cs", "text").mapInPandas(_sets, "c long, tokens binary")

    comp = jaccard.linked_components(live, classes, fetch, _verify)
    # counts per class first, then per component: a frequent paragraph is one row for each task before the shuffle
    per = scan.groupBy("c").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "para")).alias("at"))
    per = per.join(comp, F.col("c") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "c"))
    per = common.written(per.select("c", "cluster", "k", "at"), "paragraph-counts")
    whole = per.groupBy("cluster").agg(F.sum("k").alias("copies"), F.min("at").alias("at")).filter("copies > 1")
    marks = per.select("c", "cluster").join(whole, "cluster")
    out = scan.select("doc_id", "para", "start", "end", "n_words", "c").join(marks, "c")
    removed = ~((F.col("doc_id") == F.col("at.doc_id")) & (F.col("para") == F.col("at.para")))
    return out.select("doc_id", "para", "start", "end", "n_words", "cluster", "copies", F.col("at.doc_id").alias("first_doc_id"), removed.alias("removed"))


def runs(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` words in a row, from prefix sums."""
    step, out = jaccard._SEG // 2, [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for lo in range(0, len(w) - k + 1, step):
            part = w[lo : lo + step + k - 1]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * jaccard._UP[: len(part)], dtype=np.uint64)))
            out.append(jaccard.mixed((sums[k:] - sums[:-k]) * jaccard._DOWN[: len(part) - k + 1], k))
    return np.concatenate(out)


def fingerprints(w: np.ndarray) -> np.ndarray:
    """The fingerprint of each window of ``SPAN`` words (there is one at least)."""
    least, size, width = runs(w, GRAM), 1, SPAN - GRAM + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def groups(w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows in a row with one fingerprint: the fingerprint, the number of the text, the first and the last window, and a hash of all their words; and of each window its number and hash.

    ``w`` are the words of texts one after another, ``bounds`` where each text begins and the last one ends; no window goes over a bound.
    """
    if len(w) < SPAN:
        return tuple(np.empty(0, t) for t in (np.uint64, int, int, int, np.uint64, int, np.uint64))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(text[: len(w) - SPAN + 1] == text[SPAN - 1 :])
    f, h, text = fingerprints(w)[place], runs(w, SPAN)[place], text[place]
    first = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (text[1:] != text[:-1])))[: len(f)]
    size = np.diff(np.append(first, len(f)))
    turn = (np.arange(len(f)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = jaccard.mixed(h + turn * jaccard._MUL[0], 11)
        whole = jaccard.mixed(np.add.reduceat(whole, first), 12) if len(f) else whole
    return f[first], text[first], place[first], place[first + size - 1], whole, place, h


def _words(texts) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The texts as bytes; of all their words, one text after another with a gap between, the hashes, where they start, and which are each text's first (and their number)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    w, starts = jaccard.word_hashes(b"\n".join(raw))
    return raw, w, starts, starts.searchsorted(np.cumsum([0, *(len(x) + 1 for x in raw)]))


def _fingerprints(batches):
    for pdf in common.parts(batches):
        _, w, _, bounds = _words(pdf["text"])
        f, text, _, _, g, _, _ = groups(w, bounds)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[text], "f": f.view(np.int64), "g": g.view(np.int64)})


_WINDOWS = "doc_id long, v long, i int, j int, start int, `end` int, h long"


def _windows(batches):
    """Groups (``one``) and single windows (``many``) with a wanted fingerprint: first and last window, where they stand in code points, and the hash of their words. ``v`` tells texts of one id apart."""
    for pdf in common.parts(batches):
        raw, w, starts, bounds = _words(pdf["text"])
        f, text, first, last, g, place, h = groups(w, bounds)
        if not len(f):
            continue
        # a fingerprint is wanted in all texts that have it, so that those of a whole part can be looked up at once
        one, many = (np.isin(f, np.concatenate([*pdf[x]]).astype(np.int64).view(np.uint64)) for x in ("one", "many"))
        size = last - first + 1
        single = np.repeat(many, size)
        i, j = np.concatenate((first[one], place[single])), np.concatenate((last[one], place[single]))
        text = np.concatenate((text[one], np.repeat(text[many], size[many])))
        b = np.frombuffer(b"\n".join(raw), np.uint8)
        point = np.cumsum((b & 0xC0) != 0x80)  # code points up to and with each byte
        stop = np.flatnonzero(~jaccard._GAP[b] & np.append(jaccard._GAP[b[1:]], True))
        before = np.append(0, point[np.cumsum([len(x) + 1 for x in raw[:-1]], dtype=int) - 1])  # code points before each text
        v = np.array([xxhash.xxh32_intdigest(x) for x in raw])
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[text], "v": v[text], "i": i - bounds[text], "j": j - bounds[text], "start": point[starts[i]] - 1 - before[text], "end": point[stop[j + SPAN - 1]] - before[text], "h": np.concatenate((g[one], h[single])).view(np.int64)})


def _in_two(rows: DataFrame, key: str, *more) -> DataFrame:
    return rows.groupBy(key).agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), *more).filter("first_doc_id <> last").drop("last")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span: doc_id, start, end, n_words, cluster, copies, first_doc_id and removed.

    cluster is the smallest hash of a group or window in the span, copies the most occurrences of one, first_doc_id the smallest id that has it. Repeats within one document only do not count here.
    Null and shorter texts have no spans; rows with a null id are left out. Rows that stand twice give their spans once. Empty input gives an empty table.
    """
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    prints = common.written(src.mapInPandas(_fingerprints, "doc_id long, f long, g long"), "span-fingerprints")
    twice = _in_two(prints, "f", (F.min("g") == F.max("g")).alias("same")).select("f", "same")
    of = lambda same: F.collect_set(F.when(same, F.col("f")))
    ids = prints.select("doc_id", "f").join(twice, "f").groupBy("doc_id").agg(of(F.col("same")).alias("one"), of(~F.col("same")).alias("many"))  # at most a text's fingerprints
    ids = common.written(ids, "span-ids")
    few = (ids.agg(F.sum(F.size("one") + F.size("many"))).first()[0] or 0) <= MOST_FINGERPRINTS
    wins = common.written(src.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "one", "many", "text").mapInPandas(_windows, _WINDOWS), "span-windows")
    hits = wins.join(_in_two(wins, "h", F.count("*").alias("k")), "h")
    place = W.partitionBy("doc_id", "v").orderBy("i")
    new = F.coalesce((F.col("i") - F.lag("j").over(place) > 1) | (F.col("first_doc_id") != F.lag("first_doc_id").over(place)), F.lit(True))
    hits = hits.withColumn("new", new.cast("int")).withColumn("n", F.sum("new").over(place))
    spans = hits.groupBy("doc_id", "v", "n", "first_doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("j") - F.min("i") + SPAN).cast("long").alias("n_words"), F.min("h").alias("cluster"), F.max("k").alias("copies"))
    return spans.select("doc_id", "start", "end", "n_words", "cluster", "copies", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("removed"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated paragraphs (kind line) and repeated spans (kind span, para null); a long line that repeats exactly is in both."""
    lines = repeated_paragraphs(docs, key, text).withColumn("kind", F.lit("line"))
    spans = repeated_spans(docs, key, text).withColumns({"para": F.lit(None).cast("int"), "kind": F.lit("span")})
    return lines.unionByName(spans)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))
