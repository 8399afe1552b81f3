"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the words a text has and their beginnings (of 4 to 7 letters, so that inflected forms share evidence), hashed to ``2**HASH_BITS`` features, none of which is cut for being rare. Each
feature is scaled by its log-count ratio between the two labels, smoothed by ``SMOOTH`` documents (Wang and Manning 2012), which gives rare and unrelated ones little say. It is trained on labelled rows with the loss
``log loss + L2 * |v|^2 + SWAP * mean over counterfactuals of (score change)^2`` (Garg et al. 2019, counterfactual logit pairing). A counterfactual
changes one labelled sentence: an identity term gives way to another one of its language, or, where a sentence has none, a term of the sentence's language
is put in. A linear model changes its logit by the difference of the two terms' features, or by the new term's, so each pair of terms enters with the number of sentences it changes.
Training takes labelled documents in the order of their hashed ids, at most ``MOST_ROWS`` and until they hold ``MOST_ENTRIES`` features; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.llm import common

#: Bounds of the training sample: labelled rows, and different features of a row summed over them.
MOST_ROWS, MOST_ENTRIES = 20_000, 3_000_000
HASH_BITS = 20
L2, SWAP, SMOOTH, STEPS = 1e-4, 1.0, 10.0, 60
STEMS = (4, 5, 6, 7)
CUT = 0.3
#: Words whose weight a worker remembers; beyond that it looks them up again.
MEMO_WORDS = 500_000
# ---- fixed values: identity terms by language, and common words that tell a sentence's language ---
IDENTITY = {
    "en": ("asian", "black", "blind", "buddhist", "catholic", "christian", "deaf", "disabled", "female", "gay", "hindu", "immigrant", "jewish", "latino", "lesbian", "male", "muslim", "refugee", "trans", "white", "women", "men", "person", "people", "someone"),
    "de": ("asiatisch", "behindert", "blind", "buddhistisch", "christlich", "flüchtling", "frauen", "jüdisch", "katholisch", "lesbisch", "männer", "muslimisch", "schwarz", "schwul", "taub", "weiß", "einwanderer", "person", "leute", "jemand"),
    "fr": ("asiatique", "aveugle", "bouddhiste", "catholique", "chrétien", "femmes", "handicapé", "hommes", "immigré", "juif", "lesbienne", "musulman", "noir", "réfugié", "sourd", "blanc", "personne", "gens", "quelqu"),
    "es": ("asiático", "blanco", "budista", "católico", "ciego", "cristiano", "discapacitado", "gay", "hombres", "inmigrante", "judío", "lesbiana", "mujeres", "musulmán", "negro", "refugiado", "sordo", "persona", "gente", "alguien"),
}
COMMON = {"en": {"the", "and", "of", "to", "is", "in"}, "de": {"der", "die", "und", "das", "ist", "von"}, "fr": {"le", "la", "les", "et", "des", "du"}, "es": {"el", "los", "las", "que", "una", "del"}}
# --------------------------------------------------------------------------------------------------
_TERM_LANGUAGE = [(lang, t) for lang, ts in IDENTITY.items() for t in ts]
_TOKEN = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(_TOKEN.findall((text or "").lower()))


def features(word: str) -> tuple[int, ...]:
    """Numbers of the word and of its beginnings."""
    return tuple(xxhash.xxh32_intdigest(x) & ((1 << HASH_BITS) - 1) for x in (word, *("^" + word[:n] for n in STEMS if len(word) > n)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids belong to no fold (null)."""
    return F.crc32(doc_id.cast("string")) % 4


def counterfactuals(text: str | None):
    """(old term or None, new term) for each changed sentence of a text."""
    for sentence in _SENTENCE.split((text or "").lower()):
        ws = set(_TOKEN.findall(sentence))
        if not ws:
            continue
        hits = [(lang, t) for lang, t in _TERM_LANGUAGE if t in ws]
        best = max(len(ws & c) for c in COMMON.values())
        langs = [lang for lang, c in COMMON.items() if len(ws & c) == best]
        if hits:
            for lang, old in hits:
                if lang in langs or not any(h in langs for h, _ in hits):
                    yield from ((old, new) for new in IDENTITY[lang] if new not in ws)
        else:
            terms = IDENTITY[langs[zlib.crc32(sentence.encode("utf-8", "surrogatepass")) % len(langs)]]
            yield None, terms[zlib.crc32(sentence.encode("utf-8", "surrogatepass")) // 7 % len(terms)]


def minimised(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient."""
    s, y = [], []
    value, g = f(x)
    for _ in range(steps):
        d, along = g.copy(), []
        for a, b in zip(reversed(s), reversed(y)):
            along.append((a @ d) / (a @ b))
            d -= along[-1] * b
        if s:
            d *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for a, b, k in zip(s, y, reversed(along)):
            d += a * (k - (b @ d) / (a @ b))
        t, slope = (1.0 if s else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))), g @ d
        while True:
            to = x - t * d
            new, h = f(to)
            if new <= value - 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        if (to - x) @ (h - g) > 1e-12:
            s, y = [*s, to - x][-memory:], [*y, h - g][-memory:]
        still = abs(value - new) < 1e-7 * max(1.0, abs(value))
        x, value, g = to, new, h
        if still:
            break
    return x


def train_weights(labels: np.ndarray, lens: np.ndarray, idx: np.ndarray, n_features: int, changes: list[tuple], l2: float = L2, swap: float = SWAP, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(bias, weights). ``idx``: feature numbers of the rows one after another, ``lens`` of each; changes: (lost features, new features, sentences)."""
    y, lens = np.asarray(labels, np.float64), np.asarray(lens, np.int64)
    if not len(y):
        return math.log(0.01 / 0.99), np.zeros(n_features)
    doc, n = np.repeat(np.arange(len(y)), lens), len(y)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    all_, pos = np.bincount(idx, minlength=n_features), np.bincount(idx, np.repeat(y, lens), n_features)
    ratio = np.log((pos + 2 * SMOOTH * rate) / (y.sum() + SMOOTH)) - np.log((all_ - pos + 2 * SMOOTH * (1 - rate)) / (n - y.sum() + SMOOTH))
    scale = np.abs(ratio)
    # counterfactuals as a sparse matrix of +1 and -1
    row = np.array([k for k, (old, new, _) in enumerate(changes) for _ in (*old, *new)], np.int64)
    col = np.array([i for old, new, _ in changes for i in (*old, *new)], np.int64)
    sign = np.array([v for old, new, _ in changes for v in [-1.0] * len(old) + [1.0] * len(new)])
    share = np.array([c for _, _, c in changes], np.float64)
    share /= max(share.sum(), 1)

    def loss(x):
        w = x[:-1] * scale
        z = np.clip(x[-1] + np.bincount(doc, w[idx], n), -30, 30)
        g = (1 / (1 + np.exp(-z)) - y) / n
        gap = np.bincount(row, w[col] * sign, len(changes))
        gw = np.bincount(idx, g[doc], n_features) + np.bincount(col, (2 * swap * share * gap)[row] * sign, n_features)
        value = np.mean(np.logaddexp(0, z) - y * z) + l2 * (x[:-1] ** 2).sum() + swap * (share * gap * gap).sum()
        return value, np.append(gw * scale + 2 * l2 * x[:-1], g.sum())

    x = minimised(loss, np.append(np.zeros(n_features), math.log(rate / (1 - rate))), steps)
    return float(x[-1]), x[:-1] * scale


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, n, ids, changes) of the bounded sample, its first text always: features as packed 32-bit integers, and the counterfactuals of a row counted."""
    lab = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)  # at most MOST_ROWS rows of two numbers

    def split(batches):
        for pdf in batches:
            rows = []
            for doc_id, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"]):
                ids = np.unique(np.fromiter((i for x in words(text) for i in features(x)), np.int32))
                changes = Counter((old, new) for old, new in counterfactuals(text))
                rows.append((doc_id, int(toxic > 0), len(ids), ids.astype("<i4").tobytes(), [(a, b, c) for (a, b), c in changes.items()]))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "n", "ids", "changes"])

    src = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("doc_id", "toxic", "text")
    rows = common.written(src.mapInPandas(split, "doc_id long, toxic int, n long, ids binary, changes array<struct<a:string,b:string,n:long>>"), "toxicity-rows")
    texts = F.struct("n", "ids", "toxic", "changes")
    rows = rows.groupBy("doc_id").agg(F.min(texts).alias("t")).select("doc_id", "t.*")  # one text of an id that repeats
    before = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").rowsBetween(W.unboundedPreceding, 0))  # at most MOST_ROWS ids
    return rows.withColumn("up_to", before).filter((F.col("up_to") <= MOST_ENTRIES) | (F.col("up_to") == F.col("n")))


def train(docs: DataFrame, labels: DataFrame, swap: float = SWAP) -> tuple[float, dict[int, float], int]:
    """(bias, feature -> weight, counterfactuals) from ``labels`` (doc_id, toxic) joined with ``docs`` (doc_id, text).

    Several labels of an id: the largest; null ones are left out. Several texts of an id: each is a row. No labelled row: a model without weights.
    """
    rows = common.written(training_rows(docs, labels), "toxicity-sample")
    data = sorted((r[0], r[1]) for r in rows.select("toxic", "ids").collect())  # bounded by MOST_ROWS and MOST_ENTRIES
    pairs = rows.select(F.explode("changes").alias("c")).groupBy("c.a", "c.b").agg(F.sum("c.n").alias("n")).orderBy("a", "b").collect()  # at most one row for two terms
    lens = np.array([len(ids) // 4 for _, ids in data], np.int64)
    raw = np.frombuffer(b"".join(ids for _, ids in data), "<i4").astype(np.int64)
    terms = {t: features(t) for _, t in _TERM_LANGUAGE}
    known, idx = np.unique(np.concatenate((raw, np.array([i for f in terms.values() for i in f], np.int64))), return_inverse=True)
    at = {t: np.searchsorted(known, f).tolist() for t, f in terms.items()}
    changes = []
    for r in pairs:
        old, new = set(at[r[0]]) if r[0] else set(), set(at[r[1]])
        changes.append((sorted(old - new), sorted(new - old), r[2]))
    bias, w = train_weights(np.array([y for y, _ in data], np.float64), lens, idx[: len(raw)], len(known), changes, swap=swap)
    return bias, {int(k): float(x) for k, x in zip(known, w) if abs(x) > 1e-4}, int(sum(r[2] for r in pairs))


def score(docs: DataFrame, carry: list[str], model: tuple, text: str = "text") -> DataFrame:
    """``carry`` columns as struct ``row`` and score. Null, empty or wordless text: the score of no words. One row per input row, repeated rows alike; empty input gives an empty table. Columns of any name may be carried."""
    bias, weights = model[0], model[1]
    table = np.zeros(1 << HASH_BITS, np.float32)
    table[list(weights)] = list(weights.values())
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 4 bytes for each of 2**HASH_BITS features

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, memo = shared.value, {}
        for texts in batches:
            z = []
            for t in texts:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                seen = words(t)
                for x in seen.difference(memo):
                    memo[x] = tuple(i for i in features(x) if w[i])
                has = sorted(set().union(*map(memo.__getitem__, seen)))
                z.append(bias + float(w[has].sum(dtype=np.float64)) if has else bias)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30))))

    src = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))
    return src.withColumn("score", run("text")).select("row", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id")) != 2))
    df = score(docs, ["doc_id"], model)
    held = F.coalesce(fold(F.col("row.doc_id")) == 2, F.lit(False))
    return df.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
