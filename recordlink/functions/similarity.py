"""Name similarities: a native score for large joins, and the weighted ratio on shortlists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlink.functions import text

# ---- fixed values: weights of the weighted ratio -------------------------------------------------
TOKEN_WEIGHT, PARTIAL_WEIGHT, FAR_WEIGHT, NEAR_LENGTHS, FAR_LENGTHS = 0.95, 0.9, 0.6, 1.5, 8.0
# --------------------------------------------------------------------------------------------------

#: Characters of a text that fit one number; texts longer than the second are no rows of a table.
WORD, WIDEST = 64, 256
#: Pairs whose columns are computed side by side.
PAIRS = 1 << 14


def distance(a: str, b: str) -> int:
    """The edit distance, a column of the table as the bits of two numbers (up and down)."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, out = full, 0, len(a)
    for ch in b:
        equal = where.get(ch, 0)
        x = equal | down
        same = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (~(same | up) & full), up & same
        out += (plus >> last & 1) - (minus >> last & 1)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (~(x | plus) & full), plus & x
    return out


class Texts:
    """Different texts as numbers, so that many pairs of them are compared at once."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.n = texts, np.array([len(x) for x in texts], np.int64)
        width = int(min(WIDEST, self.n.max(initial=1)))
        self.raw = np.array([x[:width] for x in texts], f"U{width}").view(np.uint32).reshape(len(texts), width)
        used = np.zeros(int(self.raw.max(initial=0)) + 1, bool)
        used[self.raw.ravel()] = True
        self.codes, self.letters = (np.cumsum(used) - 1)[self.raw].astype(np.uint16 if used.sum() < 1 << 16 else np.uint32), int(used.sum())
        self.equal = np.zeros((len(texts), self.letters), np.uint64)  # where a text has a character
        for at in range(min(width, WORD)):
            rows = np.flatnonzero(self.n > at)
            self.equal[rows, self.codes[rows, at]] |= np.uint64(1 << at)

    def counts(self, lanes: tuple) -> list[np.ndarray]:
        """As ``text.counts_of_characters``."""
        out, long = [], np.flatnonzero(self.n > self.raw.shape[1])
        for chars, bits in lanes:
            total = np.zeros(len(self.texts), np.uint64)
            for i, ch in enumerate(chars):
                n = (self.raw == ord(ch)).sum(axis=1)
                n[long] = [self.texts[x].count(ch) for x in long]
                total |= ((np.uint64(1) << np.minimum(n, bits).astype(np.uint64)) - np.uint64(1)) << np.uint64(bits * i)
            out.append(total)
        return out

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The edit distances of the texts ``i`` and ``j`` (numbers of texts)."""
        shorter = self.n[i] <= self.n[j]
        i, j = np.where(shorter, i, j), np.where(shorter, j, i)
        out = self.n[j].copy()
        slow = (self.n[i] > WORD) | (self.n[j] > self.raw.shape[1])
        for x in np.flatnonzero(slow):
            out[x] = distance(self.texts[i[x]], self.texts[j[x]])
        fast = np.flatnonzero(~slow & (self.n[i] > 0))
        fast = fast[np.argsort(-self.n[j[fast]], kind="stable")]  # those with characters left come first
        for lo in range(0, len(fast), PAIRS):
            rows = fast[lo : lo + PAIRS]
            out[rows] = self._side_by_side(i[rows], j[rows])
        return out

    def _side_by_side(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        one, n = np.uint64(1), self.n[j]
        last, begins = (self.n[i] - 1).astype(np.uint64), i * self.letters
        up, down, out = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), self.n[i].copy()
        equal, codes = self.equal.ravel(), np.ascontiguousarray(self.codes[j].T)
        lefts = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        for at, c in enumerate(lefts.tolist()):
            if c < len(up):
                up, down, last, begins = up[:c], down[:c], last[:c], begins[:c]
            e = equal[begins + codes[at, :c]]
            x = e | down
            same = (((e & up) + up) ^ up) | e
            plus, minus = down | ~(same | up), up & same
            out[:c] += (plus >> last & one).view(np.int64)
            out[:c] -= (minus >> last & one).view(np.int64)
            plus, minus = plus << one | one, minus << one
            up, down = minus | ~(x | plus), plus & x
        return out


class Names:
    """Different names for ``native`` scores of many pairs at once."""

    def __init__(self, names: list[str]) -> None:
        self.whole, self.words = Texts(names), Texts([" ".join(sorted(x.split(" "))) for x in names])

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``native``, for the names ``i`` and ``j`` (numbers of names)."""
        n = np.maximum(self.whole.n[i], self.whole.n[j])
        n[n == 0] = 1
        out = 1 - self.whole.distances(i, j) / n
        more = np.flatnonzero(out < 0.95)
        out[more] = np.maximum(out[more], 0.95 * (1 - self.words.distances(i[more], j[more]) / n[more]))
        return out


def native(a: Column, b: Column) -> Column:
    """The edit similarity, or 0.95 of it for the sorted words, whichever is larger. Both are at most the ratio of the lengths."""
    return F.greatest(text.edit_similarity(a, b), 0.95 * text.edit_similarity(text.token_sort(a), text.token_sort(b)))


def native_from(a: Column, b: Column, a_sorted: Column, b_sorted: Column, least: Column) -> Column:
    """``native`` where it is at least ``least`` (0 otherwise), from the texts and their sorted words."""
    whole = text.edit_similarity_from(a, b, least)
    return F.greatest(whole, 0.95 * text.edit_similarity_from(a_sorted, b_sorted, F.greatest(least, whole) / 0.95))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one, at most as long and also at its ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 1.0 if not b else 0.0
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        part = b[max(i, 0) : i + n]
        if 2 * min(n, len(part)) / (n + len(part)) > best:
            best = max(best, ratio(a, part))
    return best


def _token_ratios(a: str, b: str, score) -> float:
    """The better of the sorted words and of the shared words against shared and own ones."""
    x, y = sorted(a.split()), sorted(b.split())
    both = sorted(set(x) & set(y))
    best = score(" ".join(x), " ".join(y))
    if both:
        left, right = sorted(set(x) - set(both)), sorted(set(y) - set(both))
        if not left or not right or score is partial:
            return 1.0
        first, second = " ".join(both + left), " ".join(both + right)
        shared = " ".join(both)
        best = max(best, score(shared, first), score(shared, second), score(first, second))
    return best


def weighted(a: str | None, b: str | None) -> float:
    """The weighted maximum of whole, partial and word-wise ratios, 0 to 1; 0 if one text is empty."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < NEAR_LENGTHS:
        return max(best, TOKEN_WEIGHT * _token_ratios(a, b, ratio))
    weight = PARTIAL_WEIGHT if spread <= FAR_LENGTHS else FAR_WEIGHT
    return max(best, weight * partial(a, b), weight * TOKEN_WEIGHT * _token_ratios(a, b, partial))


def weighted_column(a: Column, b: Column) -> Column:
    """``weighted`` for a shortlist, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)
