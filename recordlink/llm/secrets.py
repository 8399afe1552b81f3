"""Secret scans: pattern matches plus a sliding-window entropy scan with an allow-list.

A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` with at least ``WINDOW`` characters. Its hex stretches are scanned first, then the parts
outside their spans as base64, without the names that a part starts or ends with (``example_key=``). A window of fixed width slides over the stretch; its Shannon entropy follows from counts
that change by one in and one out per step. Windows at or above the class's threshold are joined to a span.
Spans that look like ordinary text are suppressed: a base64 span must hold two of lower case, upper case and digits, and the allow-list, which is
tested on each span alone, drops known harmless shapes. A placeholder drops a span of less than three windows; out of a longer one only the placeholder is cut.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.llm import common

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
WINDOW = 20
#: class -> bits per character that a window must reach
THRESHOLD = {"entropy_hex": 3.0, "entropy_base64": 3.7}
#: A word, also in camel case, with a short number behind; or a short number.
NAME = r"(?:(?:[A-Z]+|[a-z]+|[A-Z]{1,3}[a-z]{2,})(?:[A-Z]{1,3}[a-z]{2,})*[0-9]{0,4}|[0-9]{1,4})"
PLACEHOLDER = re.compile(r"(?ai)(example|sample|placeholder|changeme|dummy|lorem|x{6,}|0{8,}|1234567)")
#: Harmless shapes besides: names joined by separators as in paths, digits only. A name is read in several ways at its start, so each part is matched alone: all of them in one expression would be tried in all combinations.
PART, SEPARATORS = re.compile(NAME), re.compile(r"[-_/=+]+")
DIGITS = re.compile(r"[0-9]+([-_/=+][0-9]+)*")
#: A name of three letters or more that a separator ends or starts.
BEFORE = re.compile(rf"[-_/=]*(?=[A-Za-z]{{3}}){NAME}[-_/=]")
AFTER = re.compile(rf"[-_/=](?=[A-Za-z]{{3}}){NAME}[-_/=]*\Z")
LONGEST_NAME = 64
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # a window holds one more while it moves


def windows(run: str, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans of ``run`` made of windows with entropy >= ``threshold``; counts are updated by one in, one out."""
    counts: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    total, whole = 0.0, width * math.log2(width)  # sum of c*log2(c)
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += _TERM[c + 1] - _TERM[c]
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total += _TERM[c - 1] - _TERM[c]
            counts[old] = c - 1
        if i >= width - 1 and (whole - total) / width >= threshold - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(found: str) -> bool:
    parts = [p for p in SEPARATORS.split(found) if p]
    return bool(parts) and all(map(PART.fullmatch, parts)) or DIGITS.fullmatch(found) is not None


def kept(run: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of ``run`` that are left after the allow-list."""
    out = []
    for a, b in windows(run, threshold):
        part, at = run[a:b], 0
        holes = [m.span() for m in PLACEHOLDER.finditer(part)]
        if holes and len(part) < 3 * WINDOW:
            continue
        for lo, hi in [*holes, (len(part), len(part))]:
            found = windows(part[at:lo], threshold) if holes else [(0, len(part))]
            out += [(a + at + x, a + at + y) for x, y in found if not allowed(part[at + x : at + y])]
            at = hi
    return out


def unnamed(run: str, a: int, b: int) -> tuple[int, int]:
    """The part a to b of ``run`` without the names it starts or ends with, as long as a window is left."""
    while (m := BEFORE.match(run, a, b)) and b - m.end() >= WINDOW:
        a = m.end()
    while (m := AFTER.search(run, max(a, b - LONGEST_NAME), b)) and m.start() - a >= WINDOW:
        b = m.start()
    return a, b


def classes(part: str) -> int:
    return any(c.islower() for c in part) + any(c.isupper() for c in part) + any(c.isdigit() for c in part)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three patterns, sorted; matches that fail their length are dropped but still consume."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        if allowed(run):
            continue
        parts, free = [], 0
        for h in HEX_RUN.finditer(run):
            if h.end() - h.start() >= WINDOW and sum(c.isdigit() for c in h[0]) >= 4 and not h[0].isdigit():
                for a, b in kept(h[0], THRESHOLD["entropy_hex"]):
                    out.append((at + h.start() + a, 3, at + h.start() + b))
                    parts.append((free, h.start() + a))
                    free = h.start() + b
        for lo, hi in [*parts, (free, len(run))]:
            lo, hi = unnamed(run, lo, hi)
            if hi - lo >= WINDOW:
                out += [(at + lo + a, 4, at + lo + b) for a, b in kept(run[lo:hi], THRESHOLD["entropy_base64"]) if classes(run[lo + a : lo + b]) > 1]
    return out


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans. Null is scanned as the empty text."""
    base = base_spans(text or "")
    return base, sorted(base + entropy_spans(text or ""))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list) -> str:
    """Every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kind, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{KINDS[kind]}]"]
        at, k = b, k + 1
    return "".join(out) + text[at:]


SPAN = "struct<kind:string,start:int,end:int>"


def scan(docs: DataFrame, carry: list[str], text: str = "text", redact: bool = False) -> DataFrame:
    """``carry`` columns as struct ``row``, base_spans and spans (arrays of kind, start, end in code points), and with ``redact`` the redacted text.

    Null text: no spans, null redacted text. One row per input row, repeated rows alike; empty input gives an empty table.
    """
    src = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))

    @F.pandas_udf(f"struct<base:array<{SPAN}>,spans:array<{SPAN}>,redacted:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.tidy()
        for texts in batches:
            for lo, hi in common.slices(texts):
                yield found(texts[lo:hi])

    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = scan_text(t)
            as_ = lambda xs: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in xs]
            changed = redacted(t, spans) if redact and t is not None and spans else None
            rows.append((as_(base), as_(spans), changed))
        return pd.DataFrame(rows, columns=["base", "spans", "redacted"])

    df = src.withColumn("f", find("text"))
    return df.select("row", F.col("f.base").alias("base_spans"), F.col("f.spans").alias("spans"), *([F.coalesce("f.redacted", "text").alias("redacted")] if redact else []))


def query(spark, sf_dir: str) -> DataFrame:
    df = scan(common.table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return df.select("row.doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the new text where a secret was found."""
    df = scan(docs, docs.columns, redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
