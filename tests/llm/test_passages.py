"""Repeated spans against brute force."""

import random
import re

from recordlink.llm import passages

DOCS = "doc_id long, text string"


def brute(texts, n=passages.SPAN):
    """doc -> words that lie in a window of n words which another document also has."""
    words = {d: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for d, t in texts}
    where: dict = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(x[2] for x in w[i : i + n]), set()).add(d)
    out = {}
    for d, w in words.items():
        hit = {j for i in range(len(w) - n + 1) if len(where[tuple(x[2] for x in w[i : i + n])]) > 1 for j in range(i, i + n)}
        if hit:
            out[d] = {w[j][:2] for j in hit}
    return out


def covered(rows, texts):
    out: dict = {}
    for r in rows:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", dict(texts)[r.doc_id])]
        inside = [w for w in words if r.start <= w[0] and w[1] <= r.end]
        assert (inside[0][0], inside[-1][1], len(inside)) == (r.start, r.end, r.n_words)
        out.setdefault(r.doc_id, set()).update(inside)
    return out


def test_spans_do_not_depend_on_line_ends(spark):
    """A 60-word passage inside longer lines, one over short lines, one of 50 words; 49 words, null, short and unrelated texts are left alone."""
    r = random.Random(8)
    some = lambda n: [f"é{r.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = some(60), some(60), some(50), some(49)
    short = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [
        (1, " ".join(some(70) + a + some(80))), (2, "x\n" + " ".join(some(90) + [x.upper().replace("É", "é") for x in a] + some(75)) + "\nz"),
        (3, short(some(30) + b + some(30), 7)), (4, short(some(11) + b + some(44), 9)),
        (5, " ".join(some(20) + c)), (6, " ".join(c + some(20))),
        (7, " ".join(some(40) + d + some(40))), (8, " ".join(some(40) + d + some(40))),
        (9, None), (10, ""), (11, "one two"), (12, " ".join(some(400))),
    ]
    rows = passages.repeated_passages(spark.createDataFrame([*texts, (None, texts[0][1])], DOCS)).collect()
    assert covered(rows, texts) == brute(texts)
    assert sorted((x.doc_id, x.n_words, x.first_doc_id, x.removed) for x in rows) == [(1, 60, 1, False), (2, 60, 1, True), (3, 60, 3, False), (4, 60, 3, True), (5, 50, 5, False), (6, 50, 5, True)]


def test_spans_match_brute_force(spark):
    """Texts cut together from a few passages, with copies, overlaps and repeats within a text."""
    r = random.Random(9)
    pool = [[f"w{r.randrange(5000)}" for _ in range(r.randrange(20, 140))] for _ in range(25)]
    texts = []
    for i in range(60):
        w: list = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            lo = r.randrange(len(p) // 2)
            w += p[lo : lo + r.randrange(10, 120)] + [f"u{r.randrange(10**7)}" for _ in range(r.randrange(0, 30))]
        texts.append((i, "".join(x + r.choice(" \n") for x in w)))
    want = brute(texts)
    assert len(want) > 20
    assert covered(passages.repeated_spans(spark.createDataFrame(texts, DOCS)).collect(), texts) == want


def test_runs_over_segments(monkeypatch):
    import numpy as np

    w = np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 1000, np.uint64)
    whole = passages.runs(w, passages.SPAN)
    monkeypatch.setattr(passages.jaccard, "_SEG", 128)
    assert (passages.runs(w, passages.SPAN) == whole).all() and len(whole) == 951
    assert not len(passages.runs(w[:49], passages.SPAN))


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def _some(r, n):
    return " ".join(f"é{r.randrange(10**6)}" for _ in range(n))


def test_parities_are_exact_beside_repeats():
    """a paragraph that repeats has no parities of its own, and those of the others keep all 64 bits (they went through doubles, which lost links)."""
    import pandas as pd

    r = random.Random(10)
    lines = [_some(r, r.randrange(20, 400)) for _ in range(700)]
    batch = pd.DataFrame({"doc_id": range(351), "text": ["\n".join(lines[i : i + 2]) for i in range(0, 700, 2)] + [lines[0]]})
    want = {}
    for spans, h, begins in passages._paragraphs(batch["text"]):
        for a, b in zip(begins, [*begins[1:], len(h)]):
            want[passages.jaccard.class_key(h[a:b])] = passages.jaccard.parities(h[a:b]).tolist()
    rows = pd.concat(passages._scan(iter([batch])))
    assert len(rows) == 701 and rows["bands"].isna().sum() == rows["b0"].isna().sum() == 1
    first = rows[rows["bands"].notna()]
    assert {c: x for c, *x in first[["c", *passages.jaccard.BITS]].itertuples(index=False)} == want


def test_texts_are_taken_many_at_a_time():
    """one table of windows for many texts, not one for each, with what each text has alone; null, empty, short and repeated ids among them."""
    import numpy as np
    import pandas as pd

    r = random.Random(11)
    texts = [None, "", "a b", _some(r, 49), *(_some(r, r.randrange(50, 130)) for _ in range(80)), "one " * 200, "x" * 600_000 + " " + _some(r, 60), None]
    batch = pd.DataFrame({"doc_id": [i // 2 for i in range(len(texts))], "text": texts})
    alone = [batch[i : i + 1].reset_index(drop=True) for i in range(len(batch))]
    prints = pd.concat(passages._fingerprints(iter([batch])))
    assert prints.values.tolist() == [x for one in alone for f in passages._fingerprints(iter([one])) for x in f.values.tolist()]
    f = np.unique(prints["f"])
    wanted = lambda pdf: pdf.assign(one=[f[::2]] * len(pdf), many=[f[1::2]] * len(pdf))
    found = list(passages._windows(iter([wanted(batch)])))
    rows = sorted(x for one in alone for w in passages._windows(iter([wanted(one)])) for x in w.astype("int64").values.tolist())
    assert len(found) == 1 and len(rows) > 1000
    assert sorted(found[0].astype("int64").values.tolist()) == rows
