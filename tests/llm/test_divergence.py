"""Divergence of sources against its SQL and against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest

from recordlink.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, share long, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def some_documents(n=400):
    r = random.Random(3)
    words = [f"{x}{y}" for x in ("Wort", "été", "x", "Ñandú", "日本") for y in ("", "a", "Bc", "É", "İ")]
    rows = []
    for i in range(n):
        text = r.choice(["-", " ", "_", "9", "\x00", "\n"]).join(r.choices(words, k=r.randrange(1, 60)))
        rows.append((i, r.choice([text, text, text, None, "", "123 --"]), r.choice(["en", "en", "de", None, ""]), r.choice(["a", "b", "c", "日", None, "é"])))
    rows += [rows[0]] * 30 + [(n + i, "rare only here", "fr", f"s{i}") for i in range(3)] + [(n + 9, "word " * 30_000 + "Ab", "en", "long"), (n + 10, "x" * 300_000, "en", "long")]
    return rows


def expected(rows):
    docs = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, n = Counter(), {}
        for _, source, found in (d for d in docs if d[0] == lang):
            df.update(set(found))
            n.setdefault(source, Counter()).update(found)
        kept = [t for t in df if df[t] >= 30]
        whole = sum(n.values(), Counter())
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, ps = p(whole), {s: p(c) for s, c in n.items()}
        for s in ps:
            pair = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in ps if o != s]
            term = [(t, ps[s][t] - q[t]) for t in kept if n[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, 50)):
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 3)])
def test_audit_is_exact(spark, monkeypatch, blocks):
    """Also where every language is cut to many cells, and tasks send their sums early."""
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", blocks[0])
    monkeypatch.setattr(divergence, "BLOCK_TERMS", blocks[1])
    rows = some_documents()
    got = divergence.audit(spark.createDataFrame([(*r, "t", 1, "v") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_query_is_the_sqls(spark, tmp_path):
    rows = some_documents(200)
    spark.createDataFrame([(*r, "t", 1, "v") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, divergence.query(spark, str(tmp_path)).collect())) == sorted(con.execute(divergence.SQL).fetchall())


def test_sums_of_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 30_000_000_000_001, 7), (0, 0, 1), (0, 10**15, 10**6)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(df.n, df.total, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in ((9_000_000_000_000, 30_000_000_000_001, 7), (0, 0, 1), (0, 10**15, 10**6))]


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
