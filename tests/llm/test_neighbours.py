"""Nearest neighbours against brute force: exact at factor one, with measured recall below it."""

import random

import duckdb
import numpy as np
import pytest

from recordlink.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1.0, 1) for i, v in rows], SCHEMA)


def inner(a, b):
    total = 0.0  # in order; the built-in sum compensates rounding
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k=20, every=20):
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            held[i] = min(held.get(i, v), v)
    out = []
    for q, a in held.items():
        if q % every == 0:
            scored = sorted(((-inner(a, b), i) for i, b in held.items() if i != q and len(a) == len(b)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def odd_vectors():
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # copies: ties to smaller ids
    rows += [(3000 + i, [float(r.randrange(-2, 3)) for _ in range(8)]) for i in range(200)]  # many equal products
    rows += [(4000, None), (4020, []), (4040, [0.0] * 8), (4060, [None] * 8), (4080, [float("nan")] * 8), (4100, [float("inf")] + [1.0] * 7), (4120, [1.0, 2.0]), (4121, [2.0, 2.0]), (None, [1.0] * 8)]
    return [*rows, rows[0], rows[0], (40, [9.0] * 8), (-20, [1.0] * 8), (4140, [1e-30] * 8)]


@pytest.mark.parametrize("leaf", [128, 5])
def test_exact_at_factor_one(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 512)
    rows = odd_vectors()
    got = neighbours.nearest(frame(spark, rows)).drop("seen").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_huge_components(spark):
    rows = [(i, [1e38 * (i % 3 - 1), float(i + 1)]) for i in range(50)]
    assert sorted(map(tuple, neighbours.nearest(frame(spark, rows)).drop("seen").collect())) == brute(rows)


def test_squares_that_overflow():
    x = np.array([[1e200, 1.0], [-1e200, 2.0], [1.0, 3.0], [0.5, 0.5]])
    s = neighbours.Search(np.array([9, 2]), np.array([[1.0, 1.0], [1e200, 0.0]]), 2, 1.0)
    s.visit(neighbours.Tree(np.arange(4), x))
    assert s.near[0].tolist() == [0, 2] and s.near[1].tolist() == [0, 3]


def test_recall_falls_gently_with_the_factor(spark):
    r = np.random.default_rng(1)
    x = (r.normal(size=(40, 16))[r.integers(40, size=6000)] + 0.25 * r.normal(size=(6000, 16))).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).cache()
    kinds = {}
    for f in (1.0, 0.8, 0.5):
        got = neighbours.nearest(df, factor=f).collect()
        kinds[f] = ({(g.query_id, g.vec_id) for g in got}, sum(g.seen for g in got))
    truth = kinds[1.0][0]
    assert len(truth) == 300 * 20
    recall = {f: len(truth & found) / len(truth) for f, (found, _) in kinds.items()}
    assert recall[0.8] >= 0.9 and kinds[0.5][1] < kinds[0.8][1] < kinds[1.0][1] < 300 * 6000


def test_query_is_the_sqls(spark, tmp_path):
    frame(spark, odd_vectors()).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = (sorted((*r[:3], round(r[3], 9)) for r in rows) for rows in (neighbours.query(spark, str(tmp_path)).collect(), con.execute(neighbours.SQL).fetchall()))
    assert got == want


def test_no_vectors(spark):
    assert neighbours.nearest(frame(spark, [])).collect() == [] == neighbours.nearest(frame(spark, [(20, [1.0])])).collect()
