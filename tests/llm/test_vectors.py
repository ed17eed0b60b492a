import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import ann_blocks, topk

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<float>, rank int, block string")


def sample(rng, n, dim=12):
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(30)]  # many ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [NAN] * dim), (2080, [INF] + [0.1] * (dim - 1)), (2100, [None] + [0.1] * (dim - 1)),
             (2120, [0.5] * (dim + 1)), (2140, [0.25] * (dim + 1)), (None, [0.1] * dim), rows[3], rows[20]]
    return rows


def brute(rows, every, k, turn, zeros):
    ok = {i: [turn(x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v))}
    out = []
    for q, v in ok.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_nearest_matches_brute_force(spark):
    rows = sample(random.Random(1), 300)
    for k, size in ((20, 2048), (3, 16)):
        got = ann_blocks.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=k, query_rows=4, block_rows=size).collect()
        want = brute(rows, 20, k, float, False)
        assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [w[:3] for w in want]
        assert np.allclose([r.score for r in sorted(got)], [w[3] for w in want], atol=1e-15)


def test_top_k_matches_brute_force(spark):
    rows = sample(random.Random(2), 300)
    for k, parts, size in ((5, 2, 2048), (2, 3, 16), (500, 2, 64)):
        got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k=k, parts=parts, query_rows=3, block_rows=size).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 50, k, lambda x: math.floor(256 * x), True)


def test_few_rows_and_empty_tables(spark):
    one = table(spark, [(0, [1.0, 2.0])])
    for frame in (one, one.limit(0)):
        assert ann_blocks.nearest(frame, F.col("vec_id") % 20 == 0).count() == 0
        assert topk.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0
    two = table(spark, [(0, [1.0, 2.0]), (1, [-1.0, 0.5])])
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, -256 * 256 + 512 * 128)]


def test_error_bounds_hold():
    rng = np.random.default_rng(4)
    for dims in (3, 64, 1500):
        x, y = rng.normal(size=(20, dims)), rng.normal(size=(30, dims)) * 10
        near, error = ann_blocks.tile(*ann_blocks.quantise(x), *ann_blocks.quantise(y))
        assert (np.abs(x @ y.T - near) <= error).all()


def test_large_integers_are_exact():
    q, r = np.array([[2.0 ** 30, 3.0]]), np.array([[2.0 ** 30, 5.0]])
    assert topk.product(q, r)[0, 0] == 2 ** 60 + 15
