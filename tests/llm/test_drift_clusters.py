import hashlib
import random

import numpy as np
import pytest

from ledgerlake.llm import drift_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, data string, upper double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "d", 0.5) for i, v in rows], SCHEMA)


def brute(rows, dim, k, rounds=5):
    """Lloyd's rounds with Python integers, every distance computed."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, own[c], sum(own.values()), names[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


def sample(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


def test_matches_brute_force(spark):
    for seed, dim, k, spread, scale in ((1, 3, 4, 0.6, 1.0), (2, 8, 12, 0.3, 1.0), (3, 5, 7, 0.5, 40_000.0)):
        rng = random.Random(seed)
        rows = [(i, [x * scale for x in v]) for i, v in sample(rng, 260, dim, spread)]
        rows += [(900, None), (901, []), (902, [0.0] * dim), (903, [float("nan")] * dim), (904, [None] * dim), (905, [1.0] * (dim + 1)), (None, [0.5] * dim), rows[3], rows[4]]
        got = drift_clusters.cluster(frame(spark, rows), clusters=k, dim=dim, block_rows=40).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, dim, k)


def test_bounds_save_scans(spark):
    rng = random.Random(4)
    trace = []
    drift_clusters.cluster(frame(spark, sample(rng, 2000, 6, 0.05)), clusters=8, dim=6, trace=trace).count()
    assert trace[0] == 2000 and max(trace[2:]) < 1000 and trace[-1] < 500


def test_fewer_vectors_than_clusters_and_empty_table(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.1])]
    got = drift_clusters.cluster(frame(spark, rows), dim=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 2, 40)
    assert drift_clusters.cluster(frame(spark, rows).limit(0), dim=2).collect() == []


def test_components_that_do_not_fit_stop_the_job(spark):
    with pytest.raises(Exception, match="OverflowError"):
        drift_clusters.cluster(frame(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), dim=2).collect()


def test_loosening_bounds_the_loss_and_is_below_the_drift():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(300):
        dim, k = rng.integers(2, 7), 5
        old = rng.normal(size=(k, dim)) * 3
        new = old + rng.normal(size=(k, dim)) * rng.choice([0.05, 0.5, 3])
        radius = rng.uniform(0.01, 4, k)
        lost = drift_clusters.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(k):
            way = rng.normal(size=(200, dim))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, 200)[:, None]
            others = [j for j in range(k) if j != i]
            loss = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            assert loss <= lost[i] + 1e-9 and lost[i] <= max(drift[others]) + 1e-9
            tighter += lost[i] < 0.9 * max(drift[others])
    assert tighter > 300
