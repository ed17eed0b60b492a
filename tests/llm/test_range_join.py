import math
import random

import numpy as np

from ledgerlake.llm import range_join

SCHEMA = "vec_id long, embedding array<double>, label int, part string, cell int, n long, node long"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "p", 1, 2, 3) for i, v, c in rows], SCHEMA)


def brute(rows, cosine):
    held = {}
    for i, v, c in rows:
        fine = i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        held[i] = max(held.get(i, ()), (f"{len(v)}:{c}", v) if fine else ())
    near = {i: set() for i in held}
    for a, x in held.items():
        for b, y in held.items():
            if a != b and x and y and x[0] == y[0]:
                p, q = np.array(x[1]), np.array(y[1])
                if p @ q / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= cosine:
                    near[a].add(b)
    least = {i: i for i in held}
    moved = True
    while moved:
        moved = False
        for a in held:
            for b in near[a]:
                if least[b] < least[a]:
                    least[a], moved = least[b], True
    return sorted(((i, len(near[i]), least[i], i is None or least[i] == i) for i in held), key=repr)


def sample(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, spread) for x in centres[i % 12]], rng.choice([1, 1, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[7][1], rows[7][2]) for i in range(40)]  # copies
    rows += [(n + 50 + i, [3 * x for x in rows[8][1]], rows[8][2]) for i in range(3)]  # same direction
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * dim, 1), (5003, [NAN] * dim, 1), (5004, [None] * dim, 1), (5005, rows[9][1], None), (5006, [1.0] * (dim + 1), 1),
             (5007, [1.0] * (dim + 1), 1), (None, rows[9][1], 1), (None, rows[9][1], 1), rows[3], rows[4], (5008, rows[1][1], 1), (5008, rows[2][1], 2)]
    return rows


def test_matches_brute_force(spark):
    for seed, dim, spread, size, copies in ((1, 4, 0.15, 16, 8), (2, 8, 0.25, 2048, 8), (3, 3, 0.4, 8, 2), (4, 6, 0.05, 20, 100)):
        rows = sample(random.Random(seed), 260, dim, spread)
        got = range_join.near_vectors(frame(spark, rows), cell_rows=size, max_copies=copies, block_rows=12).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 0.93)


def test_empty_and_single(spark):
    one = frame(spark, [(4, [1.0, 2.0], 1)])
    assert [tuple(r) for r in range_join.near_vectors(one).collect()] == [(4, 0, 4, True)]
    assert range_join.near_vectors(one.limit(0)).count() == 0


def test_every_pair_in_range_meets():
    rng = np.random.default_rng(6)
    for cosine in (0.5, 0.93, 0.99):
        x = range_join.units(rng.normal(size=(400, 5)))
        p, limit = x[:9], range_join.reach(cosine)
        d = range_join.distances(x, p)
        own = d.argmin(axis=1)
        radius = np.array([d[own == j, j].max(initial=0) for j in range(9)])
        copied = range_join.guests(d, own, range_join.distances(p, p), radius, limit)
        a, b = np.nonzero(range_join.in_range(x, x, cosine))
        assert all(own[i] == own[j] or copied[j, own[i]] for i, j in zip(a.tolist(), b.tolist()))
        if cosine == 0.99:
            assert copied.mean() < 0.5  # most copies are spared


def test_forest_connects_what_hits_connect():
    rng = np.random.default_rng(7)
    for share in (0.02, 0.1, 0.6):
        hit = rng.uniform(size=(40, 50)) < share
        rr, rc = range_join.forest(hit)
        assert len(rr) + len(rc) < 90

        def parts(edges):
            root = list(range(90))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in edges:
                root[find(x)] = find(y)
            return {frozenset(i for i in range(90) if find(i) == r) for r in map(find, range(90))}

        assert parts(rr + [(i, 40 + j) for i, j in rc]) == parts([(i, 40 + j) for i, j in zip(*np.nonzero(hit))])


def test_limit_at_the_border_is_exact():
    x = np.array([[1.0, 0.0]])
    y = np.array([[0.93, math.sqrt(1 - 0.93 ** 2)], [0.93, math.sqrt(1 - 0.93 ** 2) + 1e-12], [0.93, math.sqrt(1 - 0.93 ** 2) - 1e-12]])
    assert range_join.in_range(x, y, 0.93).tolist()[0] == (range_join.cosines(np.repeat(x, 3, axis=0), y) >= 0.93).tolist()
