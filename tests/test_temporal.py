import datetime as dt
import random

from ledgerlake.operators.temporal import asof_join, asof_lookup, first_sights, ttl_replay

START = dt.datetime(2024, 3, 1)
SCHEMA = "key string, ts timestamp, id long, value long"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def events(rng, n, keys, span):
    """A third of all rows has one key; times repeat."""
    return [(rng.choice(keys) if i % 3 else "hot", at(rng.randrange(span)), i, rng.randrange(100)) for i in range(n)]


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(1)
    rows = events(rng, 400, ["a", "b", "c", "d"], 40_000)
    writes, reads = [r for r in rows if r[2] % 4 == 0], [r for r in rows if r[2] % 4]
    reads += [("a", None, 900, 1), (None, at(5), 901, 1), ("none", at(7), 902, 1)]
    writes += [(None, at(1), 903, 1), ("a", None, 904, 1)]
    for bucket in (600, 3600, 10_000_000):
        got = asof_join(spark.createDataFrame(reads, SCHEMA), spark.createDataFrame(writes, SCHEMA), ["key"], "ts", "id", ["value"], bucket_seconds=bucket).collect()
        want = {}
        for key, ts, i, _ in reads:
            held = [w for w in writes if key is not None and ts is not None and w[0] == key and w[1] is not None and (w[1], w[2]) <= (ts, i)]
            best = max(held, key=lambda w: (w[1], w[2]), default=(None, None, None, None))
            want[i] = (best[2], best[3], best[1])
        assert {r["id"]: (r["v_id"], r["v_value"], r["v_ts"]) for r in got} == want


def test_entries_expire_at_each_read(spark):
    writes = spark.createDataFrame([("k", at(0), 1, 10), ("k", at(500), 2, 20)], SCHEMA)
    reads = spark.createDataFrame([("k", at(t), 100 + t, 0) for t in (0, 99, 100, 499, 500, 599, 600)] + [("k", at(-1), 50, 0)], SCHEMA)
    out = {r["id"]: (r["outcome"], r["v_value"]) for r in asof_lookup(reads, writes, ["key"], "ts", "id", ["value"], 100).collect()}
    assert out == {50: ("miss", None), 100: ("hit", 10), 199: ("hit", 10), 200: ("expired", 10), 599: ("expired", 10), 600: ("hit", 20), 699: ("hit", 20), 700: ("expired", 20)}
    assert all(r["outcome"] != "expired" for r in asof_lookup(reads, writes, ["key"], "ts", "id", ["value"], None).collect())


def walk(rows, ttl, anchors=()):
    held, out = dict(anchors), {}
    for key, ts, i, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in held or ts >= held[key][0] + dt.timedelta(seconds=ttl):
            held[key] = (ts, i)
        out[i] = held[key][1]
    return out


def test_replay_equals_a_walk_in_order(spark):
    rng = random.Random(2)
    rows = events(rng, 600, ["a", "b", "c"], 50_000) + [(None, at(3), 7000, 0), ("a", None, 7001, 0)]
    for ttl in (10, 700, 9_000, 100_000):
        want = walk(rows, ttl)
        got = {r["id"]: (r["v_id"], r["outcome"]) for r in ttl_replay(spark.createDataFrame(rows, SCHEMA), ["key"], "ts", "id", ttl).collect()}
        assert {i: got[i] for i in want} == {i: (f, "filled" if i == f else "hit") for i, f in want.items()}
        assert got[7000] == got[7001] == (None, None)


def test_sights_go_on_from_anchors(spark):
    rng = random.Random(3)
    rows = events(rng, 300, ["a", "b"], 20_000)
    early, late = [r for r in rows if r[1] < at(9_000)], [r for r in rows if r[1] >= at(9_000)]
    sights = {i for i, f in walk(rows, 1_500).items() if i == f}
    one = first_sights(spark.createDataFrame(early, SCHEMA), ["key"], "ts", "id", 1_500)
    anchors = one.groupBy("key").agg({"ts": "max"}).withColumnRenamed("max(ts)", "ts")
    two = first_sights(spark.createDataFrame(late, SCHEMA), ["key"], "ts", "id", 1_500, anchors)
    assert {r["id"] for r in one.collect()} | {r["id"] for r in two.collect()} == sights
    assert first_sights(spark.createDataFrame([], SCHEMA), ["key"], "ts", "id", 60).count() == 0


def test_walked_and_pointed_sights_are_the_same(spark):
    """Keys are walked where they are small; large ones, and odd rows, go by pointers. Events that come twice stay twice."""
    rng = random.Random(5)
    rows = events(rng, 300, ["a", "b", "c"], 25_000)
    rows += rows[:40] + [("a", at(9), None, 1), ("z", at(1), 3, 1), ("z", at(1), 2, 1), (None, at(3), 7000, 0), ("a", None, 7001, 0)]
    told = spark.createDataFrame(rows, SCHEMA)
    anchors = spark.createDataFrame([("b", at(100)), ("c", at(5)), ("c", at(900)), ("q", at(3)), (None, at(1))], "key string, ts timestamp")
    for old in (None, anchors):
        all_pointed, mixed, walked = (sorted(map(str, first_sights(told, ["key"], "ts", "id", 700, old, walked_rows=n).collect())) for n in (0, 90, 10**6))
        assert all_pointed == mixed == walked and len(walked) > 40


def test_small_keys_are_walked_after_one_shuffle(spark):
    told = spark.createDataFrame([("a", at(1), 1, 0), ("a", at(5), 2, 0), ("b", at(5), 3, 0)], SCHEMA)
    plan = first_sights(told, ["key"], "ts", "id", 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
