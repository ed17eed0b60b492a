import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import normalize_text
from ledgerlake.operators import reuse as R
from ledgerlake.operators.embed import hash_embed, slot_counts
from ledgerlake.operators.graph import components
from ledgerlake.operators.similarity import Boxes, collision_pairs, collisions, fit_boxes, nearest, pairs_above

# A delivery note, the same in other writing, with a remark, and one of another load.
NOTE = "Delivery note 5512 from Harbour Timber: nine pallets of oak boards, 14 bundles of lath, gross 2310 kg, berth 6"
SAME = "  DELIVERY NOTE 5512\nfrom Harbour Timber:\tnine pallets of oak boards, 14 bundles of lath, gross 2310 kg, BERTH 6 "
REMARK = NOTE + " received"
OTHER = NOTE.replace("2310", "2475").replace("5512", "5513")
UNLIKE = "the lift in the east wing stops between floors again"


def _keyed(spark, texts):
    return R.keyed(spark.createDataFrame(list(enumerate(texts)), "probe_id long, text string"))


def _store(spark, *entries):
    """Store and its vectors from (text, answer) written in this order."""
    writes = R.keyed(spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(entries)], "w long, text string, answer string"))
    return R.store_upsert(writes, "exact_key", ["w"], ["answer", "digits"]), R.vectors(writes)


def _lookup(spark, store, texts, **opts):
    out = R.two_tier_lookup(_keyed(spark, texts), *store, "probe_id", **opts)
    return {r["probe_id"]: r for r in out.collect()}


def test_tiers(spark):
    out = _lookup(spark, _store(spark, (NOTE, "load A")), [NOTE, SAME, REMARK, OTHER, UNLIKE], threshold=0.85)
    assert [out[i]["outcome"] for i in range(5)] == ["exact", "exact", "semantic", "guard_rejected", "miss"]
    assert [out[i]["answer"] for i in range(5)] == ["load A"] * 3 + [None, None]
    assert 0.95 <= out[2]["similarity"] < 1.0 == out[0]["similarity"]


def test_guard_and_tier_can_be_switched_off(spark):
    store = _store(spark, (NOTE, "load A"))
    free = _lookup(spark, store, [OTHER], threshold=0.5, require_numeric_match=False)[0]
    assert (free["outcome"], free["answer"]) == ("semantic", "load A")
    off = _lookup(spark, store, [NOTE, REMARK], semantic_enabled=False)
    assert [off[i]["outcome"] for i in (0, 1)] == ["exact", "miss"]


def test_expired_entries_answer_in_no_tier(spark):
    store, held = _store(spark, (NOTE, "load A"), (UNLIKE, "lift"))
    start = dt.datetime(2024, 3, 1)
    store = store.withColumn("written_at", F.when(F.col("answer") == "lift", F.lit(start + dt.timedelta(hours=5))).otherwise(F.lit(start)))
    for hours, want in ((23, ["exact", "semantic", "exact"]), (24, ["miss", "miss", "exact"]), (29, ["miss", "miss", "miss"])):
        now = F.lit(start + dt.timedelta(hours=hours))
        out = _lookup(spark, (store, held), [NOTE, REMARK, UNLIKE], now=now, ttl_seconds=86_400)
        assert [out[i]["outcome"] for i in range(3)] == want
        exact = R.exact_lookup(_keyed(spark, [NOTE, UNLIKE]), store, now=now, ttl_seconds=86_400).collect()
        assert sorted(r["tier"] or "" for r in exact) == sorted({"exact": "exact"}.get(w, "") for w in (want[0], want[2]))
    assert _lookup(spark, (store, held), [NOTE], now=F.lit(start + dt.timedelta(days=900)), ttl_seconds=None)[0]["outcome"] == "exact"


def test_last_write_wins_and_clear(spark, tmp_path):
    store, _ = _store(spark, (NOTE, "old"), (SAME, "new"))
    assert [(r["answer"], r["n_writes"]) for r in store.collect()] == [("new", 2)]
    path = str(tmp_path / "store")
    store.write.parquet(path)
    R.clear_store(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == store.columns


def test_counters(spark):
    out = R.two_tier_lookup(_keyed(spark, [NOTE, SAME, OTHER, UNLIKE]), *_store(spark, (NOTE, "load A")), "probe_id", threshold=0.85)
    snap = R.cache_snapshot(R.cache_stats(out), 0.85).first()
    assert (snap["exact_hits"], snap["semantic_hits"], snap["misses"], snap["guard_rejections"]) == (2, 0, 2, 1)
    assert snap["hit_ratio"] == 0.5 and snap["threshold"] == 0.85


def test_one_search_answers_every_copy(spark):
    out = _lookup(spark, _store(spark, (NOTE, "load A"), (OTHER, "load B")), [REMARK] * 60 + [REMARK.upper()] * 20 + [UNLIKE] * 5)
    assert [out[i]["outcome"] for i in range(85)] == ["semantic"] * 80 + ["miss"] * 5
    assert {out[i]["answer"] for i in range(80)} == {"load A"}


def test_hashed_counts_and_unit_vectors(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "a"), (4, None)], "k long, t string")
    counts = sorted((r["k"], r["dim"], r["c"]) for r in slot_counts(df, "k", "t").collect())
    # SHA-1 of a begins 86f7e437, of b e9d71f5e: slots 55 and 30 of 64
    assert counts == [(1, 30, 2), (1, 55, 1), (3, 55, 1)]
    vecs = {r["k"]: np.array(r["embedding"]) for r in hash_embed(df, "k", "t").collect()}
    assert set(vecs) == {1, 3} and vecs[1] @ vecs[3] == pytest.approx(1 / 5 ** 0.5) and vecs[1] @ vecs[1] == pytest.approx(1)


def test_plans_make_no_vector_where_none_is_wanted(spark):
    store, held = _store(spark, (NOTE, "load A"))
    plan = R.exact_lookup(_keyed(spark, [NOTE]), store)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha1" not in plan and "Generate" not in plan
    made = held._jdf.queryExecution().optimizedPlan().toString()
    assert "sha1" in made and "Python" not in made and "Arrow" not in made


def _random_vectors(spark, n, seed, dims=8):
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, dims))
    mat[3] = 0.0
    rows = [(int(i), [float(x) for x in mat[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>"), mat


def test_blocked_nearest_matches_brute_force(spark):
    probes, q = _random_vectors(spark, 37, 1)
    store, m = _random_vectors(spark, 53, 2)
    report = []
    got = {r["id"]: (r["match_key"], r["similarity"]) for r in
           nearest(probes, store, "id", "id", "v", threshold=0.3, block_rows=7, report=report).collect()}
    assert report[0] == 37 * 53 and report[0] >= report[1] >= report[2] > 0
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    mn = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = np.round(qn @ mn.T, 9)
    sims[:, 3] = -np.inf
    sims[3, :] = -np.inf
    want = {}
    for i in range(len(q)):
        j = int(np.argmax(sims[i]))
        if np.isfinite(sims[i, j]) and sims[i, j] >= 0.3:
            want[i] = (j, sims[i, j])
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9


def test_pairs_above_self_join(spark):
    vecs, m = _random_vectors(spark, 41, 3)
    got = {(r["a"], r["b"]) for r in pairs_above(vecs, vecs, "id", "id", "v", 0.6, self_join=True,
                                                 block_rows=6).collect()}
    mn = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = np.round(mn @ mn.T, 9)
    want = {(i, j) for i in range(41) for j in range(41) if i < j and i != 3 and j != 3 and sims[i, j] >= 0.6}
    assert got == want


def _families(rng, n, dims=16):
    """Counts like those of texts of a few templates, and the best match of every fifth among the others."""
    centres = rng.integers(0, 30, size=(12, dims))
    mat = np.abs(centres[rng.integers(0, 12, n)] + rng.integers(-2, 3, size=(n, dims))).astype(float)
    mat[7] = 0.0
    unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
    return mat, np.round(unit @ unit.T, 9)


def test_boxes_prune_and_lose_nothing(spark):
    rng = np.random.default_rng(11)
    mat, sims = _families(rng, 900)
    rows = [(f"k{i:04d}", [float(x) for x in mat[i]]) for i in range(900)] + [("k9990", None), ("k9991", [])]
    rows += [(f"k95{i:02d}", [float(x) for x in mat[11]]) for i in range(60)]  # equal vectors
    every = spark.createDataFrame(rows, "key string, v array<double>")
    probe = F.pmod(F.substring("key", 2, 4).cast("int"), F.lit(5)) == 0
    report = []
    got = {r["key"]: (r["match_key"], r["similarity"]) for r in
           nearest(every.where(probe), every.where(~probe), "key", "key", "v", 0.98, block_rows=16, report=report).collect()}
    want = {}
    for i in range(0, 900, 5):
        held = [j for j in range(900) if j % 5 and i != 7 and j != 7]
        j = max(held, key=lambda j: (sims[i, j], -j))
        if sims[i, j] >= 0.98:
            want[f"k{i:04d}"] = (f"k{j:04d}", sims[i, j])
    assert {k: v for k, v in got.items() if k in want} == want and all(k >= "k9500" for k in got.keys() - want.keys())
    assert report[1] < 0.5 * report[0] and report[2] < 0.3 * report[0]


def test_sketches_are_no_further_apart_than_vectors():
    rng = np.random.default_rng(12)
    x = np.abs(rng.normal(size=(400, 24)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    boxes = fit_boxes(x[:200], 16, 0.3)
    s = boxes.sketch(x)
    assert (s @ s.T >= x @ x.T - 1e-12).all()
    box = boxes.box_of(s)
    low = np.stack([s[box == b].min(axis=0) if (box == b).any() else np.full(s.shape[1], np.inf) for b in range(len(boxes.low))])
    high = np.stack([s[box == b].max(axis=0) if (box == b).any() else np.full(s.shape[1], -np.inf) for b in range(len(boxes.low))])
    touched = Boxes(boxes.directions, boxes.cuts, low, high).touched(s, 0.3)
    near = np.sqrt(np.clip(2 - 2 * x @ x.T, 0, None)) <= 0.3
    assert len(boxes.low) > 1 and all(touched[i, box[j]] for i, j in zip(*np.nonzero(near)))


def test_collisions_as_classes(spark):
    rng = np.random.default_rng(13)
    mat, sims = _families(rng, 300)
    tags = [None if i % 50 == 0 else str(int(t)) for i, t in enumerate(rng.integers(0, 4, 300))]
    rows = [(i, [float(x) for x in mat[i]], tags[i]) for i in range(300)]
    rows += [(300 + i, rows[11][1], rows[11][2]) for i in range(40)] + [(400 + i, rows[11][1], "other") for i in range(30)]
    got, links = collisions(spark.createDataFrame(rows, "id long, v array<double>, tag string"), "id", "v", "tag", 0.98, block_rows=16)
    unit = np.array([r[1] for r in rows])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    hit = (np.round(unit @ unit.T, 9) >= 0.98) & np.array([[a[2] != b[2] for b in rows] for a in rows])
    first = [next(b[0] for b in rows if b[1:] == a[1:]) for a in rows]
    found = {r["class_key"]: (r["n_entries"], r["n_collisions"]) for r in got.collect()}
    assert found == {first[i]: (first.count(first[i]), int(hit[i].sum())) for i in range(len(rows)) if hit[i].any()}
    family = {r["node"]: r["component"] for r in components(links).collect()}
    label = list(range(len(rows)))
    for _ in range(20):
        label = [min([label[j] for j in np.flatnonzero(hit[i])] + [label[i]]) for i in range(len(rows))]
    same = {}
    for i in range(len(rows)):
        if hit[i].any():
            assert same.setdefault(label[i], family[first[i]]) == family[first[i]]
    assert len(set(same.values())) == len(same) and links.count() < 5 * len(rows)


def test_collision_pairs_lists_every_pair(spark):
    rng = np.random.default_rng(29)
    mat, _ = _families(rng, 200)
    tags = [None if i % 50 == 0 else str(int(t)) for i, t in enumerate(rng.integers(0, 4, 200))]
    rows = [(i, [float(x) for x in mat[i]], tags[i]) for i in range(200)]
    rows += [(200 + i, rows[11][1], rows[11][2]) for i in range(9)] + [(300 + i, rows[11][1], "other") for i in range(7)]
    got = collision_pairs(spark.createDataFrame(rows, "id long, v array<double>, tag string"), "id", "v", "tag", 0.98, block_rows=16).collect()
    unit = np.array([r[1] for r in rows])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 9)
    want = {(x[0], y[0]): sims[i, j] for i, x in enumerate(rows) for j, y in enumerate(rows) if x[0] < y[0] and sims[i, j] >= 0.98 and x[2] != y[2]}
    assert len(got) == len(want) > 63 and all(abs(want[r["a"], r["b"]] - r["similarity"]) < 1e-8 for r in got)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(200, 200), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
