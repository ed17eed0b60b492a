import json
import os
import random
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators.stats import RANK_ERROR, merge_sketches, sketch_by, sketch_quantile
from ledgerlake.operators.store import KeyedStore
from ledgerlake.sources.io import numbered_lines, read_jsonl_head

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("value", T.StringType()), T.StructField("n", T.LongType())])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(path, "data")) for f in names if f.startswith("part-")}


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    rng = random.Random(1)
    store = KeyedStore(spark, str(tmp_path / "store"), SCHEMA, "key", ["at"], ["n"], digits=1)
    assert store.read().count() == 0 and store.versions() == []
    every, want = [], {}
    for version in range(3):
        first = "0123456789abcdef" if version == 0 else "3a"
        batch = [(rng.choice(first) + rng.choice("01234567"), version * 1000 + i, f"v{version}-{i}", 1) for i in range(300)] + [(first[-1] + "hot", version * 1000 + 400 + i, f"h{i}", 1) for i in range(150)]
        every += batch
        for key, at, value, n in batch:
            want[key] = max(want.get(key, (-1, "", 0))[:2], (at, value)) + (want.get(key, (0, 0, 0))[2] + n,)
        before = files(tmp_path / "store")
        assert store.upsert(spark.createDataFrame(batch, SCHEMA)) == version
        assert {r.key: (r.at, r.value, r.n) for r in store.read().collect()} == want
        after = files(tmp_path / "store")
        assert before <= after and {f.split("bucket=")[1][0] for f in after - before} == set(first)
    whole = KeyedStore(spark, str(tmp_path / "whole"), SCHEMA, "key", ["at"], ["n"], digits=1)
    whole.upsert(spark.createDataFrame(every, SCHEMA))
    assert sorted(whole.read().collect()) == sorted(store.read().collect())
    assert sum(r.n for r in store.read(version=0).collect()) == 450  # readers of an older version see it whole


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, "key", ["at"], ["n"])
    store.upsert(spark.createDataFrame([("aa1", 1, "x", 1)], SCHEMA))
    store.upsert(spark.createDataFrame([("aa1", 2, "y", 1), ("bb1", 2, "z", 1)], SCHEMA))
    os.remove(tmp_path / "commits" / "1" / "_SUCCESS")  # as if the second had failed before its end
    assert [(r.key, r.value) for r in store.read().collect()] == [("aa1", "x")]
    store.upsert(spark.createDataFrame([("cc1", 3, "w", 1)], SCHEMA))
    assert sorted((r.key, r.value) for r in store.read().collect()) == [("aa1", "x"), ("cc1", "w")]


def test_first_records_in_file_order(spark, tmp_path):
    rows = [{"id": f"r{i}", "text": "line " * (i % 7)} for i in range(500)]
    random.Random(2).shuffle(rows)
    for part in range(5):
        with open(tmp_path / f"part-{part}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" + "\n" * (r["id"].endswith("3")) for r in rows[part * 100:part * 100 + 100])
    schema = T.StructType.fromDDL("id string, text string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several blocks a file
    try:
        for n in (0, 1, 99, 137, 500, 900):
            got = sorted((r.position, r.id) for r in read_jsonl_head(spark, str(tmp_path), schema, n).collect())
            assert got == [(i, r["id"]) for i, r in enumerate(rows[:n])]
        assert numbered_lines(spark, str(tmp_path / "part-3.json")).count() == 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sketches_keep_their_rank_error_and_merge(spark):
    df = spark.range(400_000).select((F.col("id") % 8).alias("day"), (F.pow(F.rand(3), 4) * 5000).alias("x"), F.lit("g").alias("g"))
    df = df.unionByName(spark.createDataFrame([(1, None, "g")], "day long, x double, g string")).cache()
    days = sketch_by(df, ["day", "g"], "x")
    for by, one in ((["day", "g"], days), (["g"], merge_sketches(days, ["g"]))):
        for r in one.select(*by, "n", *[sketch_quantile("sketch", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.99))]).collect():
            values = sorted(v.x for v in (df.where(F.col("day") == r.day) if "day" in by else df).select("x").where("x is not null").collect())
            assert r.n == len(values)
            for i, q in enumerate((0.01, 0.5, 0.99)):
                low, high = bisect_left(values, r[f"q{i}"]) / len(values), bisect_right(values, r[f"q{i}"]) / len(values)
                assert low - 2 * RANK_ERROR <= q <= high + 2 * RANK_ERROR
            if "day" in by and r.day > 1:
                break
    few = spark.createDataFrame([("a", float(i)) for i in range(100)], "g string, x double")
    assert sketch_by(few, ["g"], "x").select(sketch_quantile("sketch", 0.5).alias("q")).first().q in (49.0, 50.0)


def test_json_lines_are_written_compressed(spark, tmp_path):
    from ledgerlake.sources.io import read_jsonl, write_jsonl
    rows = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, repeat('invoice line ', 20)) AS text")
    write_jsonl(rows, str(tmp_path / "lines"))
    parts = [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-")]
    assert parts and sum(p.stat().st_size for p in parts) < 5000 * 100
    back = read_jsonl(spark, str(tmp_path / "lines"), rows.schema)
    assert back.count() == 5000 and not back.exceptAll(rows).count()
