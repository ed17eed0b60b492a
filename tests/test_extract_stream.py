import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.operators import extract as X
from ledgerlake.operators import stats as ST


def test_chunks_reassemble(spark):
    df = spark.createDataFrame([(1, '{"vendor":"Acme","total":40.59,"line_items":[]}'), (2, "")],
                               "id long, text string")
    ch = X.chunk_text(df, "text")
    assert ch.filter("id = 2").count() == 0 and ch.filter("id = 1").count() > 1
    back = X.reassemble(ch, ["id"]).first()
    assert back["text"] == '{"vendor":"Acme","total":40.59,"line_items":[]}'


def test_cumulative_to_delta(spark):
    steps = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab"), (1, 2, "abcd"), (1, 3, "abcdef")],
                                  "id long, step int, cumulative string")
    out = [r["delta"] for r in X.cumulative_to_delta(steps, ["id"]).orderBy("step").collect()]
    assert out == ["ab", "cd", "ef"]


def test_request_metrics(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0), (1, t0 + dt.timedelta(milliseconds=10)), (1, t0 + dt.timedelta(seconds=2)),
            (2, t0)]
    df = spark.createDataFrame([(u, t, i) for i, (u, t) in enumerate(rows)], "user_id long, ts timestamp, event_id long")
    m = {r["user_id"]: r for r in X.request_metrics(X.request_marks(df, ["user_id"])).collect()}
    assert m[1]["ttft_ms"] == 10.0 and m[1]["total_ms"] == 2000.0
    assert m[1]["tokens_per_second"] == round(3 / 1.99, 2)
    assert m[2]["ttft_ms"] is None and m[2]["tokens_per_second"] == 0.0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double").repartition(7)
    shares = [0.0, 0.3, 0.5, 0.6180339, 0.99, 1.0]
    assert np.allclose(ST.exact_percentiles(df, "v", shares), np.quantile(vals, shares), atol=1e-12)
    assert ST.exact_percentiles(df.where("v > 99"), "v", [0.5]) == [None]
    assert ST.exact_percentiles(df.where("v = 0.25"), "v", [0.0, 0.5, 1.0]) == [0.25] * 3


def test_batch_extract_retries_and_failures(spark):
    def factory():
        calls = {"n": 0}

        def engine(doc):
            calls["n"] += 1
            if doc == "bad":
                raise RuntimeError("down")
            if calls["n"] % 2 == 1:
                raise TimeoutError("flaky")
            return doc.upper()
        return engine

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, text string").coalesce(1)
    out = {r["id"]: r for r in X.batch_extract(df, "text", factory).collect()}
    assert out[1]["raw_output"] == "OK" and out[1]["attempts"] == 2 and out[1]["error"] is None
    assert out[2]["raw_output"] == "" and out[2]["attempts"] == 3 and "down" in out[2]["error"]


def test_ttl_first_sights_stream(spark, tmp_path):
    from ledgerlake.streaming import streams as S
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 10, 86_399, 86_400, 86_500, 200_000]
    pdf = [(1, "view", i, t0 + dt.timedelta(seconds=s), 1.0) for i, s in enumerate(times)]
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tmp_path / "src"
    src.mkdir()
    frame = pd.DataFrame(pdf, columns=["user_id", "event_type", "event_id", "ts", "value"])
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), str(src / "events.parquet"),
                   coerce_timestamps="us")
    ev = S.stream_table(spark, str(src), "events").select("user_id", "event_type", "event_id", "ts")
    out = S.run_available_now(S.ttl_first_sights(ev, ["user_id", "event_type"], 86_400, "1 day"), "t")
    assert sorted(r["event_id"] for r in out.collect()) == [0, 3, 5]


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    from ledgerlake.streaming import streams as S
    rows = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(1704067200 + id * 977) AS ts",
                                       "'view' AS event_type", "0.1D AS value")
    rows.coalesce(1).write.parquet(str(tmp_path / "whole"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "whole").glob("part-*")).rename(tmp_path / "one" / "events.parquet")
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "events.parquet"))
    seen = []
    for folder in ("one", "many"):
        events = S.stream_table(spark, str(tmp_path / folder), "events").select("user_id", "event_type", "event_id", "ts", "value")
        first = S.run_available_now(S.ttl_first_sights(events.drop("value"), ["user_id", "event_type"], 86_400, "1 day"), "first")
        windows = S.run_available_now(S.windowed_metrics(events), "windows")
        seen.append((sorted(r["event_id"] for r in first.collect()), sorted(tuple(r) for r in windows.collect())))
    assert seen[0] == seen[1] and len(seen[0][0]) > 7 and len(seen[0][1]) > 50


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    rows = [(i, f"doc {i % 60}") for i in range(200)] + [(900, None), (901, "bad"), (902, "bad")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)

    def factory():
        import os
        import uuid

        def engine(doc):
            with open(os.path.join(str(log), uuid.uuid4().hex), "w") as f:
                f.write(doc)
            if doc == "bad":
                raise RuntimeError("down")
            return doc.upper()
        return engine

    def calls():
        return sorted(p.read_text() for p in log.iterdir())

    ledger, engine = str(tmp_path / "ledger"), X.called(factory, max_attempts=2, workers=3)
    half = {r.id: r.raw_output for r in X.resumable_extract(df, "text", ledger, engine, waves=5, only=2).collect()}
    first = calls()
    assert 0 < len(first) < 62 and len(set(half.values())) > 5 and None in half.values()
    # a run that died in its third wave has left files without their marker
    (tmp_path / "ledger" / "wave=2").mkdir()
    (tmp_path / "ledger" / "wave=2" / "part-0.parquet").write_bytes(b"half")
    out = {r.id: (r.raw_output, r.error) for r in X.resumable_extract(df, "text", ledger, engine, waves=5).collect()}
    assert calls() == sorted([f"doc {i}" for i in range(60)] + ["bad"] * 2)
    assert all(out[i] == (f"DOC {i % 60}", None) for i in range(200)) and out[900] == (None, None) and out[901] == out[902] == ("", "RuntimeError: down")
    X.resumable_extract(df, "text", ledger, engine, waves=5).collect()
    assert len(calls()) == 62
