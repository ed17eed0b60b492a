"""One narrow pass over the texts of a lookup."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators import embed, reuse


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_counts_are_slot_counts_without_a_shuffle(spark):
    rows = [(1, "a b b c"), (2, ""), (3, None), (4, "ß  Ünï x"), (4, "x y")]
    norm = spark.createDataFrame(rows, "id int, text string").select("id", T.normalize_text("text").alias("norm"))
    assert "Exchange" not in _plan(embed.word_counts(norm, "norm"))
    got = {(r.id, d): c for r in embed.summed(embed.word_counts(norm, "norm"), "id", "words").collect() for d, c in enumerate(r.embedding) if c}
    assert got == {(r.id, r.dim): float(r.c) for r in embed.slot_counts(norm, "id", "norm").collect()}


def test_described_rows_look_up_like_texts_and_ship_no_text(spark):
    rows = [(1, "invoice 12 from acme"), (2, "invoice 12  from ACME"), (3, "other words"), (3, "other words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    told = reuse.described(docs)
    keys = reuse.keyed(docs).select("doc_id", "exact_key", "digits")
    assert sorted(map(str, told.select("doc_id", "exact_key", "digits").collect())) == sorted(map(str, keys.collect()))
    wanted = keys.groupBy("exact_key").agg(F.max("doc_id").alias("doc_id"))
    made, of_texts = (sorted(x.collect(), key=str) for x in (reuse.entry_vectors(told, "doc_id", wanted), reuse.text_vectors(docs, "doc_id", "text", wanted)))
    assert len(made) == 2 and made == of_texts
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-12 for r in made)
    assert "_text" not in _plan(reuse.text_vectors(docs, "doc_id", "text", wanted))


def test_one_pass_reads_every_character_as_the_column_functions_do(spark):
    """All code points, and bytes that are no UTF-8; the text is neither normalized nor hashed by Spark beside it."""
    rows = [(i, "x " + "".join(chr(c) for c in range(i * 256, i * 256 + 256) if not 0xD800 <= c < 0xE000) + " y") for i in range(0x110000 // 256)]
    odd = spark.sql("SELECT 1 AS id, CAST(unhex(h) AS STRING) AS text FROM VALUES ('41ff42'), ('e28241'), ('c0af20F0908042'), ('eda080'), ('E1'), ('2020'), (''), (null) AS t(h)")
    for texts in (spark.createDataFrame(rows, "id int, text string"), odd):
        made = embed.keys_and_words(texts, "text")
        told = embed.word_counts(texts.select("id", T.exact_key("text").alias("exact_key"), T.normalize_text("text").alias("norm")), "norm")
        assert made.columns == told.columns and made.exceptAll(told).count() == told.exceptAll(made).count() == 0
    plan = _plan(reuse.described(spark.createDataFrame(rows[:2], "id int, text string")))
    assert "Exchange" not in plan and "translate" not in plan


def test_few_pairs_are_multiplied_in_double_precision_with_the_same_result():
    from ledgerlake.operators.similarity import _tops
    rng = np.random.default_rng(0)
    for floor in (-np.inf, 0.7, 0.95, 1.0) * 20:
        q, m = rng.random((rng.integers(1, 40), 64)), rng.random((rng.integers(1, 60), 64))
        m[::7], m[1::9] = m[0], m[0] + 1e-10  # equal and nearly equal entries
        q[::2] = m[rng.integers(0, len(m), len(q[::2]))]
        q, m = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, m))
        sims = np.round(q @ m.T, 9)
        want = [(i, int(sims[i].argmax()), float(sims[i].max())) for i in range(len(q)) if sims[i].max() >= floor]
        assert list(zip(*_tops(q, m, floor), strict=True)) == want


def test_a_task_hands_on_one_match_of_a_probe(spark):
    from ledgerlake.operators import similarity as S
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.random(8)]) for i in range(120)]
    probes, store = (spark.createDataFrame(x, "id int, v array<double>") for x in (rows[:20], rows[20:]))
    stored, S._stored = S._stored, lambda df, name: seen.setdefault(name, stored(df, name))
    seen: dict = {}
    try:
        got = S.nearest(probes, store, "id", "id", "v", 0.1, block_rows=10, most_boxes=1)
        assert got.count() == 20 and seen["index-matches"].where("similarity IS NOT NULL").count() == 20
    finally:
        S._stored = stored
