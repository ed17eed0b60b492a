import random
from collections import defaultdict

from ledgerlake.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def expected(rows, min_chars, min_docs):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(BLANKS))
            if doc is not None and len(key) >= min_chars:
                held[key].add(doc)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or keeper.get(lower(x.strip(BLANKS)), doc) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, key string, n_dropped int")
    out = dedup_lines(docs, **kw)
    assert out.columns == ["doc_id", "key", "text", "n_lines", "n_dropped"]
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [w * 5 for w in ("Alpha ", "beta é ", "GAMMA", "ÄÖ délta", "short")] + ["x", "", "   ", "é" * 10]
    rows = [(i, "\n".join((" " * rng.randint(0, 2)) + (p.upper() if rng.random() < 0.2 and p.isascii() else p) + rng.choice(["", "\t", "\r"]) for p in rng.choices(pool, k=rng.randint(1, 6))))
            for i in rng.sample(range(-50, 400), 60)]
    rows += [(1000, None), (1001, ""), (None, pool[0]), (None, None), rows[0], rows[0], (2000, "y" * 100_000 + "\n" + pool[0])]
    for batches, fanout in ((1, 4), (7, 2)):
        assert run(spark, rows, min_chars=10, min_docs=5, batches=batches, fanout=fanout) == expected(rows, 10, 5)


def test_ids_of_any_span(spark):
    line = "q" * 45
    rows = [(i, line) for i in (-(1 << 63), -(1 << 63) + 1, -3, 0, 5, (1 << 62) + 1, (1 << 62) + 2, (1 << 63) - 2, (1 << 63) - 1)]
    for batches in (2, 5):
        assert run(spark, rows, batches=batches) == expected(rows, 40, 5)


def test_empty_table_and_rare_lines(spark):
    assert run(spark, []) == []
    rows = [(i, "z" * 50) for i in range(4)]
    assert all(r[3] == 0 for r in run(spark, rows))
    assert [r[3] for r in run(spark, [*rows, (4, "Z" * 50)])] == [1, 1, 1, 1, 0]
