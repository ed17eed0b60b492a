import random

from ledgerlake.llm import minhash
from ledgerlake.llm.common import connected_components
from ledgerlake.llm.minhash import Shingles, near_duplicates


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def expected(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is not None and b is not None and sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def corpus(rng, originals, copies):
    words = [a + b for a in "tha ren dor lin ".split() for b in "ba ke mi so tu ly en or".split()]
    rows = []
    for _ in range(originals):
        base = rng.choices(words, k=rng.randint(60, 160))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words) + str(rng.randrange(1000))
            rows.append(" ".join(text))
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, n long, node string")
    out = near_duplicates(docs, **kw).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(11)
    texts = corpus(rng, 25, 7)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two\twords"), (905, "one"), (None, texts[0]), (None, None),
             rows[0], (906, texts[0].upper()), (907, "w " * 50_000), (908, "w " * 60_000)]
    assert run(spark, rows) == expected(rows, 3, 85)
    assert run(spark, rows, width=5, percent=80, bands=32) == expected(rows, 5, 80)


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(100, 160)]
    for i in range(40):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    assert run(spark, rows) == expected(rows, 3, 85)


def test_pairs_inside_one_large_family(spark):
    # pages of one template, 0.83 alike, that hold pairs 0.868 alike: stars with few centres miss most of them
    template = " ".join(f"t{i}" for i in range(400))
    rows = []
    for i in range(1200):
        own = " ".join(f"p{i // 2}x{k}" for k in range(10)) + " " + " ".join(f"d{i}x{k}" for k in range(30))
        rows.append((i, f"{template} {own}"))
    sets = [shingles(t, 3) for _, t in rows[:3]]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert alike[0] >= 0.85 > alike[1] > 0.82
    assert {d: c for d, _, c in run(spark, rows)} == {i: i - i % 2 for i in range(1200)}


def test_pairs_of_a_shingle_that_many_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)  # postings beyond three members meet in blocks
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w for w in base if rng.random() > 0.05)) for i in range(150)]
    assert run(spark, rows, percent=75, max_rounds=0) == expected(rows, 3, 75)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shingles_of_bytes():
    cut = Shingles(3)
    assert len(cut.of(b"a b c a b c")) == 3 and len(cut.of(b"A b\x0bC")) == 1 and len(cut.of(b" ")) == 0
    assert (cut.of(b"A B c d") == cut.of(b"a b\tC\nD")).all()


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [100, *range(200, 260)]}}
