import hashlib
import math
import random

from ledgerlake.llm import mixing


def place(doc, seed=17):
    return int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:15], 16)


def exponent(shares, entropy_share, repeats):
    def parts(a):
        w = [p ** a for p in shares]
        z = sum(w)
        return -sum(x / z * math.log(x / z) for x in w), max(x / z / p for x, p in zip(w, shares, strict=True))

    def bisect(good, up):
        low, high = 0.0, 1.0
        if good(high if up else low):
            return high if up else low
        for _ in range(48):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) == up else (low, mid)
        return low if up else high

    return max(bisect(lambda a: parts(a)[0] >= entropy_share * math.log(len(shares)) - 1e-12, True), bisect(lambda a: parts(a)[1] <= repeats + 1e-12, False))


def expected(rows, entropy_share, repeats):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total = sum(sizes.values())
    real = {s: n for s, n in sizes.items() if n}
    a = exponent([n / total for n in real.values()], entropy_share, repeats) if len(real) > 1 else 1.0
    z = sum((n / total) ** a for n in real.values())
    out = []
    for s, n in sizes.items():
        weight = (n / total) ** a / z if n else 0.0
        budget = math.floor(round(weight * total, 3))
        mine = [(place(d), d, len((t or "").split())) for d, x, t in rows if x == s]
        for p, d, w in mine:
            upto = sum(v for q, _, v in mine if q <= p)
            out.append((d, s, w, round(weight, 9), budget // n + (upto <= budget % n) if n else 0))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, source string, text string, weight int, tokens string")
    return sorted(((r.doc_id, r.source, r.n_words, round(r.weight, 9), r.n_copies) for r in mixing.mix(docs, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choices(["a", "b", "c", None], [60, 25, 10, 5])[0], " ".join(["w\x0bx"] * rng.randint(0, 40))) for i in range(300)]
    rows += [(900, "empty", None), (901, "empty", " \t"), (None, "a", "x y"), rows[0], (902, "d", "w " * 3000)]
    for entropy, repeats in ((0.98, 4.0), (0.9, 1.5), (0.999, 50.0)):
        for block in (1000, 7):
            assert run(spark, rows, entropy_share=entropy, repeats=repeats, block_docs=block) == expected(rows, entropy, repeats)


def test_targets(spark):
    rows = [(i, "big" if i % 10 else "small", "one two three four") for i in range(400)]
    out = run(spark, rows, entropy_share=0.95, repeats=10.0)
    words = {s: sum(w * k for _, x, w, _, k in out if x == s) for s in ("big", "small")}
    share = words["small"] / sum(words.values())
    assert abs(-share * math.log(share) - (1 - share) * math.log(1 - share) - 0.95 * math.log(2)) < 0.01
    # the repetition limit wins over the entropy
    assert max(k for *_, k in run(spark, rows, entropy_share=1.0, repeats=2.0)) <= 2


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", None)]) == [(1, "a", 0, 0.0, 0)]
    assert run(spark, [(1, "a", "x"), (2, "a", "y z")]) == [(1, "a", 1, 1.0, 1), (2, "a", 2, 1.0, 1)]
    docs = spark.createDataFrame([(1, "a", "x", 3), (2, "a", "y", 0)], "doc_id long, source string, text string, n_copies long")
    assert [r.doc_id for r in mixing.repeated(docs).collect()] == [1, 1, 1]
