import random

from ledgerlake.llm.chat import format_chats


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, r, t in turns)


def expected(rows):
    chats = {}
    for conv, *turn in dict.fromkeys(rows):
        if conv is not None:
            chats.setdefault(conv, []).append(tuple(turn))
    chats = {c: sorted(t, key=lambda x: (x[0] is None, x[0])) for c, t in chats.items()}
    body = {c: tuple((r or "", t or "") for _, r, t in v) for c, v in chats.items()}
    out = []
    for c, b in body.items():
        if any(len(o) > len(b) and o[:len(b)] == b for o in body.values()) or any(o == b and k < c for k, o in body.items()):
            continue
        out.append((c, len(b), sum(o == b for o in body.values()), render(chats[c])))
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    found = {}
    for r in sorted(format_chats(frame).collect(), key=lambda r: (r.conv_id, r.part)):
        c, n, k, text = found.get(r.conv_id, (r.conv_id, r.n_turns, r.n_copies, ""))
        assert (n, k) == (r.n_turns, r.n_copies)
        found[r.conv_id] = (c, n, k, text + r.text)
    return sorted(found.values())


def test_matches_brute_force(spark):
    rng, rows = random.Random(4), []
    for c in range(60):
        path = []
        for t in range(rng.randint(1, 5)):
            path.append((t, ("user", "assistant")[t % 2], rng.choice(["hi", "yes", "no\nno"]) if t else "hello"))
        rows += [(c, *p) for p in path]
    rows += [(100, 0, None, None), (101, 0, "", ""), (102, 0, "user", None), (102, None, "user", "late"), (None, 0, "user", "x"), rows[0], rows[0]]
    rows += [(200, t, "user", f"m{t}") for t in range(700)] + [(201, t, "user", f"m{t}") for t in range(300)] + [(202, 5 * t, "user", f"m{t}") for t in range(700)]
    assert run(spark, rows) == expected(rows)


def test_empty_and_order(spark):
    assert run(spark, []) == []
    # the same turns in another order are another conversation; text cannot leak into the role
    rows = [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "b", "y"), (2, 1, "a", "x"), (3, 0, "ax", ""), (4, 0, "a", "x")]
    assert run(spark, rows) == expected(rows)
