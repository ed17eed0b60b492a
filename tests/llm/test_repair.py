import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from ledgerlake.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, bucket int, digest string, turns string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) in order; fault: blank, duplicate, truncated or None."""
    out, seen = [], set()
    for _, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        bare = text.strip(repair.BLANKS)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def apply(audit, rows):
    """(cost, lines) of an audit, or None where it does not fit or does not give a legal conversation."""
    cost, lines, left = 0, [], list(rows)
    for i, e in enumerate(audit):
        need = "a" if lines and lines[-1][0] == "u" else "u"
        if e == "I":
            lines.append({"u": "user", "a": "assistant"}[need] + ":")
            cost += 5
            continue
        if not left:
            return None
        role, text, fault = left.pop(0)
        if e == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (e == "R")
        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[need]) + ":" + text)
    if left or not SHAPE.fullmatch("".join(x[0] if x[0] in "sua" and x[0] != ":" else "x" for x in lines)):
        return None
    return cost, lines


def cheapest(rows):
    """All audits with up to two insertions more than are ever of use."""
    best = None
    for extra in range(3):
        for audit in itertools.product("DIKR", repeat=len(rows) + extra):
            if audit.count("I") == extra and (found := apply(audit, rows)) and (best is None or (found[0], "".join(audit)) < best[:2]):
                best = (found[0], "".join(audit), found[1])
    return best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        turns = faults(mine)
        numbers = [t for _, t, _, _ in mine if t is not None]
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _, _ in turns]
        cost, audit, lines = cheapest(turns) if len(turns) <= 6 else (None, None, None)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[sum(f == x for _, _, f in turns) for x in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines or []).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "t") for r in rows], SCHEMA)


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_automaton_equals_all_audits():
    rng = random.Random(1)
    texts = {"-": ("  ", "blank"), "o": ("Fine.", None), "c": ("cut", "truncated")}
    words = [[(rng.choice(["system", "user", "assistant", "tool", ""]), *texts[rng.choice("-oooc")]) for _ in range(rng.randrange(5))] for _ in range(80)]
    automaton = repair.Automaton()
    signature = lambda w: "".join("-" if f == "blank" else (i if (i := r[:1]) in ("s", "u", "a") and i else "x").upper() if f else (i if (i := r[:1]) in ("s", "u", "a") and i else "x") for r, _, f in w)
    for w in sorted(words, key=lambda w: signature(w)[::-1]):
        cost, audit, lines = cheapest(w)
        assert automaton.solve(signature(w)) == (cost, audit)
        assert repair.rewritten(0, audit, [{"role": r, "text": t} for r, t, _ in w]) == lines


def test_equal_rests_are_one_node():
    words = sorted({"".join(random.Random(i).choices("uaUA-", k=6)) for i in range(300)}, key=lambda w: w[::-1])
    automaton = repair.Automaton()
    for w in words:
        automaton.solve(w)
    assert automaton.made == len({w[i:] for w in words for i in range(6)})


def test_repair_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in sorted(rng.sample(range(9), rng.randrange(1, 5))):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 100]), rng.choice(["system", "user", "assistant", "assistant", "tool", None, ""]),
                         rng.choice(["Yes.", "No!", "and so", " \t", None, "Yes.", "x? \n", "ß" * 50 + "."])))
    rows += rows[5:8]
    assert result(repair.repair(frame(spark, rows))) == expected(rows)
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0


def test_conversation_without_rows_left(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(repair.repair(frame(spark, [(lost, 0, "user", "Hi.")]))) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_in_many_chunks(spark):
    rng = random.Random(5)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "word " * rng.randrange(40) + ".") for t in range(700)]
    rows += [(8, None, "user", f"n{i}.") for i in range(150)] + [(9, 0, "user", "long " * 200_000 + ".")]
    got = result(repair.repair(frame(spark, rows)))
    for conv in (7, 8, 9):
        turns = faults(damage([r for r in rows if r[0] == conv]))
        cost, lines = apply(got[conv][6], turns)
        assert cost == got[conv][5] and hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[conv][7]
    texts = repair.repaired_texts(frame(spark, rows), damage=True).where("conv_id = 7").orderBy("chunk").collect()
    turns = faults(damage([r for r in rows if r[0] == 7]))
    assert len(texts) > 5 and "\n".join(r.text for r in texts if r.n_turns) == "\n".join(apply(got[7][6], turns)[1])


def test_undamaged_conversations_keep_their_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Alone.")]
    got = result(repair.repair(frame(spark, rows), damage=False))
    assert got[1][5:7] == (0, "KK") and got[2][5:7] == (2, "D")
    assert {r.conv_id: r.text for r in repair.repaired_texts(frame(spark, rows)).collect()} == {1: "user:Hi.\nassistant:Yes.", 2: ""}
    assert repair.repair(frame(spark, rows).withColumn("turn", F.lit(None).cast("long")), damage=False).count() == 2
