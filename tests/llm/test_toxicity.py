import random
import zlib

import numpy as np
import pytest

from ledgerlake.llm import toxicity as tx

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder():
    words = "the idiot was a moron and the stupid clown is worthless trash said the pathetic loser disgusting scum in the house of their other mother".split()
    counts, table = np.zeros(tx.SYMBOLS ** 3, np.int64), tx.symbol_table()
    for w in words:
        s = [0, 0, *(int(table[ord(c)]) for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            counts[(a * tx.SYMBOLS + b) * tx.SYMBOLS + c] += 50
    return tx.Decoder(tx.trigram_costs(counts))


@pytest.mark.parametrize("written, read", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("idiot!!", "idiot"), ("w0rthle55", "worthless"),
                                           ("idiooooot", "idiot"), ("scum###", "scum"), ("tr@sh", "trash"), ("i.d.i.o.t", "idiot"), ("s-c-u-m", "scum"),
                                           ("the&&&", "the"), ("and,", "and"), ("mother", "mother"), ("12345", "12345"), ("", ""), ("x" * 50 + "0", "xo")])
def test_viterbi_reading(decoder, written, read):
    assert decoder.decode(written) == read


def test_spelled_out_words():
    assert tx.joined("you i d i o t now".split()) == ["you", "idiot", "now"]
    assert tx.joined("a b word c d e".split()) == ["a", "b", "word", "cde"]
    assert tx.joined([]) == []


def read(decoder, text):
    return {w for token in tx.tokens(text) for one in decoder.readings(token) for w in one}


@pytest.mark.parametrize("text, word", [("iddiot", "idiot"), ("morron", "moron"), ("stuupid", "stupid"), ("idi" + "o" * 60 + "t", "idiot"),
                                        ("the.house.of.their.other.mother.and.idiot.was", "idiot"), ("the-idiot-" * 6, "idiot"),
                                        ("idio+", "idiot"), ("id!0+!!", "idiot"), ("s-c-u-m-" * 12, "scum"), ("the idiot was a moron " .replace(" ", "") * 4, "moron")])
def test_hidden_words_are_read(decoder, text, word):
    assert word in read(decoder, text)


@pytest.mark.parametrize("text", ["i d i o t.", "so i d i o t!! said", "t h e i d i o t, m o r o n", "i. d. i. o. t.", "t h e i d i o t", "t h e i d i o t w a s a m o r o n " * 5])
def test_spelled_out_words_are_parted(decoder, text):
    assert "idiot" in read(decoder, text)


def test_trigram_counts_cover_whole_texts(spark):
    text = "ab" * (1 << 19) + "cd"  # longer than a piece
    cells = {r.cell: r.n for r in tx.trigram_counts(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()}
    aba = (1 * 64 + 2) * 64 + 1
    assert cells[aba] == (1 << 19) - 1 and cells[(3 * 64 + 4) * 64] == 1


def test_ordinary_words_keep_their_letters(spark):
    for sf in ("sf0.001", "sf0.01"):
        cells = tx.trigram_counts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text")).toPandas()
        counts = np.zeros(tx.SYMBOLS ** 3, np.int64)
        counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        read = tx.Decoder(tx.trigram_costs(counts))
        for word in "worthless committee address hopping killer balloon coffee".split():
            assert read.decode(word) == word
        assert [read.decode(w) for w in ("w0rthle55", "idiooooot", "m0r0n")] == ["worthless", "idiot", "moron"]


def paths(word, forced):
    """All readings of a lattice, with what the channel asks for each."""
    found = [("", 0.0)]
    for i, ch in enumerate(word):
        near = word[max(0, i - 1):i + 2].count(ch) > 1
        if ch.isalpha():
            steps = [(ch, 0.0)]
            if i and word[i - 1] == ch:
                steps.append(("", tx.COLLAPSE_RUN if word[i - 2:i - 1] == ch and i > 1 or word[i + 1:i + 2] == ch else tx.COLLAPSE))
        else:
            steps = [(x, tx.LEET_COST) for x in tx.LEET.get(ch, "")]
            if i < forced:
                steps.append(("", tx.DROP_DIGIT if ch.isdigit() else tx.DROP_MARK if near or i == len(word) - 1 or not tx.LEET.get(ch) else tx.DROP_INSIDE))
        found = [(a + x, c + p) for a, c in found for x, p in steps]
    return found


def test_viterbi_equals_all_paths(decoder):
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choices("idotmrnaasse100@!$.-", k=rng.randint(1, 7)))
        forced = rng.choice([len(word), len(word), 3])
        every = paths(word, forced)
        if every and any(map(str.isalpha, word)):
            best = min(cost + decoder.price(text) for text, cost in every)
            cost, text = decoder.cheapest(word, forced=forced)
            assert abs(cost - best) < 1e-4 and abs(min(c + decoder.price(t) for t, c in every if t == text) - best) < 1e-4


def test_lexicon_does_not_hide_readings(decoder):
    lexicon = {"idiot", "moron", "scum", "worthless"}
    sharp = tx.Decoder(decoder.costs if isinstance(decoder.costs, np.ndarray) else np.array(decoder.costs), lexicon)
    rng = random.Random(10)
    for _ in range(400):
        token = "".join(rng.choice([ch, ch, ch, ch + ch, {"i": "1", "o": "0", "s": "$", "e": "3"}.get(ch, ch), ch + "."]) for ch in rng.choice([*sorted(lexicon), "house", "theidiot"]))
        every = {w for one in decoder.readings(token) for w in one} & lexicon
        assert every <= {w for one in sharp.readings(token) for w in one}


def test_chance_tells_real_words_from_rare_ones():
    cells = {(0, 4): 800, (1, 3): 300, (2, 2): 45, (3, 1): 3, (0, 1): 9000, (1, 0): 1000, (20, 0): 5, (2, 18): 40}
    real, rare, usual = tx.chance(cells, [(20, 0), (1, 0), (2, 18)], 0.1)
    assert real < 1e-6 and rare > 0.8 and usual > 0.8


def test_words_of_any_length_are_read_alike(decoder):
    for n in (30, 39, 40, 41, 200, 5000):
        assert "idiot" in read(decoder, "idi" + "o" * n + "t") and "scum" in read(decoder, "s-c-u-m" + "-" * n)


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.3), ("sf0.01", 0.6)])
def test_toxic_documents_are_found(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = tx.score(docs, tx.fit_model(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r for r in out if r.toxic]
    assert sum(r.predicted for r in toxic) >= least * len(toxic)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.01 * len(out)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    out = tx.score(docs, tx.fit_model(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    assert not [r for r in out if r.predicted and not r.toxic]


def test_obfuscated_and_odd_rows(spark):
    clean = "the house of the other mother said and was in there"
    rows = [(i, f"{clean} idiot moron {i}" if i % 3 == 0 else f"{clean} {i}") for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, None), (500, ""), (501, None), (502, clean + " 1diot and m0ron"), (503, "Idiot!! " * 20_000), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)] + [(None, True), (5, None), (0, True)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    with_clash = docs.selectExpr("*", "1 as score", "doc_id as label_id")
    out = tx.score(with_clash, tx.fit_model(with_clash, labels))
    assert out.columns == ["doc_id", "text", "label_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r.predicted for r in out.collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(90)) and got[502] == 1 and got[503] == 1 and got[500] == got[501] == got[None] == 0
    assert tx.score(docs.limit(0), tx.fit_model(docs.limit(0), labels)).count() == 0
    none = tx.score(docs, tx.fit_model(docs, labels.limit(0))).collect()
    assert len(none) == len(rows) + 6 and not any(r.predicted for r in none)
