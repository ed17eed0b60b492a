"""Toxicity scoring of deobfuscated text.

A noisy channel restores words before they are scored: each written character stands for a small lattice of
letters (itself, leetspeak readings, nothing), repeated letters may collapse, spelled-out letters are joined, and a
Viterbi pass picks the reading that a character trigram model finds best. The trigram model counts all documents;
words and a logistic score come from a bounded sample of labelled documents. A text is scored by the weights of the
distinct words that its tokens are read as, in training and afterwards by the same function.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import drop_table, masked, quoted, small_batches, stray_columns, write_table

SYMBOLS = 64  # 0: not a letter, 1-26: a-z, 27-58: U+00E0 to U+00FF, 59: any other letter
#: Letters that a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "?": "", "*": "", "#": "h", "%": "", "&": ""}
#: Costs in nats. A letter written twice is nearly always meant twice; one written three times or more is not.
LEET_COST, DROP_INSIDE, DROP_MARK, DROP_DIGIT, COLLAPSE, COLLAPSE_RUN = 1.5, 8.0, 0.5, 10.0, 9.0, 0.7
#: What parting a word of letters must save.
PARTING = 3.0
#: Observations that the prior of the logistic coefficients counts for.
FORCE = 4.0
#: Words of the lexicon are those of which at most this share is there by chance.
FALSE = 0.2
_MARKS = re.compile(r"[^\w@$!|+€£¡(<?*#%&]+|_+")
_TWICE = re.compile(r"(.)\1+", re.S)
_RUN = re.compile(r"(.)\1\1", re.S)
#: Three words in a row of one character, marks aside: what may be spelled out.
_SPELLED = re.compile(r"(?<!\S)\S[^\w\s]*\s+\S[^\w\s]*\s+\S[^\w\s]*(?!\S)")


def symbol_table() -> np.ndarray:
    """Code point (capped at U+0400) to symbol, letters of either case alike."""
    table = np.zeros(0x401, np.int64)
    for code in range(0x400):
        low = chr(code).lower()
        if len(low) == 1 and low.isalpha():
            table[code] = ord(low) - 96 if "a" <= low <= "z" else ord(low) - 0xE0 + 27 if 0xE0 <= ord(low) <= 0xFF else 59
    table[0x400] = 59
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(cell, n): how often each character trigram occurs in the texts of ``docs`` (text); cell: base-64 of its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)

        def count(held: list[str]) -> None:
            codes = np.frombuffer("".join(held).encode("utf-32-le", "replace"), "<u4")
            s = table[np.minimum(codes, 0x400)]
            inside = np.ones(len(s) - 2, bool)
            ends = np.cumsum(list(map(len, held)))[:-1]
            inside[ends - 1] = inside[ends - 2] = False  # a trigram lies in one text
            total[:] += np.bincount(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[inside], minlength=SYMBOLS ** 3)

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text or ""), 1 << 20):  # pieces overlap by two characters
                    held.append(" " * (not at) + text[max(0, at - 2):at + (1 << 20)] + " ")
                    size += len(held[-1])
                    if size > 1 << 20:
                        count(held)
                        held, size = [], 0
            if held:
                count(held)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    return docs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two), interpolated with bigrams and a uniform share. Size: 64^3, whatever the corpus."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi = tri.sum(axis=0)
    p2 = (bi + 0.5) / (bi + 0.5).sum(axis=1, keepdims=True)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(0.95 * p3 + 0.05 / SYMBOLS).astype(np.float32)


def closed(word: str) -> str:
    """A word without its closing marks."""
    return word.rstrip("".join({ch for ch in word if not ch.isalnum() and ch not in "$@"}))


def squeezed(word: str) -> str:
    """A word with every letter written once."""
    return _TWICE.sub(r"\1", word)


class Decoder:
    """Viterbi decoding of written words under the trigram costs.

    With a ``lexicon`` only readings that hold one of its words are of interest: tokens that cannot have one by any path
    are not decoded.
    """

    def __init__(self, costs: np.ndarray, lexicon: set[str] | None = None):
        self.costs = costs.tolist()
        table = symbol_table()
        self.symbol = lambda ch: int(table[min(ord(ch), 0x400)])
        self.lexicon, self.holds = lexicon, None
        if lexicon:
            self.holds = ahocorasick.Automaton()
            for word in sorted(lexicon):
                self.holds.add_word(squeezed(word), 1)
            self.holds.make_automaton()

    def plain(self, word: str) -> bool:
        """Whether the written word is its only reading: letters only, none twice in a row."""
        return word.isalpha() and not any(map(str.__eq__, word, word[1:]))

    def decode(self, word: str) -> str:
        """Best reading of a lower-cased word of any length; words without a letter have none but themselves."""
        if self.plain(word) or not any(map(str.isalpha, word)):
            return word
        return self.cheapest(closed(word))[1]

    def words(self, token: str) -> list[str]:
        """Restored words of a token of ``tokens``; one that starts with a space is glued and is segmented."""
        return self.cheapest(token[1:], glued=True)[1].split() if token[0] == " " else [self.decode(token)]

    def possible(self, token: str) -> bool:
        """Whether some path through the token's lattice, whole or parted, holds a word of the lexicon."""
        if self.holds is None:
            return False
        if token.isalpha():
            return bool(next(self.holds.iter(squeezed(token)), None))
        letters = [ch if ch.isalpha() else "" for ch in token]
        read = [(i, ["", *LEET[ch]]) for i, ch in enumerate(token) if not letters[i] and LEET.get(ch)]
        if len(read) > 6:
            return True
        for choice in product(*[x for _, x in read]):
            for (i, _), letter in zip(read, choice, strict=True):
                letters[i] = letter
            if next(self.holds.iter(squeezed("".join(letters))), None):
                return True
        return False

    def readings(self, token: str) -> list[list[str]]:
        """What a token of ``tokens`` may be, each reading as its words: the best whole one, closing marks that are letters
        after all, the parts between marks, a glued token parted or whole, a word of the lexicon."""
        if self.lexicon is not None and not self.possible(token):
            return []
        if token[0] == " ":
            first = self.words(token)
            return [first, *([[self.decode(token[1:])]] if len(first) > 1 else [])]
        found = [[self.decode(token)]]
        if token.isalpha():
            return found + self.hidden(token)
        if not any(map(str.isalpha, token)):
            return found
        at = end = len(closed(token))
        while end < len(token) and LEET.get(token[end]) and (end == at or token[end] != token[end - 1]):
            end += 1
            found.append([self.cheapest(token[:end], forced=at)[1]])
        parts = [x for x in _MARKS.split(token) if x]
        if len(parts) > 1:
            run = joined(parts)
            found.append([w for x in run for w in (self.words(" " + x) if x not in parts else [self.decode(x)])])
        for word in {w for one in found for w in one if w.isalpha()}:
            found += self.hidden(word)
        return found

    def hidden(self, word: str) -> list[list[str]]:
        """Further readings of a word of letters: doubled letters as single ones where those are likelier, and the words
        of one written without gaps."""
        found = []
        if not self.plain(word):
            found.append([self.cheapest(word, double=COLLAPSE_RUN)[1]])
        if self.lexicon is None or self.possible(word):
            cost, text = self.cheapest(word, glued=True)
            if " " in text and cost + PARTING < self.cheapest(word)[0]:
                found.append(text.split())
        return found

    def price(self, word: str) -> float:
        """What the trigram model says of the letters of a word."""
        s = [0, 0, *map(self.symbol, word), 0]
        return sum(self.costs[a][b][c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    def cheapest(self, word: str, forced: int | None = None, glued: bool = False, double: float = COLLAPSE) -> tuple[float, str]:
        """Cost and text of the best path through the lattice of a word. Marks from position ``forced`` on are letters;
        in a ``glued`` one a word may end before any letter."""
        costs, symbol, n = self.costs, self.symbol, len(word)
        forced = n if forced is None else forced
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        back: list[dict] = []
        for i, ch in enumerate(word):
            twice = i and word[i - 1] == ch
            run = twice or (i + 1 < n and word[i + 1] == ch)
            readings = [(ch, 0.0)] if ch.isalpha() else [(x, LEET_COST) for x in LEET.get(ch, "")]
            if not ch.isalpha() and i < forced:
                edge = i == n - 1
                readings.append(("", DROP_DIGIT if ch.isdigit() else DROP_MARK if run or edge or ch not in LEET or not LEET[ch] else DROP_INSIDE))
            elif ch.isalpha() and twice:
                long = word[i - 2:i - 1] == ch and i > 1 or word[i + 1:i + 2] == ch
                readings.append(("", COLLAPSE_RUN if long else double))
            after: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for (a, b), cost in best.items():
                row = costs[a][b]
                for letter, price in readings:
                    if letter:
                        s = symbol(letter)
                        steps = [((b, s), cost + price + row[s], letter)]
                        if glued and b:
                            steps.append(((0, s), cost + price + row[0] + costs[b][0][s], " " + letter))
                    else:
                        steps = [((a, b), cost + price, "")]
                    for state, value, text in steps:
                        if state not in after or value < after[state]:
                            after[state], came[state] = value, ((a, b), text)
            best = after
            back.append(came)
        total, state = min((cost + costs[a][b][0], (a, b)) for (a, b), cost in best.items())
        out = []
        for came in reversed(back):
            state, text = came[state]
            out.append(text)
        return total, "".join(reversed(out))


def joined(words: list[str]) -> list[str]:
    """Runs of three or more one-character words become one word: spelled-out words."""
    if sum(map((1).__eq__, map(len, words))) < 3:
        return words
    out: list[str] = []
    run: list[str] = []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        out.append(w)
    return out[:-1]


def tokens(text: str) -> list[str]:
    """Written words of a text in lower case. Spelled-out ones are joined, closing marks after their letters left out;
    what may hold several words without a gap starts with a space."""
    text = text.lower()
    words = text.split()
    if not _SPELLED.search(text):
        return words
    runs: list[list[str]] = []
    run: list[str] = []
    marked = True
    for w in words:
        bare = len(w) > 1 and w[0].isalpha() and not w[1].isalnum() and closed(w) == w[0]
        run.append(w[0] if bare else w)
        if bare and not marked:  # marks after the last letter only: a run ends here
            runs.append(run)
            run = []
        marked = bare or len(w) > 1
    runs.append(run)
    out: list[str] = []
    for run in runs:
        n = len(run)
        found = joined(run)
        if len(found) == n:
            out += found
        else:
            at = 0
            for w in found:  # a joined word stands where its letters stood
                glued = len(w) > 1 and len(run[at]) == 1
                out.append(" " + w if glued else w)
                at += len(w) if glued else 1
    return out


class Hits(dict):
    """Token to the words of the lexicon among its readings; bounded memo of tokens that are not all letters or may hold one."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        found = {w for one in self.decoder.readings(token) for w in one}
        value = self[token] = tuple(sorted(found & self.decoder.lexicon))
        return value

    def of(self, words: set[str]) -> dict[str, tuple[str, ...]]:
        """The tokens among ``words`` that hold words of the lexicon, with these.

        Tokens of letters are looked through together: where no squeezed word of the lexicon is anywhere in them, none has one."""
        if self.decoder.holds is None:
            return {}
        letters = list(filter(str.isalpha, words))
        some = letters if next(self.decoder.holds.iter(squeezed("\n".join(letters))), None) else ()
        asked = [*some, *words.difference(letters)]
        return {w: hit for w in asked if (hit := self[w])}


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log-odds of a word's document counts, at most 6."""
    return min(math.log((toxic + 0.05) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)), 6.0)


def rising(a: float, n: int) -> np.ndarray:
    """Logarithms of a (a + 1) ... (a + k - 1) for k from 0 to n."""
    return np.concatenate(([0.0], np.cumsum(np.log(a + np.arange(n)))))


def spread_of(cells: dict[tuple[int, int], int], share: float) -> float:
    """How much more words differ in their share of toxic documents than by drawing alone, since documents of a topic,
    a language or a template share words: the correlation of a word's documents, from the words that are not extreme."""
    rows = np.array([(t, t + c, n) for (t, c), n in cells.items() if t + c >= 4 and t <= 0.7 * (t + c)], float).reshape(-1, 3)
    if not len(rows):
        return 1e-6
    t, size, n = rows.T
    drawn = share * (1 - share)
    over = (n * ((t - size * share) ** 2 - size * drawn)).sum() / (n * size * (size - 1) * drawn).sum()
    return min(max(float(over), 1e-6), 0.9)


def chance(cells: dict[tuple[int, int], int], asked: list[tuple[int, int]], share: float) -> list[float]:
    """For each of ``asked`` (toxic, clean documents of a word) the share of words so extreme that chance alone explains.

    ``cells`` tells how many words have those counts. By chance a word of n documents would have a number of toxic ones
    that is beta-binomial in n, the overall ``share`` and the words' spread; the expected number of words with as small a
    tail probability, divided by the number observed, is the share of false ones among them.
    """
    sizes = Counter()
    for (t, c), n in cells.items():
        sizes[t + c] += n
    rho = spread_of(cells, share)
    a, b = share * (1 - rho) / rho, (1 - share) * (1 - rho) / rho
    top = max({*sizes, *(t + c for t, c in asked)}, default=0)
    fact, up_a, up_b, up_all = rising(1, top), rising(a, top), rising(b, top), rising(a + b, top)
    tails = {}
    for n in {*sizes, *(t + c for t, c in asked)}:
        pmf = np.exp(fact[n] - fact[:n + 1] - fact[:n + 1][::-1] + up_a[:n + 1] + up_b[:n + 1][::-1] - up_all[n])
        tails[n] = np.cumsum(pmf[::-1])[::-1]
    p = np.array([tails[t + c][t] for t, c in asked])
    expected = np.zeros(len(asked))
    for n, words in sizes.items():
        up = tails[n][::-1]  # rising
        at = np.searchsorted(up, p * (1 + 1e-9), side="right")
        expected += words * np.where(at > 0, up[np.maximum(at - 1, 0)], 0.0)
    own = np.array([(tails[t + c][t], n) for (t, c), n in cells.items()]).reshape(-1, 2)
    order = np.argsort(own[:, 0])
    seen = np.concatenate(([0.0], np.cumsum(own[order, 1])))[np.searchsorted(own[order, 0], p * (1 + 1e-9), side="right")]
    return np.minimum(expected / np.maximum(seen, 1), 1.0).tolist()


def fit(x: np.ndarray, y: np.ndarray, prior: tuple[float, float], rounds: int = 60) -> list[float]:
    """Offset and slope (not below 0) of a logistic score of ``x``, drawn to ``prior`` with the force of FORCE observations."""
    theta, centre = np.array(prior, float), np.array(prior, float)
    rows = np.column_stack((np.ones(len(x)), x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        grad = rows.T @ (p - y) + FORCE * (theta - centre)
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + FORCE * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return [float(theta[0]), max(float(theta[1]), 0.0)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> dict:
    """Character model over all of ``docs``, word weights and coefficients from labelled documents.

    ``labels`` (doc_id, toxic) names clean (0) and toxic (1) documents; only those whose crc32(doc_id as text) mod 5
    is not 0 are learnt from, at most about ``sample`` of them, chosen by a hash of the id (a repeated id counts
    once, with its largest label; null ids or labels are ignored). The lexicon holds the words whose counts in those
    documents chance does not explain. Without usable labels of both kinds every score is the share of toxic labels.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    cells = trigram_counts(plain.select("text")).toPandas()  # at most 64^3 rows
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "label_id is not null and toxic is not null").where(~held_out(F.col("label_id")))
    # the share to take follows from the number of labels, so the sample has the stated bound at any size
    share = min(1.0, sample / max(known.count(), 1))
    taken = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    learn, path = write_table(
        plain.join(F.broadcast(taken), plain.doc_id == taken.label_id).dropDuplicates(["label_id"]).select("text", "toxic"), "labelled")
    model = _learn(learn, trigram_costs(counts))
    drop_table(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= 0.5) added or replaced.

    The score reads the whole text and nothing else; very long texts and words too. Null and empty texts have no words
    and get the score of such a text. Repeated rows get equal scores, other columns pass through. One narrow pass; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    through = stray_columns(docs, {"held_out", "score", "predicted"})
    inside, outside = masked(docs, through)
    frame = docs.select(*inside, held_out(F.col(quoted(id_col))).alias("__held"), F.col(quoted(text_col)).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "hits" not in held:  # a worker keeps the broadcast value between tasks, and with it what was decoded
            held["hits"] = Hits(Decoder(held["costs"], set(held["weights"])))
        hits, weights, (offset, slope) = held["hits"], held["weights"], held["theta"]
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = {w for hit in hits.of(set(tokens(text or ""))).values() for w in hit}
                z = offset + slope * sum(sorted(weights[w] for w in found))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "__score"])

    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("__score", T.DoubleType())])
    scored = frame.mapInArrow(run, schema)
    return scored.select(*outside, F.col("__held").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def _learn(learn: DataFrame, costs: np.ndarray) -> dict:
    """Lexicon, word weights and logistic coefficients from the labelled sample (text, toxic)."""
    spark = learn.sparkSession
    sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    model = {"costs": costs, "weights": {}}
    rate = min(max(n_toxic / max(n_clean + n_toxic, 1), 1e-6), 1 - 1e-6)
    offset = math.log(rate / (1 - rate))
    if not n_clean or not n_toxic:
        return model | {"theta": [offset, 0.0]}
    channel = spark.sparkContext.broadcast(costs)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Decoder(channel.value)
        memo: dict[str, list[str]] = {}
        clean, toxic = Counter(), Counter()

        def flush():
            held = list(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([clean[w] for w in held], pa.int64()), pa.array([toxic[w] for w in held], pa.int64())],
                                             names=["word", "clean", "toxic"])
            clean.clear()
            toxic.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = set(tokens(text or ""))
                for w in found - memo.keys():
                    memo[w] = [w] if w.isalpha() and not _RUN.search(w) else read.words(w)
                (toxic if label else clean).update({x for w in found for x in memo[w]})
                if len(memo) > 100_000:
                    memo.clear()
                if len(clean) + len(toxic) > 100_000:
                    yield from flush()
        yield from flush()

    counted = learn.mapInArrow(presence, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted, path = write_table(counted.where("word <> ''"), "word-counts")
    # the number of pairs of counts follows from the size of the sample
    cells = {(r.toxic, r.clean): r.n for r in counted.groupBy("toxic", "clean").agg(F.count("*").alias("n")).collect()}
    asked = sorted(k for k in cells if k[0] >= 2 and log_odds(*k, n_toxic, n_clean) >= 1.5)
    good = [k for k, q in zip(asked, chance(cells, asked, rate), strict=True) if q <= FALSE] if asked else []
    if not good:
        drop_table(spark, path)
        return model | {"theta": [offset, 0.0]}
    kept = spark.createDataFrame(good, "toxic long, clean long")
    words = sorted(r.word for r in counted.join(kept, ["toxic", "clean"], "left_semi").select("word").collect())  # from the sample
    drop_table(spark, path)
    shared = spark.sparkContext.broadcast((costs, words))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices, lexicon = shared.value
        number, hits = {w: i for i, w in enumerate(lexicon)}, Hits(Decoder(prices, set(lexicon)))
        for batch in batches:
            held, places = [], []
            for text in batch.column("text").to_pylist():
                run = tokens(text or "")
                seen: dict[int, int] = {}
                here = hits.of(set(run))
                for at, token in enumerate(run) if here else ():
                    for w in here.get(token, ()):
                        if number[w] not in seen:
                            seen[number[w]] = hash_of(" ".join([*run[max(at - 2, 0):at], "", *run[at + 1:at + 3]]))
                held.append(list(seen.keys()))
                places.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(held, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))], names=["y", "words", "places"])

    rows = learn.mapInArrow(described, "y int, words array<int>, places array<long>").collect()  # bounded by ``sample``
    # a word that stands between the same two words on either side in several documents stands in copies, and counts once
    places = {(w, r.y, p) for r in rows for w, p in zip(r.words, r.places, strict=True)}
    tally = Counter((w, y) for w, y, _ in places)
    found = {w: (tally[w, 1], tally[w, 0]) for w in {w for w, _ in tally}}
    judged = sorted({*found.values()})
    odds = dict(zip(judged, chance(cells, judged, rate), strict=True)) if judged else {}

    def weight(w: int, toxic: int, clean: int) -> float:
        t, c = found[w][0] - toxic, found[w][1] - clean
        value = log_odds(max(t, 0), max(c, 0), n_toxic, n_clean)
        return (1 - odds[found[w]]) * value if t >= 1 and found[w][0] >= 2 and value >= 1.5 and odds[found[w]] <= FALSE else 0.0

    # a document's own label is taken out of the counts that weigh its words
    x = np.array([sum(weight(w, r.y, 1 - r.y) for w in r.words) for r in rows])
    theta = fit(x, np.array([r.y for r in rows], float), (offset, 1.0))
    weights = {words[w]: v for w in found if (v := weight(w, 0, 0))}
    return model | {"weights": weights, "theta": theta}


def hash_of(text: str) -> int:
    """A stable 63-bit number for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1
