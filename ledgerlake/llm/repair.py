"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

Every turn becomes one letter that says all an edit needs to know of it: its role and whether it must go or costs
extra to keep. A conversation is then a word, and what is left to do from a turn on depends on the rest of the word
alone. Words are minimised from the end: equal rests of any two conversations are one node. For each node and each
state of the grammar ``(s?(ua)+)?`` the cost to go and the first edit of the best audit are computed once; since
the edits open to a state have different initials, these give the ASCII-least of the cheapest audits by walking.

Signatures are sorted by their reversal, so conversations with equal rests stand next to each other and a task keeps
the nodes of one path only. Turns are kept in chunks, ordered within buckets of turn numbers, so no step but the
digest of a repaired conversation (a stream, as SHA-256 asks) meets all turns of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import batches_of, drop_table, quoted, write_table

BLANKS = " \t\n\x0b\x0c\r"
#: Turn numbers of a bucket, and turns of a chunk (the rows that one row of a table holds).
BUCKET, CHUNK = 64, 64
#: Chunks that a Python worker is handed at once.
CHUNK_ROWS = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; words may end in 0 and 3. By state the role that
#: may come next besides a first s, and the state after it.
NEXT_ROLE, NEXT_STATE, LAST = "uuau", (2, 2, 3, 2), (0, 3)
#: Letters: - must go; s u a x (any other role) as it is, capitals where the text is cut off.
LETTERS = "-suaxSUAX"
NEVER = 1 << 60


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with the stated damage, a narrow pass. conv is the id as text; nulls are one space.

    crc32 of ``conv:turn`` modulo 20: 0 drops the turn, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it,
    4 makes its role user.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(" "))

    rows = conversations.select(text_of(conv_col).alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"),
                                F.pmod(F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))), F.lit(20)).alias("hit"))
    rows = rows.where("hit <> 0").withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def chunks(rows: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) in chunks: (conv, bucket, sub, letters, initials, turns, counters).

    Order: turn (nulls first), role, text. Chunks of a conversation follow each other by (bucket, sub).
    """
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("bucket", F.floor(F.col("turn") / BUCKET).cast("long"))
    # texts seen more than once with one role: the earliest turn (nulls first) holds the first of them
    seen = rows.groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("at"))
    seen = seen.where("n > 1").select("conv", "role", "digest", F.col("at.turn").alias("first_turn"), F.lit(True).alias("many"))
    rows = rows.join(seen, ["conv", "role", "digest"], "left")
    order = Window.partitionBy("conv", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    for c in ("turn", "role", "digest"):
        rows = rows.withColumn(f"last_{c}", F.lag(c).over(order))
    again = F.col("turn").eqNullSafe(F.col("last_turn")) & (F.col("role") == F.col("last_role")) & (F.col("digest") == F.col("last_digest"))
    bare = F.rtrim("text", F.lit(BLANKS))
    blank = bare == ""
    duplicate = ~blank & F.coalesce(F.col("many") & (~F.col("turn").eqNullSafe(F.col("first_turn")) | F.coalesce(again, F.lit(False))), F.lit(False))
    cut = ~blank & ~duplicate & ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = rows.select("conv", "bucket", F.floor((F.col("place") - 1) / CHUNK).cast("long").alias("sub"), "place", "turn", "role", "text", initial.alias("initial"),
                       F.when(blank | duplicate, "-").when(cut, F.upper(initial)).otherwise(initial).alias("letter"), blank.alias("blank"), duplicate.alias("duplicate"), cut.alias("cut"),
                       (F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("last_turn"), F.lit(False))).alias("new"))

    def count(flag: str) -> Column:
        return F.sum(F.col(flag).cast("long")).alias(flag)

    turns = F.array_sort(F.collect_list(F.struct("place", "letter", "initial", "role", "text")))
    out = rows.groupBy("conv", "bucket", "sub").agg(turns.alias("turns"), F.count("*").alias("n"), count("blank"), count("duplicate"), count("cut"), count("new"),
                                                    F.min("turn").alias("low"), F.max("turn").alias("high"))
    return out.select("conv", "bucket", "sub", "n", "blank", "duplicate", "cut", "new", "low", "high", F.array_join("turns.letter", "").alias("letters"), F.array_join("turns.initial", "").alias("initials"),
                      F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


Node = tuple[tuple[int, ...], str]


def end_node() -> Node:
    """Costs to go by state, and the first edit of each: nothing is left."""
    return inserted([0 if s in LAST else NEVER for s in range(4)], ["" if s in LAST else "~" for s in range(4)])


def inserted(cost: list[int], edit: list[str]) -> Node:
    """Lets turns be inserted where that is cheaper, or as cheap with a smaller letter."""
    for s in (2, 3, 0, 1):  # an insertion leads to 2 or 3; two in a row never pay from these
        to = NEXT_STATE[s]
        if (cost[to] + INSERT, "I") < (cost[s], edit[s]):
            cost[s], edit[s] = cost[to] + INSERT, "I"
    return tuple(cost), "".join(e or "." for e in edit)


def node_before(letter: str, after: Node) -> Node:
    """The node whose first turn has ``letter`` and whose rest is ``after``."""
    to_go, cost, edit = after[0], [], []
    extra, role = CUT * letter.isupper(), letter.lower()
    for s in range(4):
        best = (DELETE + to_go[s], "D")
        if letter != "-":
            best = min(best, (REROLE + extra + to_go[NEXT_STATE[s]], "R"))
            if role == NEXT_ROLE[s]:
                best = min(best, (KEEP + extra + to_go[NEXT_STATE[s]], "K"))
            elif s == 0 and role == "s":
                best = min(best, (KEEP + extra + to_go[1], "K"))
        cost.append(best[0])
        edit.append(best[1])
    return inserted(cost, edit)


class Automaton:
    """Nodes of the signatures seen so far that the next one, in the order of reversed signatures, can share."""

    def __init__(self):
        self.last, self.path, self.made = "", [end_node()], 0

    def solve(self, signature: str) -> tuple[int, str]:
        """Least cost and the ASCII-least audit of that cost."""
        back, same = signature[::-1], 0
        limit = min(len(back), len(self.last))
        while same < limit and back[same] == self.last[same]:
            same += 1
        del self.path[same + 1:]
        for letter in back[same:]:
            self.path.append(node_before(letter, self.path[-1]))
            self.made += 1
        self.last = back
        return self.path[-1][0][0], "".join(self._walk(signature))

    def _walk(self, signature: str) -> Iterator[str]:
        state, left = 0, len(signature)
        while (edit := self.path[left][1][state]) != ".":
            yield edit
            state, left = step(state, edit, signature[len(signature) - left] if edit != "I" else ""), left - (edit != "I")


def step(state: int, edit: str, letter: str) -> int:
    """The grammar state after an edit; ``letter`` is that of the turn it edits."""
    if edit == "D":
        return state
    return 1 if edit == "K" and state == 0 and letter in "sS" else NEXT_STATE[state]


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct ``signatures`` (signature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [automaton.solve(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                                             names=["signature", "cost", "audit"])

    back = F.reverse("signature")
    return signatures.repartitionByRange(back).sortWithinPartitions(back).mapInArrow(run, "signature string, cost long, audit string")


def pieces(signature: str, audit: str, sizes: list[int]) -> Iterator[tuple[int, str]]:
    """The state and the edits with which each chunk (of ``sizes`` turns) is to be rewritten."""
    state, at, turn = 0, 0, 0
    for i, size in enumerate(sizes):
        start, first, end = state, at, turn + size
        while at < len(audit) and (turn < end or i == len(sizes) - 1):
            state = step(state, audit[at], "" if audit[at] == "I" else signature[turn])
            turn += audit[at] != "I"
            at += 1
        yield start, audit[first:at]


def rewritten(start: int, edits: str, turns: list[dict]) -> list[str]:
    """The repaired ``role:text`` lines of a chunk."""
    state, out, left = start, [], iter(turns)
    for edit in edits:
        turn = {"role": "", "text": ""} if edit == "I" else next(left)
        letter = turn["role"][:1] or "x"
        if edit != "D":
            role = turn["role"] if edit == "K" else "assistant" if NEXT_ROLE[state] == "a" else "user"
            out.append(f"{role}:{turn['text']}")
        state = step(state, edit, letter)
    return out


def _cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(r["conv"], c["bucket"], c["sub"], len(r["chunks"]), i, start, edits) for r in batch.to_pylist()
               for i, (c, (start, edits)) in enumerate(zip(r["chunks"], pieces(r["signature"], r["audit"], [c["n"] for c in r["chunks"]]), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                         names=["conv", "bucket", "sub", "n_chunks", "i", "start", "edits"])


def _rewrite(texts: bool):
    """Chunks with their edits to repaired lines; a digest where the chunk is the whole conversation, lines where it is
    not, or where ``texts`` are wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = rewritten(row["start"], row["edits"], row["turns"])
                alone, text = row["n_chunks"] == 1, "\n".join(lines)
                yield pa.RecordBatch.from_arrays([pa.array([row["conv"]], pa.string()), pa.array([row["i"]], pa.int64()), pa.array([len(lines)], pa.int64()), pa.array([text if texts or not alone else None], pa.string()),
                                                  pa.array([hashlib.sha256(text.encode()).hexdigest() if alone else None], pa.string())], names=["conv", "i", "n", "text", "sha256"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, conversation after conversation, to one digest each; holds one chunk at a time."""
    conv, held, begun = None, hashlib.sha256(), False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([held.hexdigest()], pa.string())], names=["conv", "sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    yield done()
                conv, held, begun = row["conv"], hashlib.sha256(), False
            if row["n"]:
                held.update((b"\n" if begun else b"") + row["text"].encode())
                begun = True
    if conv is not None:
        yield done()


def _made(conversations: DataFrame, columns: list[str], damage: bool, texts: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(conversations with counters and audits, their repaired chunks, folders to drop once both were used)."""
    if damage:
        rows = damaged(conversations, *columns)
    else:
        rows = conversations.select(*[F.col(quoted(c)).cast("long").alias(n) if n == "turn" else F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")).alias(n)
                                      for c, n in zip(columns, ("conv", "turn", "role", "text"), strict=True)])
    cut, cut_path = write_table(chunks(rows), "turn-chunks")
    parts = F.array_sort(F.collect_list(F.struct(F.col("bucket").isNotNull().alias("set"), "bucket", "sub", "n", "letters", "initials")))
    whole = cut.drop("turns").groupBy("conv").agg(parts.alias("parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "cut", "new")], F.min("low").alias("low"), F.max("high").alias("high"))
    initials = F.array_join("parts.initials", "")
    illegal = F.greatest(F.length(initials) - 1, F.lit(0)) - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("new"), F.lit(0))
    whole = whole.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", F.col("cut").alias("truncated"), illegal.cast("long").alias("illegal"),
                         F.array_join("parts.letters", "").alias("signature"), F.transform("parts", lambda p: F.struct(p["bucket"].alias("bucket"), p["sub"].alias("sub"), p["n"].alias("n"))).alias("chunks"))
    whole, whole_path = write_table(whole, "signatures")
    found, found_path = write_table(solved(whole.select("signature").distinct()), "audits")
    whole = whole.join(found, "signature")
    asked = whole.select("conv", "signature", "audit", "chunks").mapInArrow(_cut_audits, "conv string, bucket long, sub long, n_chunks long, i long, start int, edits string")
    asked = asked.withColumnsRenamed({"conv": "of", "bucket": "in_bucket", "sub": "in_sub"})
    meets = cut.join(asked, (F.col("conv") == F.col("of")) & F.col("bucket").eqNullSafe(F.col("in_bucket")) & (F.col("sub") == F.col("in_sub")))
    with batches_of(conversations.sparkSession, CHUNK_ROWS):
        made, made_path = write_table(meets.select("conv", "i", "n_chunks", "start", "edits", "turns").mapInArrow(_rewrite(texts), "conv string, i long, n long, text string, sha256 string"), "repaired-chunks")
    return whole.drop("signature", "chunks"), made, [cut_path, whole_path, found_path, made_path]


def _ids(conversations: DataFrame, conv_col: str) -> DataFrame:
    conv_id = F.col(quoted(conv_col))
    return conversations.select(conv_id.alias("conv_id"), F.coalesce(conv_id.cast("string"), F.lit(" ")).alias("conv")).distinct()


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """Cheapest repair of every conversation to turns with role initials ``(s?(ua)+)?``.

    With ``damage`` the rows are first damaged as ``damaged`` states; else they are taken as they are (nulls as one
    space too). Rows of a conversation are taken by turn (nulls first), then role, then text. A row's first fault
    counts: blank (nothing but blanks), duplicate (role and text seen earlier), truncated (last character that is no
    blank not one of ``.!?``). Keeping costs 0, another role (user or assistant) 1, deleting 2 (required for blank and
    duplicate), inserting an empty user or assistant turn 5; a truncated turn that stays costs 5 more.

    Returns one row per conversation of the input, also where no row is left: the id (a null one too), gaps
    (highest - lowest + 1 - distinct turn numbers, nulls aside), blank, duplicate, truncated, illegal (neighbours whose
    initials are not su, ua or au), cost, audit (initials of Keep, Rerole, Delete, Insert; ASCII-least of the cheapest)
    and repaired_sha256 (of the ``role:text`` lines). Repeated rows are duplicates. Whole texts are read, a chunk of
    turns at a time. Signature and audit, a character per turn, are values of one row, and the digest of a conversation
    of many chunks is one stream. Turns that share a bucket of turn numbers (all null ones, say) are ordered by one
    task, as a sort. Other columns are not read; an empty table gives an empty result.
    """
    spark = conversations.sparkSession
    whole, made, paths = _made(conversations, [conv_col, turn_col, role_col, text_col], damage, False)
    with batches_of(spark, CHUNK_ROWS):
        long = made.where("sha256 is null").repartition("conv").sortWithinPartitions("conv", "i").select("conv", "n", "text").mapInArrow(_digest, "conv string, sha256 string")
        digests, digests_path = write_table(made.where("sha256 is not null").select("conv", "sha256").unionByName(long), "repaired-digests")
    answers = whole.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").join(digests, "conv")
    out = _ids(conversations, conv_col).join(answers, "conv", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out, _ = write_table(out.select(F.col("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256")), "repairs")
    for path in [*paths, digests_path]:
        drop_table(spark, path)
    return out


def repaired_texts(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """The repaired conversations themselves: conv_id, chunk (from 0), n_turns and text (``role:text`` lines).

    Chunks of a conversation in order are its repaired turns; conversations that lose all turns have chunks of none.
    Edits and special cases are those of ``repair``, without damage unless it is asked for.
    """
    _, made, paths = _made(conversations, [conv_col, turn_col, role_col, text_col], damage, True)
    out, _ = write_table(_ids(conversations, conv_col).join(made, "conv").select("conv_id", F.col("i").alias("chunk"), F.col("n").alias("n_turns"), "text"), "repaired-texts")
    for path in paths:
        drop_table(conversations.sparkSession, path)
    return out
