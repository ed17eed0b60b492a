"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is exactly one token that can end its encoding: the one whose predecessor
(the last token of the shorter prefix) stays next to it when both are merged under the ranks. Storing that
one token per prefix gives the whole encoding by walking back, lets bytes be appended without touching what
is there, and bounds what an edit can change: prefixes before the edit keep their tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import small_batches, stray_columns

#: Unicode White_Space, the class \s of the pattern.
WHITE = r"\t-\r \x85\xa0  -     　"


#: Length of the word beginnings whose prefix tables are kept.
STEM = 8
#: Single marks that the pattern cuts from the word before them.
MARKS = frozenset(".,;:!?")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks file: one base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines() if x.strip())}


class PrefixCoder:
    """Encodes pieces by the prefix table; compatible pairs of tokens and unit encodings are memoised (bounded)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.ranks, self.memo = ranks, memo
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        names = [self.bytes_of.get(r, b"") for r in range(max(self.bytes_of) + 1)]
        self.length = np.array(list(map(len, names)))
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(names), np.uint8)
        self.find = regex.compile(pattern).findall
        self.units_of = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.odd = regex.compile(f"^[{WHITE}]|[{WHITE}]$").search
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}
        #: the tokens that merging their own bytes gives; only these can end a prefix
        self.formed = {t: r for t, r in ranks.items() if len(t) == 1 or self.split(r) is not None}
        self.pieces = _Memo(lambda p: self.packed(self.piece(p.encode())), memo)
        self.spaced = _Memo(lambda chunk: self.chunk(chunk, " "), memo)
        self.cut = _Memo(self.unit, memo)

    def split(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes ``token``; None for one byte, or when merging its bytes ends elsewhere."""
        if token not in self.split_of:
            whole = self.bytes_of[token]
            parts = [whole[i:i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best = min(((self.ranks.get(a + b, -1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                            if a + b in self.ranks), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.split_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split_of[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` remain two tokens when the bytes of both are merged together.

        Undoes their merges from the latest to the earliest; a pair across the border that could have merged
        before the merge undone last would have done so, and the two would not stand.
        """
        name, ranks, limit, good = self.bytes_of, self.ranks, 1 << 60, True
        a, b = left, right
        while True:
            joint = ranks.get(name[a] + name[b])
            # a tie in rank goes to the leftmost pair: the pair in hand if the limit stems from the right token
            if joint is not None and joint < limit:
                good = False
                break
            one, two = len(name[a]) == 1, len(name[b]) == 1
            if one and two:
                break
            if two or (not one and a > b):
                limit, a = a, self.split(a)[1]
            else:
                limit, b = b + 1, self.split(b)[0]
        if len(self.pairs) > 2 * self.memo:
            self.pairs.clear()
        self.pairs[left << 32 | right] = good
        return good

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """Fill the prefix table ``last`` (last[i]: final token of text[:i + 1]) up to the end of ``text``."""
        get, known, longest = self.formed.get, self.pairs.get, self.longest
        for end in range(len(last) + 1, len(text) + 1):
            start = end - longest if end > longest else 0
            while True:
                token = get(text[start:end])
                if token is not None:
                    if not start:
                        break
                    good = known(last[start - 1] << 32 | token)
                    if good or (good is None and self.stays(last[start - 1], token)):
                        break
                start += 1
            last.append(token)
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def piece(self, text: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token itself is that token."""
        whole = self.ranks.get(text)
        return [whole] if whole is not None else self.walk(self.extend(text, self.stem(text)))

    def stem(self, text: bytes) -> list[int]:
        """The table of the first bytes of ``text``; words that begin alike are appended to the same one."""
        if len(text) <= STEM:
            return []
        head = text[:STEM]
        table = self.stems.get(head)
        if table is None:
            if len(self.stems) >= self.memo:
                self.stems.clear()
            table = self.stems[head] = tuple(self.extend(head, []))
        return list(table)

    def edit(self, text: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace text[start:end] by ``new``: prefixes before the edit keep their entries, later ones are refilled
        until the entries repeat the old ones for a run as long as the longest token, after which they are copied."""
        changed = text[:start] + new + text[end:]
        table, shift, same = last[:start], len(new) - (end - start), 0
        while len(table) < len(changed):
            self.extend(changed[:len(table) + 1], table)
            at = len(table) - 1
            same = same + 1 if at >= start + len(new) and table[at] == last[at - shift] else 0
            if same >= self.longest:
                table += last[at - shift + 1:]
        return changed, table

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, text: str) -> bytes:
        """A run of white space and the run after it, as little-endian ids; pieces never reach past such a unit."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def chunk(self, text: str, before: str) -> bytes:
        """The unit of a chunk between single spaces, with the space before it.

        A word of letters is one piece, and a mark after it another: these need no pattern, and a word is encoded
        once for all marks that follow it.
        """
        if text.isalpha():
            return self.packed(self.piece((before + text).encode()))
        if before and text[:-1].isalpha() and text[-1] in MARKS:
            return self.spaced[text[:-1]] + self.pieces[text[-1]]
        if not text or self.odd(text):
            raise _Odd
        return self.unit(before + text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return b"".join([self.chunk(first, ""), *map(self.spaced.__getitem__, rest)])
        except _Odd:
            return b"".join(map(self.cut.__getitem__, self.units_of(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all tokens in a row, gathered from one buffer of the vocabulary."""
        tokens = np.frombuffer(ids, "<u4")
        length = self.length[tokens]
        ends = np.cumsum(length)
        at = np.repeat(self.start[tokens] - (ends - length), length)
        at += np.arange(len(at))
        return self.buffer[at].tobytes()


class _Odd(Exception):
    """White space other than single spaces between words: units must be cut by pattern."""


class _Memo(dict):
    """Bounded memo in two generations: a full young one becomes the old one, and what is used again returns."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole ``text``; a null text counts as empty.

    Adds ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` (lowercase hex of the little-endian unsigned 32-bit
    ids and of the decoded bytes) and, with ``keep_ids``, ``ids`` binary. Every input row gives one row; other
    columns pass through, input columns with an added name are replaced. Empty texts have no ids. The vocabulary
    is read on the driver and broadcast: its size is that of the ranks file, whatever the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        # a worker keeps the broadcast value between tasks, and with it the coder built there
        shared = spark.sparkContext.broadcast({"ranks": f.read()})
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    through = stray_columns(docs, set(added))
    frame = docs.select(*[F.col(f"`{c}`") for c in through])
    schema = T.StructType(list(frame.schema.fields))
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("ids", "binary")):
        if name in added:
            schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "coder" not in state:
            state["coder"] = PrefixCoder(load_ranks(state["ranks"]), pattern)
        coder = state["coder"]
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string())]
            if keep_ids:
                cols.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *added])

    return frame.mapInArrow(run, schema)
