"""Text embedders: the deterministic hashed bag-of-words (DataFrame functions)
and a pluggable model encoder (Arrow-batched pandas UDF, one load per task)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.vectors import l2_normalize

DEFAULT_DIMS = 64


def token_slot(token: Column, dims: int = DEFAULT_DIMS) -> Column:
    """Vector slot of a word: the first 32 bits of its SHA-1, modulo ``dims``."""
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def slot_counts(texts: DataFrame, key: str, text: str, dims: int = DEFAULT_DIMS) -> DataFrame:
    """(key, dim, c): words per hashed slot of each key's normalized text.

    Counts are combined before the shuffle, so a document ships at most
    ``dims`` small rows however long it is.
    """
    words = texts.select(key, F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return words.groupBy(key, token_slot(F.col("word"), dims).alias("dim")).agg(F.count(F.lit(1)).alias("c"))


#: Words whose slots a task remembers at most; then it starts anew.
REMEMBERED = 200_000


#: Capitals of Unicode 16, which Spark's lower-casing knows and the language's own folding may not yet.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}}
_HAS_NEW = re.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")
#: A surrogate written as UTF-8: one U+FFFD to Spark, three to the language's decoder.
_SURROGATE = re.compile(rb"\xed[\xa0-\xbf][\x80-\xbf]")


def _read(held: bytes) -> str:
    """A text's bytes as Spark's regular expressions read them, with new capitals lower-cased."""
    try:
        text = held.decode()
    except UnicodeDecodeError:
        text = _SURROGATE.sub(b"\xef\xbf\xbd", held).decode(errors="replace")
    return text if text.isascii() or not _HAS_NEW.search(text) else text.translate(NEW_CAPITALS)


class _Slots(dict):
    """Slot of a word (case-folded, if asked), hashed when it is first asked for."""

    def __init__(self, dims: int, fold: bool = False):
        super().__init__()
        self.dims, self.fold = dims, fold

    def __missing__(self, word: str) -> int:
        hashed = hashlib.sha1((word.casefold() if self.fold else word).encode()).hexdigest()
        slot = self[word] = int(hashed[:8], 16) % self.dims
        return slot

    def counts(self, words: list[str]) -> list[float] | None:
        if len(self) > REMEMBERED:
            self.clear()
        found = [0.0] * self.dims
        for slot, n in Counter(map(self.__getitem__, words)).items():
            found[slot] = float(n)
        return found if words else None


def word_counts(texts: DataFrame, text: str, dims: int = DEFAULT_DIMS, name: str = "words") -> DataFrame:
    """``texts`` with the words per slot of each normalized text as ARRAY<DOUBLE> instead of the text; null without words.

    Narrow, no shuffle: a task hashes a word once and remembers its slot.
    """
    others = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(dims)
        for batch in batches:
            out = [slots.counts([w for w in (value.as_py() or "").split(" ") if w]) for value in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(out, pa.list_(pa.float64()))], names=[*others, name])

    schema = T.StructType([*[texts.schema[c] for c in others], T.StructField(name, T.ArrayType(T.DoubleType()))])
    return texts.select(*others, text).mapInArrow(run, schema)


def keys_and_words(texts: DataFrame, text: str, key: str = "exact_key", name: str = "words", dims: int = DEFAULT_DIMS) -> DataFrame:
    """``texts`` with the ``exact_key`` and the ``word_counts`` of each text's normal form instead of the text.

    The language's own white space and case folding are what ``normalize_text`` spells out for Spark; here a text is split
    once for both, and a word is folded and hashed once a task. Bytes that are no UTF-8 become U+FFFD, as there. Narrow.
    """
    others = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(dims, fold=True)
        for batch in batches:
            keys, counts = [], []
            for value in batch.column("_bytes"):
                held = value.as_py()
                words = [] if held is None else _read(held).split()
                keys.append(None if held is None else hashlib.sha256(" ".join(words).casefold().encode()).hexdigest())
                counts.append(slots.counts(words))
            made = [pa.array(keys, pa.string()), pa.array(counts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *made], names=[*others, key, name])

    schema = T.StructType([*[texts.schema[c] for c in others], T.StructField(key, T.StringType()), T.StructField(name, T.ArrayType(T.DoubleType()))])
    return texts.select(*others, F.col(text).cast("string").cast("binary").alias("_bytes")).mapInArrow(run, schema)


def summed(rows: DataFrame, key: str, words: str, dims: int = DEFAULT_DIMS, name: str = "embedding") -> DataFrame:
    """(key, vector): the ``word_counts`` of a key's rows added up, combined before the shuffle; keys without words have no row."""
    counts = [F.sum(F.get(words, F.lit(i))).alias(f"_{i}") for i in range(dims)]
    return rows.where(F.col(words).isNotNull()).groupBy(key).agg(*counts).select(key, F.array(*[F.col(f"_{i}") for i in range(dims)]).alias(name))


def count_vectors(texts: DataFrame, key: str, text: str, dims: int = DEFAULT_DIMS, name: str = "embedding") -> DataFrame:
    """(key, vector): the slot counts as ARRAY<DOUBLE>; keys without words have
    no row. Keys whose rows repeat one text get a multiple of its vector."""
    slots = slot_counts(texts, key, text, dims).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("dim", F.col("c").cast("double").alias("c")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return slots.select(key, dense.alias(name))


def hash_embed(texts: DataFrame, key: str, text: str, dims: int = DEFAULT_DIMS) -> DataFrame:
    """(key, embedding): unit-length hashed bag-of-words vectors."""
    counts = count_vectors(texts, key, text, dims)
    return counts.select(key, l2_normalize("embedding").alias("embedding"))


def model_embed(encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                dims: int) -> Callable[[Column], Column]:
    """Wrap a user-supplied text encoder as an iterator pandas UDF.

    ``encoder_factory`` is called once per task (the heavy model load), and
    the encoder then sees whole Arrow batches. Output rows are unit-normalized
    like the reference's production embedder.
    """
    @F.pandas_udf("array<double>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_factory()
        for texts in batches:
            mat = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), dims)
            norms = np.linalg.norm(mat, axis=1, keepdims=True)
            mat = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0)
            yield pd.Series(list(mat))

    return _embed
