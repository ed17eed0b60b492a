"""Line deduplication over levelled sorted runs of line keys.

Documents come in batches. A batch's distinct line keys are merge-joined against the sorted runs of earlier
batches: keys that no run holds yet are new and enter the batch's own run together with the document that keeps
the line; keys already held add only their document count. Runs sit in levels; when a level has ``fanout`` of
them they are merged into one run of the next level. Once the last batch is in, the runs tell in how many
documents each line occurs and which document keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import drop_table, masked, quoted, small_batches, stray_columns, write_table

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte key of a UTF-8 line without outer blanks, A-Z lowered; None below ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    plain = line.strip(BLANKS).lower()
    if len(plain) < min_chars or (not plain.isascii() and len(plain.decode()) < min_chars):
        return None
    return hashlib.blake2b(plain, digest_size=16).digest()


class SortedRuns:
    """Levelled runs of (key, n_docs, keeper), each a written table sorted by key within its partitions.

    ``keeper`` is set in the one run that saw the key first, null in later ones, so the rows with a keeper are
    the distinct keys known so far.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run, _ in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key, n_docs, keeper), one row per key of a batch."""
        known = self.all()
        if known is not None:
            seen = known.where("keeper is not null").select("key", F.lit(True).alias("seen"))
            batch = batch.hint("merge").join(seen, "key", "left").select(
                "key", "n_docs", F.when(F.col("seen").isNull(), F.col("keeper")).alias("keeper"))
        self._put(0, batch.sortWithinPartitions("key"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(write_table(run, f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, totals(reduce(DataFrame.unionByName, [r for r, _ in old])).sortWithinPartitions("key"))
            for _, path in old:
                drop_table(self.spark, path)


def totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def line_postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) for every distinct long line of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = {line_key(x, min_chars) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")}
                held.discard(None)
                ids += [doc] * len(held)
                keys += held
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.mapInArrow(run, "doc_id long, key binary")


def repeated_lines(postings: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(key, keeper) of the keys held by at least ``min_docs`` documents; ``keeper``: the largest such doc_id.

    ``postings`` (doc_id, key, batch): batches go in by number, the one with the largest documents first.
    """
    runs = SortedRuns(postings.sparkSession, fanout)
    for b in range(batches):
        part = postings.where(F.col("batch") == b).groupBy("key").agg(
            F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        runs.add(part)
    return totals(runs.all()).where(F.col("n_docs") >= min_docs).select("key", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
                batches: int = 4, fanout: int = 4) -> DataFrame:
    """Drop lines that repeat across documents, except in the largest document that holds them.

    A line's key is the line without outer blanks (space, \\t to \\r), A-Z lowered; only keys of ``min_chars`` code
    points or more count. A key found in ``min_docs`` documents (distinct ids) or more loses its lines everywhere
    but in the document with the largest id. The rest of each text stays, joined by newlines.

    Returns every row of ``docs`` with ``text`` replaced, ``n_lines`` (before) and ``n_dropped``; columns of those
    names in the input are replaced, others pass through. A null or empty text is one empty line and comes back
    empty. Rows that repeat an id count as one document and are treated alike. A row without id is no document: it
    is neither counted nor changed. Very long texts and lines are read whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).where("doc_id is not null")
    ends = plain.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (ends.low or 0, ends.high or 0)
    width = (high - low) // batches + 1
    batch = F.expr(f"int(({high}BD - doc_id) div {width}BD)")  # exact for ids of any span
    stored, _ = write_table(line_postings(plain, min_chars).withColumn("batch", batch), "line-postings")
    hot, _ = write_table(repeated_lines(stored, min_docs, batches, fanout), "repeated-lines")
    drops = stored.join(hot, "key").where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(
        F.collect_set("key").alias("__drop")).withColumnRenamed("doc_id", "__doc")

    through = stray_columns(docs, {text_col, "n_lines", "n_dropped"})
    inside, outside = masked(docs, through)
    rows = docs.select(*inside, F.col(quoted(text_col)).alias("__text"),
                       F.col(quoted(id_col)).cast("long").alias("__id"))
    joined = rows.join(drops.hint("shuffle_hash"), F.col("__id") == F.col("__doc"), "left").select(*[f"__in{i}" for i in range(len(through))], "__text", "__drop")
    schema = rows.select(*[f"__in{i}" for i in range(len(through))]).schema.add("__kept", "string").add("__lines", "long").add("__dropped", "long")

    def strip(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(rb.column("__text"), rb.column("__drop").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if drop:
                    drop, lines = set(drop), data.split(b"\n")
                    kept = [x for x in lines if line_key(x, min_chars) not in drop]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept))
                else:
                    n_lines.append(data.count(b"\n") + 1)
                    n_dropped.append(0)
                    texts.append(data)
            yield pa.RecordBatch.from_arrays(
                [*rb.columns[:-2], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return joined.mapInArrow(strip, schema).select(*outside, F.col("__kept").alias(text_col), F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))
