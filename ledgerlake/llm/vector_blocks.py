"""Vectors packed into row blocks, and block pairs, for matrix work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import quoted


def usable(vectors: DataFrame, id_col: str, vector_col: str, zeros: bool) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: id and vector not null, not empty, every component finite; with
    ``zeros`` also vectors that are all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)).where(~bad)
    return (rows if zeros else rows.where(F.exists(v, lambda x: x != 0))).withColumn("dim", F.size("v"))


def first_copies(rows: DataFrame, n: int) -> DataFrame:
    """Of rows (vec_id, v, dim) with equal vectors only the ``n`` smallest ids, each id once.

    Equal vectors have equal scores and ties go to the smaller id, so for n = k + 1 (the query itself is no
    candidate) no other copy can be among the k best. The limit is applied by every task before the shuffle.
    """
    best = Window.partitionBy("v").orderBy("vec_id")
    return rows.dropDuplicates(["v", "vec_id"]).withColumn("copy", F.row_number().over(best)).where(F.col("copy") <= n).drop("copy")


def lanes_for(blocks: DataFrame, held: int = 64) -> int:
    """Lanes for ``tiles``: enough for all cores, and at most about ``held`` row blocks a lane."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return max(4 * cores, -(-blocks.count() // held))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, data): rows (vec_id, v, dim) in blocks of at most ``size`` rows of one length.

    Rows are dealt evenly and every task cuts its own rows into blocks, so no block depends on a key's frequency.
    ``block`` is unique; ids are little-endian longs, data row-major doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def full(dim: int) -> pa.RecordBatch:
            ids, vs = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                                               pa.array([np.stack(vs).astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            column = batch.column("v")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            start = ends[0]
            for i, (vec, dim) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                ids, vs = held.setdefault(dim, ([], []))
                ids.append(vec)
                vs.append(flat[ends[i] - start:ends[i + 1] - start])
                if len(ids) >= size:
                    yield full(dim)
        for dim in list(held):
            yield full(dim)

    blocks = rows.select("vec_id", "v", "dim").mapInArrow(run, "dim int, ids binary, data binary")
    return blocks.withColumn("block", F.monotonically_increasing_id())


#: Queries whose results a task holds before it passes them on: the memory of a tile task, whatever the order of tiles.
HELD_QUERIES = 20_000


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def tiles(queries: DataFrame, rows: DataFrame, spread: int) -> DataFrame:
    """Every query block next to every row block of the same length of vector (``q_`` and ``r_`` columns).

    The query set is the stated one; it meets all rows in blocks. Row blocks are dealt to ``spread`` lanes and each
    query block is copied to each lane, so a task holds some row blocks against all query blocks of its lane.
    """
    lane: Column = F.pmod(F.xxhash64("r_block"), F.lit(spread))
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in ("dim", "block", "ids", "data")]).withColumn("lane", lane)
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "block", "ids", "data")]).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return left.join(right, (left.lane == right.lane) & (F.col("q_dim") == F.col("r_dim"))).drop("lane")
