"""Centroid clustering (Lloyd's rounds) that skips exact scans by bounds with geometric drift tightening.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of that to any other. When
the centroids move, the upper bound grows by the own centroid's drift. The lower bound need not shrink by a full
drift: a cluster's vectors lie in a sphere, and in the plane through the sphere's centre and both ends of another
centroid's move the distance lost is bounded by the move times the cosine of the smallest angle, seen from the
middle of the move, between the move and the sphere. Vectors whose bounds overlap are scanned exactly. All
distances and sums that decide anything are integers.

Vectors travel as blocks of rows with their bounds; a round is one narrow pass over the blocks and one aggregate of
a row per cluster and block. The driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLOCK_ROWS, batches_of, drop_table, quoted, write_table

#: Components up to here: any squared distance of LARGEST_DIM of them fits a long.
LARGEST = 1 << 27
#: Components up to here: squared distances are exact in double precision, so a block is one matrix product.
IN_DOUBLES = 1 << 22
LARGEST_DIM = 64

_PART = "struct<cluster:int,n:bigint,radius:double,scanned:bigint,inertia:decimal(38,0),sums:array<bigint>>"
_STATE = f"ids array<bigint>, data binary, cluster binary, upper binary, lower binary, distance binary, parts array<{_PART}>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every row of ``x`` to every row of ``c`` (int64)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= IN_DOUBLES:
        fx, fc = x.astype(float), c.astype(float)
        return ((fx * fx).sum(axis=1)[:, None] - 2 * (fx @ fc.T) + (fc * fc).sum(axis=1)[None]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        gap = x - row
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By cluster the most that the distance of any vector in its sphere (centre ``old``) to another centroid shrinks.

    For a move from a to b with middle m and length d, |x-a| - |x-b| = 2 d s / (|x-a| + |x-b|), s being x's distance
    past the plane in the middle; the sum is at least 2 |x-m|, so the loss is at most d cos(angle at m). The smallest
    angle over a sphere is that of its centre less the sphere's half opening; a sphere around m allows the full d.
    """
    a, b = old.astype(float), new.astype(float)
    move = b - a
    d = np.sqrt((move * move).sum(axis=1))
    away = a[:, None] - ((a + b) / 2)[None]  # from the middle of j's move to the centre of sphere i
    far = np.sqrt((away * away).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((away * move[None]).sum(axis=2) / (far * d[None]), -1, 1))
        opening = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    nearest = np.where(far > radius[:, None], np.maximum(angle - opening, 0), 0.0)
    lost = np.where(d[None] > 0, d[None] * np.clip(np.cos(nearest) + 1e-9, 0, 1), 0.0)
    np.fill_diagonal(lost, 0.0)
    return lost.max(axis=1, initial=0.0)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings ``cluster`` and both bounds (in place) up to date with ``centroids``; how many rows were scanned."""
    def doubtful(at: np.ndarray) -> np.ndarray:
        margin = 1e-9 * (1 + upper[at] + np.abs(np.where(np.isfinite(lower[at]), lower[at], 0)))
        return at[upper[at] + margin >= lower[at]]

    at = doubtful(np.arange(len(x)))
    gap = x[at] - centroids[cluster[at]]
    upper[at] = np.sqrt((gap * gap).sum(axis=1))
    at = doubtful(at)
    if len(at):
        d = squared(x[at], centroids)
        cluster[at] = d.argmin(axis=1)  # the first of equals
        upper[at] = np.sqrt(d.min(axis=1))
        lower[at] = np.sqrt(np.partition(d, 1, axis=1)[:, 1]) if d.shape[1] > 1 else np.inf
    return len(at)


def _parts(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, scanned: int, distance: np.ndarray | None) -> list[dict]:
    out = []
    for c in np.unique(cluster).tolist():
        mine = cluster == c
        out.append({"cluster": c, "n": int(mine.sum()), "radius": float(upper[mine].max()), "scanned": scanned if not out else 0,
                    "inertia": sum(distance[mine].tolist()) if distance is not None else 0, "sums": x[mine].sum(axis=0).tolist()})
    return out


def _cut(scale: int, dim: int, block_rows: int):
    """Rows (vec_id, v) to blocks of integer vectors with bounds that leave everything open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                cut = batch.slice(at, block_rows)
                x = np.floor(scale * cut.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, dim)
                if len(x) and np.abs(x).max() > LARGEST:
                    raise OverflowError(f"a component beyond {LARGEST / scale:g}: its squared distances need not fit a long")
                yield _block(cut.column("vec_id").to_pylist(), x.astype(np.int32), np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.full(len(x), -np.inf), None, [])

    return run


def _block(ids: list, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, distance: np.ndarray | None, parts: list[dict]) -> pa.RecordBatch:
    part = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("scanned", pa.int64()), ("inertia", pa.decimal128(38, 0)), ("sums", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
         pa.array([upper.astype("<f8").tobytes()], pa.binary()), pa.array([lower.astype("<f8").tobytes()], pa.binary()),
         pa.array([None if distance is None else distance.astype("<i8").tobytes()], pa.binary()), pa.array([parts], pa.list_(part))],
        names=["ids", "data", "cluster", "upper", "lower", "distance", "parts"])


def _round(centroids: np.ndarray, drift: np.ndarray, lost: np.ndarray, last: bool):
    """One assignment of every block; ``drift`` and ``lost`` by cluster are what the centroids' last move costs the bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["data"], "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
                cluster, upper, lower = (np.frombuffer(row[c], t).copy() for c, t in (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
                upper += drift[cluster]
                lower -= lost[cluster]
                scanned = assign(x, centroids, cluster, upper, lower)
                distance = None
                if last:
                    gap = x - centroids[cluster]
                    distance = (gap * gap).sum(axis=1)
                yield _block(row["ids"], x, cluster, upper, lower, distance, _parts(x, cluster, upper, scanned, distance))

    return run


def _totals(state: DataFrame, dim: int) -> list:
    """A row for each non-empty cluster: at most as many as centroids."""
    part = state.select(F.explode("parts").alias("p")).select("p.*")
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim)]
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned"), F.sum("inertia").alias("inertia"), *sums).collect()


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id",
            vector_col: str = "embedding", block_rows: int = 2048, trace: list | None = None) -> DataFrame:
    """Clusters of the rows whose vector has exactly ``dim`` (at most 64) components, none null or non-finite.

    Components become floor(scale * x). The first centroids are the ``clusters`` vectors with the smallest lower-case
    hex sha256 of ``seed:id`` (all, if fewer; of equal ids the smaller vector first; rows without id last). Each
    round assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and
    replaces every non-empty one by floor(sum / count) by component; then vectors are assigned once more.

    Returns one row per kept row: vec_id, cluster, distance (squared), cluster_inertia, inertia (distances summed over
    the cluster, over all) and centroid_sha256 (of the final centroid's components as decimals joined by commas).
    Repeated rows count as often as they occur; a null id is returned as it is; other rows and columns are not read
    on; an empty table gives an empty result. A component beyond 2^27 / scale stops the job with an OverflowError,
    since distances might not fit a long. ``trace`` collects how many vectors each assignment scanned exactly.
    """
    assert 0 < dim <= LARGEST_DIM, "distances fit a long up to 64 components"
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    rows = rows.where(F.size(v) == dim).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(rank.asc_nulls_last(), "v").limit(clusters).collect()  # at most ``clusters`` rows
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.floor(scale * np.array([r.v for r in first], float)).astype(np.int64)
    still = np.zeros(len(centroids))
    drift, lost = still, still
    state, path = rows.mapInArrow(_cut(scale, dim, block_rows), _STATE), ""
    with batches_of(spark, block_rows):
        state, path = write_table(state, "cluster-blocks")
    for turn in range(rounds + 1):
        with batches_of(spark, BLOCK_ROWS):
            after, after_path = write_table(state.mapInArrow(_round(centroids, drift, lost, turn == rounds), _STATE), "cluster-blocks")
        drop_table(spark, path)
        state, path = after, after_path
        totals = _totals(state, dim)
        if trace is not None:
            trace.append(sum(t.scanned for t in totals))
        if turn < rounds:
            moved, radius = centroids.copy(), np.zeros(len(centroids))
            for t in totals:
                moved[t.cluster] = [int(t[f"s{i}"]) // t.n for i in range(dim)]
                radius[t.cluster] = t.radius
            gap = (moved - centroids).astype(float)
            drift, lost = np.sqrt((gap * gap).sum(axis=1)), loosening(centroids, moved, radius)
            centroids = moved
    own = {t.cluster: int(t.inertia) for t in totals}
    if sum(own.values()) >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["cluster"], "<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(at, pa.int32()), pa.array(np.frombuffer(row["distance"], "<i8")), pa.array([own[c] for c in at.tolist()], pa.int64()),
                     pa.array([sum(own.values())] * len(at), pa.int64()), pa.array([names[c] for c in at.tolist()], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.select("ids", "cluster", "distance").mapInArrow(unpacked, RESULT)
