"""Near-duplicate vectors by an exact metric range join.

A cosine limit is a distance limit between unit vectors. Within a label every vector goes to the cell of its nearest
pivot, and the triangle inequality tells which other cells can hold a vector in range of it: it is copied to those
and no others. Every cell then joins by itself: its own vectors, in blocks, meet the cell's blocks. The inequality is
used once more between blocks, whose centres and radii may prove that all pairs or none are in range; other pairs of
blocks are one matrix product. Tasks return a count per vector and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLOCK_ROWS, batches_of, connected_components, drop_table, quoted, write_table

#: Home blocks that share a copy of their cell's blocks; nodes whose results a task holds before it passes them on.
LANE_BLOCKS, HELD_NODES = 16, 400_000
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows (none zero) scaled to length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit rows."""
    return np.sqrt(np.clip(2 - 2 * (x @ y.T), 0, None))


def reach(cosine: float) -> float:
    """The distance between unit vectors at that cosine."""
    return float(np.sqrt(max(2 - 2 * cosine, 0.0)))


def guests(d: np.ndarray, own: np.ndarray, between: np.ndarray, radius: np.ndarray, limit: float) -> np.ndarray:
    """Which other cells may hold a vector within ``limit``: a boolean by row and pivot.

    ``d``: distances to the pivots, ``own``: nearest pivot, ``between``: distances of pivots, ``radius`` by cell. For
    a vector x of cell p near y: d(y,p) <= d(x,p) + limit <= radius + limit, and since x is no nearer to y's pivot q,
    the plane between p and q is crossed: d(y,p)^2 - d(y,q)^2 <= 2 d(p,q) limit (so d(y,p) - d(y,q) <= 2 limit).
    """
    q = d[np.arange(len(d)), own]
    out = (d <= radius[None] + limit + SLACK) & (d * d - (q * q)[:, None] <= 2 * between[own] * limit + SLACK)
    out[np.arange(len(d)), own] = False
    return out


def choose(sample: np.ndarray, most: int, limit: float, max_copies: float) -> np.ndarray:
    """As many of the sampled unit vectors as pivots, at most ``most``, as keep a vector's expected copies within bounds."""
    n = min(most, len(sample))
    while n > 1:
        p, rest = sample[:n], sample[n:] if len(sample) > n else sample
        d = distances(rest, p)
        if guests(d, d.argmin(axis=1), distances(p, p), np.full(n, np.inf), limit).sum(axis=1).mean() <= max_copies:
            break
        n //= 2
    return sample[:n]


def forest(hit: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, row) and (row, column) edges that connect what ``hit`` connects."""
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return [], []
    part = hit[np.ix_(rows, cols)]
    label, none = np.arange(len(rows)), len(rows)
    while True:
        of_col = np.where(part, label[:, None], none).min(axis=0)
        after = np.minimum(np.where(part, of_col[None], none).min(axis=1), label)
        if (after == label).all():
            break
        label = after
    return [(int(rows[i]), int(rows[j])) for i, j in enumerate(label.tolist()) if i != j], list(zip(rows[of_col].tolist(), cols.tolist(), strict=True))


def _placed(pivots: dict[str, np.ndarray]):
    """Every vector with its cell (nearest pivot) and the distance to it; -1 where the label is one cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, cell, dist = batch.column("part").to_pylist(), np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for name, at, x in _by_part(batch, pivots):
                d = distances(x, pivots[name])
                cell[at] = d.argmin(axis=1)
                dist[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(part, pa.string()), batch.column("n"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(dist)],
                                             names=["node", "part", "n", "v", "cell", "dist"])

    return run


def _by_part(batch: pa.RecordBatch, pivots: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    part = np.array(batch.column("part").to_pylist(), object)
    for name in set(part.tolist()) & pivots.keys():
        at = np.flatnonzero(part == name)
        dim = pivots[name].shape[1]
        yield name, at, units(batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _copied(pivots: dict[str, np.ndarray], radius: dict[str, np.ndarray], limit: float):
    """A row of every vector for each further cell it is copied to."""
    between = {k: distances(p, p) for k, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, x in _by_part(batch, pivots):
                d = distances(x, pivots[name])
                a, cell = np.nonzero(guests(d, d.argmin(axis=1), between[name], radius[name], limit))
                for i in range(0, len(a), 4096):
                    take = pa.array(at[a[i:i + 4096]])
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("node", "part", "n", "v")] + [pa.array(cell[i:i + 4096], pa.int32())],
                                                     names=["node", "part", "n", "v", "cell"])

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block: ids, class sizes, vectors, and the centre and radius of their unit vectors."""
    x = np.stack(table["v"].to_pylist()).astype("<f8")
    u = units(x)
    centre = u.mean(axis=0)
    radius = float(np.sqrt(((u - centre) ** 2).sum(axis=1)).max())
    return pa.table({"part": pa.array([key[0].as_py()], pa.string()), "cell": pa.array([key[1].as_py()], pa.int32()), "home": pa.array([key[2].as_py()], pa.bool_()),
                     "block": pa.array([key[3].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()),
                     "nodes": pa.array([table["node"].to_numpy().astype("<i8").tobytes()], pa.binary()), "ns": pa.array([table["n"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                     "data": pa.array([x.tobytes()], pa.binary()), "centre": pa.array([centre.astype("<f8").tobytes()], pa.binary()), "radius": pa.array([radius])})


_BLOCK = "part string, cell int, home boolean, block int, dim int, nodes binary, ns binary, data binary, centre binary, radius double"


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, components added in their order."""
    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def in_range(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether rows of two blocks reach the cosine; what rounding could decide is computed pair by pair."""
    near = units(x) @ units(y).T
    hit = near >= cosine
    a, b = np.nonzero(np.abs(near - cosine) <= SLACK)
    if len(a):
        hit[a, b] = cosines(x[a], y[b]) >= cosine
    return hit


def _join(cosine: float):
    """Pairs of blocks (h_, o_) to counts (a, n) of linked vectors of the home block, and links (a, b)."""
    limit = reach(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def flush() -> pa.RecordBatch:
            a, n = list(counts.keys()), list(counts.values())
            stars = [(find(x), x) for x in list(root) if find(x) != x]  # every node next to the one that stands for its group
            out = pa.RecordBatch.from_arrays([pa.array(a + [x for x, _ in stars], pa.int64()), pa.array([None] * len(a) + [y for _, y in stars], pa.int64()),
                                              pa.array(n + [None] * len(stars), pa.int64())], names=["a", "b", "n"])
            counts.clear()
            root.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                same = row["o_home"] and row["h_block"] == row["o_block"]
                gap = float(np.sqrt(((np.frombuffer(row["h_centre"], "<f8") - np.frombuffer(row["o_centre"], "<f8")) ** 2).sum()))
                if gap - row["h_radius"] - row["o_radius"] > limit + SLACK:
                    continue
                mine, other, ns = (np.frombuffer(row[c], "<i8") for c in ("h_nodes", "o_nodes", "o_ns"))
                if gap + row["h_radius"] + row["o_radius"] < limit - SLACK:  # all in range of all
                    found = np.full(len(mine), ns.sum()) - (ns if same else 0)
                    edges = [(int(mine[0]), int(x)) for x in other] + [(int(x), int(other[0])) for x in mine]
                else:
                    hit = in_range(np.frombuffer(row["h_data"], "<f8").reshape(-1, row["h_dim"]), np.frombuffer(row["o_data"], "<f8").reshape(-1, row["h_dim"]), cosine)
                    if same:
                        np.fill_diagonal(hit, False)
                    found = hit @ ns
                    rr, rc = forest(hit)
                    edges = [(int(mine[i]), int(mine[j])) for i, j in rr] + [(int(mine[i]), int(other[j])) for i, j in rc]
                for i in np.flatnonzero(found).tolist():
                    counts[int(mine[i])] = counts.get(int(mine[i]), 0) + int(found[i])
                for x, y in edges:
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            if len(counts) + len(root) > HELD_NODES:
                yield flush()
        yield flush()

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cell_rows: int = 2048, max_cells: int = 4096, max_copies: float = 8, block_rows: int = 512) -> DataFrame:
    """Links between vectors of one label whose cosine (double precision) is at least ``cosine`` (above 0).

    Returns one row per id: vec_id, n_links (other vectors linked directly), component_id (the smallest id reachable,
    itself included) and kept (vec_id = component_id). Vectors that are null, empty, all zero or hold a null or
    non-finite component link with nothing, nor do those with a null label; so do vectors of different lengths. Rows
    that repeat an id are one vector; of several the largest (as label text, then array) counts, usable ones first.
    Rows without id are one row that links with nothing, with a null component, kept. Other columns are not read. An
    empty table gives an empty result.

    Equal vectors of a label are one class and are joined once. Pivots come from a sample of at most about 2
    ``max_cells`` vectors over all labels with more than ``cell_rows`` classes; with fewer pivots where a vector
    would have to be copied to more than ``max_copies`` cells. The choice of pivots changes the work, not the result.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(label_col)).cast("string").alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad, F.lit(False))
    part = F.concat_ws(":", F.size(v).cast("string"), "label")
    rows = rows.select("vec_id", F.when(fine, F.struct(part.alias("part"), "v")).alias("w")).groupBy("vec_id").agg(F.max("w").alias("w"))
    rows, _ = write_table(rows.select("vec_id", "w.part", "w.v"), "labelled-vectors")
    classes, classes_path = write_table(rows.where("part is not null").groupBy("part", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vector-classes")

    # pivots: of the labels with more than a cell of classes, at most ``max_cells`` cells in all
    total = classes.count()
    target = max(cell_rows, -(-total // max_cells))
    large = {r.part: r["count"] for r in classes.groupBy("part").count().where(F.col("count") > target).collect()}  # at most max_cells labels
    pivots: dict[str, np.ndarray] = {}
    if large:
        share = F.create_map(*[x for k, n in large.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 / target)))])
        sample = classes.where((F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)) < F.coalesce(F.try_element_at(share, F.col("part")), F.lit(0.0))).select("part", "node", "v").collect()
        for k, n in large.items():
            mine = sorted((r.node, r.v) for r in sample if r.part == k)
            if len(mine) > 1 and len(p := choose(units(np.array([x for _, x in mine])), -(-n // target), reach(cosine), max_copies)) > 1:
                pivots[k] = p
    limit = reach(cosine)
    seats, seats_path = write_table(classes.mapInArrow(_placed(pivots), "node long, part string, n long, v array<double>, cell int, dist double"), "cells")
    homes = seats.select("node", "part", "n", "v", "cell", F.lit(True).alias("home"))
    if pivots:
        radius = {k: np.full(len(p), -np.inf) for k, p in pivots.items()}  # an empty cell takes no guests
        for r in seats.where("cell >= 0").groupBy("part", "cell").agg(F.max("dist").alias("r")).collect():  # at most a row per pivot
            radius[r.part][r.cell] = r.r
        copies = seats.where("cell >= 0").select("node", "part", "n", "v").mapInArrow(_copied(pivots, radius, limit), "node long, part string, n long, v array<double>, cell int")
        copies, copies_path = write_table(copies, "cell-guests")
        every = homes.unionByName(copies.withColumn("home", F.lit(False)))
    else:
        copies_path, every = None, homes
    sizes = every.groupBy("part", "cell", "home").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = every.join(sizes, ["part", "cell", "home"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packed = dealt.select("part", "cell", "home", "block", "node", "n", "v").groupBy("part", "cell", "home", "block").applyInArrow(_pack, _BLOCK)
    blocks, blocks_path = write_table(packed, "cell-blocks")

    # every home block meets all blocks of its cell; lanes share out the home blocks of a large cell
    lanes = blocks.where("home").groupBy("part", "cell").agg((F.floor(F.max("block") / LANE_BLOCKS)).cast("int").alias("lanes"))
    columns = ("home", "block", "dim", "nodes", "ns", "data", "centre", "radius")
    left = blocks.where("home").select("part", "cell", F.floor(F.col("block") / LANE_BLOCKS).cast("int").alias("lane"), *[F.col(c).alias(f"h_{c}") for c in columns])
    right = blocks.join(lanes, ["part", "cell"]).select("part", "cell", F.explode(F.sequence(F.lit(0), F.col("lanes"))).alias("lane"), *[F.col(c).alias(f"o_{c}") for c in columns])
    with batches_of(spark, BLOCK_ROWS):
        found, found_path = write_table(left.join(right, ["part", "cell", "lane"]).drop("part", "cell", "lane").mapInArrow(_join(cosine), "a long, b long, n long"), "range-links")

    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    links = found.where("b is not null").select("a", "b")
    classes = classes.join(counts, "node", "left")
    if links.take(1):
        classes = classes.join(connected_components(links), "node", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    named = classes.select("part", "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out, _ = write_table(rows.join(named, ["part", "v"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "linked-vectors")
    for path in (classes_path, seats_path, blocks_path, found_path, copies_path):
        if path:
            drop_table(spark, path)
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
