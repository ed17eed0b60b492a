"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate links.

One hash per shingle serves all bins: the hash range is cut into equal bins, each bin keeps its smallest hash, and
an empty bin copies the bin that a fixed random probe sequence of its own finds first (optimal densification).
Runs of bins form bands; documents that agree in a band share a bucket. A bucket emits only links from one
centre to its other members, so a round's candidates number at most bands x documents. Links are confirmed on
full shingle sets. Further rounds elect other centres and link only members that are still in different
components. What the rounds leave in buckets of several components is settled exactly: similar sets share one of
their rarest shingles (prefix filter), and every pair of different components that does is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import connected_components, drop_table, quoted, small_batches, write_table

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (multiply and fold)."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Words(dict):
    """Word to 64-bit hash; bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingles:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.words = width, _Words()
        self.factors = [_U((0xA24BAED4963EE407 * (2 * i + 1)) % (1 << 64) | 1) for i in range(width)]

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z only, cut at space and \t to \r
        if not words:
            return np.empty(0, _U)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], _U)
        w = np.fromiter(map(self.words.__getitem__, words), _U, len(words))
        n = len(words) - self.width + 1
        total = w[:n] * self.factors[0]
        for i in range(1, self.width):
            total += w[i:n + i] * self.factors[i]
        return np.unique(_mix(total))


class Signer:
    """Band keys of a sorted hash set."""

    def __init__(self, bands: int, rows: int, tries: int = 256):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        step = (1 << 64) // self.bins
        self.edges = np.array([i * step for i in range(self.bins)], _U)
        # each bin's own probe sequence, the same for every document
        at = np.arange(self.bins * tries, dtype=_U).reshape(self.bins, tries)
        self.probe = (_mix(at + _U(0x5851F42D4C957F2D)) % _U(self.bins)).astype(np.int64)
        self.factors = _mix(np.arange(1, rows + 1, dtype=_U)) | _U(1)
        self.salt = _mix(np.arange(bands, dtype=_U) + _U(977))

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.edges)
        filled = np.append(first[1:], len(hashes)) > first
        values = hashes[np.minimum(first, len(hashes) - 1)]
        source = np.arange(self.bins)
        empty = np.flatnonzero(~filled)
        for t in range(self.probe.shape[1]):
            if not len(empty):
                break
            found = self.probe[empty, t]
            hit = filled[found]
            source[empty[hit]] = found[hit]
            empty = empty[~hit]
        if len(empty):  # no probe hit (a few shingles only): the next filled bin, cyclically
            full = np.flatnonzero(filled)
            source[empty] = full[np.searchsorted(full, empty) % len(full)]
        sig = values[source].reshape(self.bands, self.rows)
        return _mix((_mix(sig) * self.factors).sum(axis=1, dtype=_U) + self.salt)


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent sums over the set; with its size they name the set."""
    return int(_mix(hashes + _U(0x1234567)).sum(dtype=_U).astype(np.int64)), int((_mix(hashes ^ _U(0xABCDEF0123)) * _U(0xC2B2AE3D27D4EB4F)).sum(dtype=_U).astype(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield doc, text.as_buffer().to_pybytes() if text.is_valid else b""


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, f1, f2, keys): set size, set fingerprint and band keys of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sign = Shingles(width), Signer(bands, rows)
        for batch in batches:
            ids, n, f1, f2, keys = [], [], [], [], []
            for doc, text in _texts(batch):
                hashes = cut.of(text)
                a, b = _fingerprint(hashes)
                ids.append(doc)
                n.append(len(hashes))
                f1.append(a)
                f2.append(b)
                keys.append(sign.bands_of(hashes) if len(hashes) else np.empty(0, _U))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(keys)],
                                             names=["doc_id", "n", "f1", "f2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, f1, f2, shingles) for ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(width)
        for batch in batches:
            ids, prints, sets = [], [], []
            for doc, text in _texts(batch):
                hashes = cut.of(text)
                ids.append(doc)
                prints.append(_fingerprint(hashes))
                sets.append(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                                              pa.array([p[1] for p in prints], pa.int64()), _lists(sets)], names=["node", "f1", "f2", "shingles"])

    return docs.mapInArrow(run, "node long, f1 long, f2 long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union.

    No aggregate follows the joins, so a centre with very many members is a skewed join that can be split.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


CELLS = 1 << 18  # counters of shingles, told apart by the low bits of their hashes
SMALL = 64  # members of a shingle's posting up to which its pairs are listed


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` (shingles) fall into each cell; size: CELLS, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (CELLS - 1), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    found = sets.select("shingles").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(node, component, n, shingle): each set's rarest shingles, so many that two similar sets share one.

    Any order of the shingles that is the same for all sets keeps that true; here by the count of the cell.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, components, n, first = [], [], [], []
            for node, component, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = at.values.to_numpy(zero_copy_only=False)
                length = len(hashes) - -(-percent * len(hashes) // 100) + 1
                first.append(hashes[np.lexsort((hashes, shared.value[hashes & (CELLS - 1)]))[:length]])
                nodes.append(node)
                components.append(component)
                n.append(len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(components, pa.int64()), pa.array(n, pa.int64()), _lists(first)],
                                             names=["node", "component", "n", "first"])

    return sets.select("node", "component", "shingles").mapInArrow(run, "node long, component long, n long, first array<long>").select(
        "node", "component", "n", F.explode("first").alias("shingle"))


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        row, place = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.searchsorted(both, flat)
        held = (place < len(both)) & (both[np.minimum(place, len(both) - 1)] == flat)
        return row[held], place[held]

    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(both):
        return out
    (r, c), (s, d) = cells(left), cells(right)
    for at in range(0, len(both), columns):
        x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        now = (c >= at) & (c < at + columns)
        x[r[now], c[now] - at] = 1
        now = (d >= at) & (d < at + columns)
        y[s[now], d[now] - at] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def linked_blocks(posted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of large postings (shingle, node, component, m), without pair rows.

    Only members of different components need to meet. A posting's largest component and the rest of it are dealt by
    a hash of the node into blocks of about SMALL members; a block of the largest meets the blocks of the rest, and
    these each other, never the largest itself. Each two blocks are one group, which tests all their pairs of
    different components and returns those that are similar and join something new.
    """
    parts = posted.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("main")).select("shingle", F.col("main.c").alias("c"), F.col("main.component").alias("main"))
    inside = F.col("component") == F.col("main")
    large, rest = F.ceil(F.col("c") / SMALL).cast("int"), F.ceil((F.col("m") - F.col("c")) / SMALL).cast("int")
    hashed = F.xxhash64("node", "shingle")
    own = F.when(inside, F.pmod(hashed, large)).otherwise(large + F.pmod(hashed, rest)).cast("int")
    placed = posted.join(main, "shingle").withColumn("own", own)
    meets = placed.select("shingle", "node", "component", "own", F.explode(F.sequence(F.when(inside, large).otherwise(F.lit(0)), large + rest - 1)).alias("other"))
    meets = meets.select("shingle", "node", "component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")

    def run(frame):
        import pandas as pd

        nodes, components = frame["node"].to_numpy(), frame["component"].to_numpy()
        shingles = [np.asarray(x, np.int64) for x in frame["shingles"]]
        left = np.flatnonzero(frame["own"].to_numpy() == frame["lo"].iat[0])
        right = np.flatnonzero(frame["own"].to_numpy() == frame["hi"].iat[0])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        common = _common([shingles[i] for i in left], [shingles[i] for i in right])
        n = np.array([len(x) for x in shingles])
        alike = (100 * common >= percent * (n[left][:, None] + n[right][None] - common)) & (components[left][:, None] != components[right][None])
        root = {c: c for c in components.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(*np.nonzero(alike), strict=True):
            x, y = find(int(components[left[i]])), find(int(components[right[j]]))
            if x != y:
                root[x] = y
                out.append((int(nodes[left[i]]), int(nodes[right[j]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return meets.join(sets.select("node", "shingles"), "node").groupBy("shingle", "lo", "hi").applyInPandas(run, "a long, b long")


def settled(members: DataFrame, labels: DataFrame | None, sets: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """All links (a, b) between different components that the star rounds left untested in ``members``, up to chains.

    A bucket of two members was tested whole by the first round, if there was one. A similar pair shares one of the shingles that
    ``prefixes`` takes, so no pair of a bucket is missed. Short postings list their pairs, long ones meet in blocks.
    """
    spark = members.sparkSession
    seats = members if tried is None else members.where("size > 2")
    seats = seats.join(labels, "node", "left") if labels is not None else seats.withColumn("component", F.lit(None).cast("long"))
    seats = seats.withColumn("component", F.coalesce("component", "node"))
    mixed = seats.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
    left, left_path = write_table(seats.join(mixed, ["band", "key"], "left_semi").select("node", "component").distinct(), "unsettled")
    held, held_path = write_table(sets.join(left, "node"), "unsettled-sets")
    posted, posted_path = write_table(prefixes(held, shingle_counts(held), percent), "prefixes")
    size = posted.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    posted = posted.join(size.where("lo < hi").select("shingle", "m"), "shingle")
    few = posted.where(F.col("m") <= SMALL)
    a = few.select("shingle", F.col("node").alias("lo"), F.col("component").alias("ca"), F.col("n").alias("na"))
    b = few.select("shingle", F.col("node").alias("hi"), F.col("component").alias("cb"), F.col("n").alias("nb"))
    pairs = a.join(b, "shingle").where("lo < hi and ca <> cb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = pairs.select("lo", "hi").distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["lo", "hi"], "left_anti")
    pairs, pairs_path = write_table(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")), "prefix-pairs")
    found = confirmed(pairs, held, percent).unionByName(linked_blocks(posted.where(F.col("m") > SMALL), held, percent))
    found, _ = write_table(found, "prefix-links")
    for path in (left_path, held_path, posted_path, pairs_path):
        drop_table(spark, path)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85,
                    bands: int = 24, rows: int = 5, max_rounds: int = 5) -> DataFrame:
    """Near-duplicate components of ``docs``.

    Words are runs without blanks (space, \\t to \\r), A-Z lowered. A document's set holds its distinct shingles of
    ``width`` words; with fewer words the whole sequence is the one shingle; without words, or with a null text,
    the set is empty and linked with nothing. Documents are linked when 100 * intersection >= percent * union.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable, itself
    included) and kept (doc_id = component_id). Equal sets form one class and are linked without listing pairs.
    Rows that repeat an id are one document. A row without id belongs to no component (null) and is kept. Other
    columns are not read. An empty table gives an empty result.

    A pair at similarity s shares a bucket with probability 1 - (1 - s**rows)**bands, 0.9999992 at 0.85 with the
    defaults. Every pair that shares a bucket is tested or joined by a chain of confirmed links: at most
    ``max_rounds`` star rounds link what stars reach, and ``settled`` tests what they leave.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    signed, _ = write_table(signatures(plain, width, bands, rows), "signatures")
    real = signed.where("doc_id is not null and n > 0")
    classes, _ = write_table(real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node")), "classes")

    # buckets of class representatives that hold at least two of them
    leads = real.select(F.col("doc_id").alias("node"), "n", "f1", "f2", "keys").join(classes, ["node", "n", "f1", "f2"], "left_semi")
    rungs = leads.select("node", "n", F.posexplode("keys").alias("band", "key")).distinct()
    shared = rungs.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members, members_path = write_table(rungs.join(shared, ["band", "key"]), "bucket-members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    nodes = members.select("node").distinct()
    wanted = plain.join(nodes.hint("shuffle_hash"), plain.doc_id == nodes.node, "left_semi")
    sets = shingle_sets(wanted, width)
    sets = sets.join(classes.select("node", "f1", "f2"), ["node", "f1", "f2"], "left_semi")
    sets, sets_path = write_table(sets.select("node", "shingles"), "shingle-sets")

    links = tried = labels = None
    most = 0
    for turn in range(max_rounds):
        seats = members.join(weight, "node") if turn == 0 else members
        score = F.col("weight") if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
        if labels is not None:
            seats = seats.join(labels, "node", "left")
            seats = seats.withColumn("component", F.coalesce("component", "node"))
        else:
            seats = seats.withColumn("component", F.col("node"))
        seats = seats.withColumn("score", score)
        centres = seats.groupBy("band", "key").agg(F.max(F.struct("score", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))).alias("c"))
        if labels is not None:  # only buckets that still hold more than one component
            mixed = seats.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
            seats = seats.join(mixed, ["band", "key"], "left_semi")
        star = seats.join(centres.select("band", "key", "c.a", "c.na", "c.ca"), ["band", "key"]).where(
            (F.col("component") != F.col("ca")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")))
        # a pair may come from either of its ends
        pairs = star.select(F.col("a"), F.col("node").alias("b"), F.least("a", "node").alias("lo"), F.greatest("a", "node").alias("hi"))
        pairs = pairs.groupBy("lo", "hi").agg(F.max(F.struct("a", "b")).alias("p")).select("lo", "hi", "p.a", "p.b")
        if tried is not None:
            pairs = pairs.join(tried, ["lo", "hi"], "left_anti")
        pairs, _ = write_table(pairs, "star-pairs")
        found, _ = write_table(confirmed(pairs.select("a", "b"), sets, percent), "star-links")
        tried = pairs.select("lo", "hi") if tried is None else tried.unionByName(pairs.select("lo", "hi"))
        n_found = found.count()
        if not n_found:
            break
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
        most = max(most, n_found)
        if 10 * n_found < most:  # the rest is cheaper to settle than by further rounds
            break
    more = settled(members, labels, sets, tried, percent)
    if more.take(1):
        labels = connected_components(more if links is None else links.unionByName(more))
    drop_table(docs.sparkSession, sets_path)
    drop_table(docs.sparkSession, members_path)

    if labels is not None:
        classes = classes.join(labels, "node", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    classes = classes.select("n", "f1", "f2", F.coalesce("component", "node").alias("component"))
    rowed = signed.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rowed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).select(
        "*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
