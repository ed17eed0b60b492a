"""Joins in event order: the version of an entry that holds at a probe's own time, and replay of expiring entries.

Times are cut into buckets. Inside a bucket of a key the rows are walked in order; what a bucket inherits is the last
version of any earlier one, which a table of one row per key and bucket tells. So a key with a third of all rows is
many small groups, and only its bucket summaries stand in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import scratch_path

BUCKET_SECONDS = 3600
#: Events of a key that one task may walk in order, a batch at a time; keys with more are replayed by pointers.
WALKED_ROWS = 1_000_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def asof_join(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, seq: str, payload: list[str],
              bucket_seconds: int = BUCKET_SECONDS, prefix: str = "v_") -> DataFrame:
    """Every probe with the latest version of its key at its time: (at, seq) of the version not above the probe's.

    ``at`` (a timestamp, or a long of microseconds) and the long ``seq`` order rows; a version and a probe of one (at,
    seq) are the version first. Adds the version's ``at``, ``seq`` and ``payload`` under ``prefix``, null where there is
    none yet. Probes with a null key or time find nothing. Of versions of one (at, seq) the largest payload holds.
    """
    def micros(df: DataFrame) -> Column:
        return F.unix_micros(at) if df.schema[at].dataType.typeName() == "timestamp" else F.col(at).cast("long")

    def bucket(t: Column) -> Column:
        return F.floor(t / F.lit(bucket_seconds * 1_000_000)).cast("long")

    spot = F.struct(F.col("_t"), F.col("_seq"))
    held = versions.select(*keys, micros(versions).alias("_t"), F.col(seq).cast("long").alias("_seq"), F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), *[F.col(c) for c in payload]).alias("_v"))
    held = held.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) + " AND _t IS NOT NULL").withColumn("_bucket", bucket(F.col("_t")))
    asked = probes.withColumn("_t", micros(probes)).withColumn("_seq", F.col(seq).cast("long")).withColumn("_bucket", bucket(F.col("_t")))
    # what a bucket inherits: one row per key and bucket
    last = held.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.struct(spot, "_v")).alias("_last"))
    seen = last.unionByName(asked.select(*keys, "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    seen = seen.groupBy(*keys, "_bucket").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried IS NOT NULL")
    # inside the bucket: versions before probes of the same spot
    extra = [c for c in probes.columns if c not in keys]
    both = asked.select(*keys, "_bucket", "_t", "_seq", F.lit(True).alias("_probe"), F.struct(*extra).alias("_row"), F.lit(None).cast(held.schema["_v"].dataType).alias("_v"))
    both = both.unionByName(held.select(*keys, "_bucket", "_t", "_seq", F.lit(False).alias("_probe"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_v"))
    order = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_seq", "_probe", "_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_here", F.last("_v", ignorenulls=True).over(order)).where("_probe").select(*keys, "_bucket", "_row", "_here")
    out = inside.join(carried, [*keys, "_bucket"], "left").withColumn("_found", F.coalesce("_here", "_carried"))
    known = F.col("_found")
    if keys:
        known = F.when(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), known)
    out = out.withColumn("_found", known)
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in probes.columns], F.col("_found.at").alias(prefix + at), F.col("_found.seq").alias(prefix + seq),
                      *[F.col(f"_found.{c}").alias(prefix + c) for c in payload])


def asof_lookup(reads: DataFrame, writes: DataFrame, keys: list[str], at: str, seq: str, payload: list[str], ttl_seconds: int | None,
                bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every read with the entry that its key holds at the read's own time, and an outcome: hit, expired (the last write is
    ``ttl_seconds`` old or older) or miss (nothing written yet). Reads never extend an entry."""
    found = asof_join(reads, writes, keys, at, seq, payload, bucket_seconds)
    age = F.unix_micros(at) - F.unix_micros(f"v_{at}")
    live = F.lit(True) if not ttl_seconds else age < ttl_seconds * 1_000_000
    return found.withColumn("outcome", F.when(F.col(f"v_{seq}").isNull(), "miss").when(live, "hit").otherwise("expired"))


def first_sights(events: DataFrame, keys: list[str], at: str, seq: str, ttl_seconds: int, anchors: DataFrame | None = None,
                 max_rounds: int = 64, walked_rows: int = WALKED_ROWS) -> DataFrame:
    """Those ``events`` that are first sights: the first of a key, and each first one at or after the last sight + ttl.

    ``anchors`` (keys, at) are last sights from before. ``seq`` tells events of one time apart; rows that repeat a (time,
    seq) of a key are one event. Null keys and times are no events. Keys of up to ``walked_rows`` events are dealt to tasks
    and walked in order, in one shuffle; the others (and those with events without seq, or with several anchors)
    are replayed by pointers, so that no task walks a key of any size.
    """
    simple = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType)
    if walked_rows < 1 or not all(isinstance(events.schema[k].dataType, simple) for k in keys):
        return _sights_by_pointers(events, keys, at, seq, ttl_seconds, anchors, max_rounds)
    named = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    events = events.where(f"{named} AND `{at}` IS NOT NULL")
    n, known = F.count(F.lit(1)), None
    apart = events.groupBy(*keys).agg(n.alias("n"), F.count(F.col(seq).cast("long")).alias("told")).where(f"n > {walked_rows} OR told < n").select(*keys)
    if anchors is not None:
        known = anchors.where(named).select(*[F.col(k).cast(events.schema[k].dataType) for k in keys], at)
        apart = apart.unionByName(known.groupBy(*keys).agg(n.alias("n"), F.count(at).alias("told")).where("n > 1 OR told < n").select(*keys)).distinct()
    apart = _written(apart, "sight-keys")
    if not apart.take(1):
        return _sights_by_walk(events, keys, at, seq, ttl_seconds, known)
    few, many = ((events.join(apart, keys, how).select(*events.columns), None if known is None else known.join(apart, keys, how)) for how in ("left_anti", "left_semi"))
    walked = _sights_by_walk(few[0], keys, at, seq, ttl_seconds, few[1])
    return walked.unionByName(_sights_by_pointers(many[0], keys, at, seq, ttl_seconds, many[1], max_rounds))


def _sights_by_walk(events: DataFrame, keys: list[str], at: str, seq: str, ttl_seconds: int, anchors: DataFrame | None) -> DataFrame:
    """``first_sights`` of keys whose events have a seq and that have one anchor at most: a walk over sorted rows, of which a
    task holds a batch."""
    ttl, columns, schema = ttl_seconds * 1_000_000, events.columns, events.schema
    rows = events.select(*columns, F.lit(True).alias("_event"), F.unix_micros(at).alias("_t"), F.col(seq).cast("long").alias("_s"))
    if anchors is not None:
        none = [F.col(c) if c in keys else F.lit(None).cast(schema[c].dataType).alias(c) for c in columns]
        old = anchors.withColumn("_t", F.unix_micros(at))
        rows = rows.unionByName(old.select(*none, F.lit(False).alias("_event"), "_t", F.lit(None).cast("long").alias("_s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = anchor = sight = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(k) for k in keys]
            fresh = np.zeros(batch.num_rows, bool)
            for c in held:
                fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last != [c[0].as_py() for c in held]
            last = [c[len(c) - 1].as_py() for c in held]
            keep = []
            for new, event, t, s in zip(fresh.tolist(), *[batch.column(c).to_pylist() for c in ("_event", "_t", "_s")], strict=True):
                if new:
                    anchor = sight = None
                if not event:
                    anchor = t
                elif anchor is None or t >= anchor + ttl:
                    anchor, sight = t, (t, s)
                keep.append(event and sight == (t, s))
            at_ = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at_) for c in columns], names=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_event", "_t", "_s").mapInArrow(run, schema)


def _sights_by_pointers(events: DataFrame, keys: list[str], at: str, seq: str, ttl_seconds: int, anchors: DataFrame | None, max_rounds: int) -> DataFrame:
    """``first_sights`` without a walk: every event points to the first event of its key that is a ttl or more later, and
    sights are what can be reached from the start by such steps. Each round follows pointers twice as long, so the
    rounds grow with the logarithm of the number of sights of a key."""
    ttl = ttl_seconds * 1_000_000
    key = F.struct(*keys)
    nodes = events.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, at])).select(key.alias("k"), F.unix_micros(at).alias("t"), F.col(seq).cast("long").alias("s")).distinct()
    nodes = _written(nodes, "sight-events")
    known = None if anchors is None else anchors.select(key.alias("k"), F.unix_micros(at).alias("t"), F.lit(-1 << 62).alias("s"))
    from_ = nodes if known is None else nodes.unionByName(known)
    # the first event at or after t + ttl is the last one at or before -(t + ttl) when time runs backwards
    ahead = nodes.select("k", (-F.col("t")).alias("t"), (-F.col("s")).alias("s"))
    asked = from_.select("k", (-(F.col("t") + ttl)).alias("t"), F.lit((1 << 63) - 1).alias("s"), F.col("t").alias("from_t"), F.col("s").alias("from_s"))
    step = asof_join(asked, ahead, ["k"], "t", "s", [], bucket_seconds=max(ttl_seconds, 1)).where("v_t IS NOT NULL")
    step = _written(step.select("k", F.col("from_t").alias("t"), F.col("from_s").alias("s"), (-F.col("v_t")).alias("to_t"), (-F.col("v_s")).alias("to_s")), "sight-steps")
    start = nodes.groupBy("k").agg(F.min(F.struct("t", "s")).alias("n")).select("k", "n.t", "n.s")
    if known is not None:
        start = start.join(known.select("k").distinct(), "k", "left_anti").unionByName(known)
    reached = _written(start, "sights")
    for _ in range(max_rounds):
        new = reached.join(step, ["k", "t", "s"]).select("k", F.col("to_t").alias("t"), F.col("to_s").alias("s"))
        grown = _written(reached.unionByName(new).distinct(), "sights")
        step_to = step.select("k", F.col("t").alias("to_t"), F.col("s").alias("to_s"), F.col("to_t").alias("far_t"), F.col("to_s").alias("far_s"))
        step = _written(step.join(step_to, ["k", "to_t", "to_s"]).select("k", "t", "s", F.col("far_t").alias("to_t"), F.col("far_s").alias("to_s")), "sight-steps")
        reached = grown
        if not step.take(1):
            break
    else:
        raise RuntimeError(f"sights still reached after {max_rounds} rounds")
    found = reached.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("s").alias("_s"))
    return events.join(found, (key == F.col("_k")) & (F.unix_micros(at) == F.col("_t")) & (F.col(seq).cast("long") == F.col("_s")), "left_semi")


def ttl_replay(events: DataFrame, keys: list[str], at: str, seq: str, ttl_seconds: int) -> DataFrame:
    """Every event as a read that fills on a miss: filled (``outcome``) or hit, and the fill (v_ columns) that answers it."""
    fills = first_sights(events, keys, at, seq, ttl_seconds)
    found = asof_join(events, _written(fills.select(*keys, at, seq), "fills"), keys, at, seq, [], bucket_seconds=max(ttl_seconds, 1))
    same = F.col(seq) == F.col(f"v_{seq}")
    return found.withColumn("outcome", F.when(same & (F.col(at) == F.col(f"v_{at}")), "filled").when(F.col(f"v_{seq}").isNotNull(), "hit"))
