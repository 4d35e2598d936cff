"""Attributes as known at event time: an as-of join in two times.

Of each key's versions, those are valid for an event whose position is not above the event's `at` and that were known
by the event's `known`; the last of them by order is taken. Hot keys are cut into shards by position. Each shard gets
the last version before it as carry-in, so that shards are merged independently; an event for which the carry-in was
not known yet is also sent to the last earlier shard that holds a version known by then, where its answer must lie, so
nothing is lost by the cuts. Each shard is merged in one sorted pass over Arrow batches: versions hidden from an event
are skipped by links to the nearest earlier version known before them. Events are not held beyond their batch, nor are
versions that a later one hides for good.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import ROWS, shard_bounds, with_shard

STEP = 1 << 15


def _long(col: pa.ChunkedArray) -> np.ndarray:
    return col.cast(pa.int64()).to_numpy()


def _links(known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each version the nearest earlier one of its group that was known before it, or -1. Jumping over links that
    are not final is sound: all that lies between a row and its link was known no earlier than the row."""
    link = np.arange(len(known)) - 1
    link[first] = -1
    todo = np.flatnonzero(link >= 0)
    while len(todo):
        todo = todo[known[link[todo]] >= known[todo]]
        link[todo] = link[link[todo]]
        todo = todo[link[todo] >= 0]
    return link


def _merge(t: pa.Table, group: list[str]) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    change = np.zeros(n, bool)
    change[:1] = True
    for g in group:
        c = t.column(g).combine_chunks()
        change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    gid = np.cumsum(change)
    event = t.column("_event").to_numpy()
    known = _long(t.column("_known"))
    v, e = np.flatnonzero(event == 0), np.flatnonzero(event == 1)
    if not len(e):
        return
    at = np.searchsorted(v, e) - 1
    if len(v):
        at[(at >= 0) & (gid[v[at]] != gid[e])] = -1
        hidden = np.flatnonzero((at >= 0) & (known[v[at]] > known[e]))
        if len(hidden):
            vg = gid[v]
            link = _links(known[v], np.flatnonzero(np.r_[True, vg[1:] != vg[:-1]]))
            while len(hidden):
                at[hidden] = link[at[hidden]]
                hidden = hidden[at[hidden] >= 0]
                hidden = hidden[known[v[at[hidden]]] > known[e[hidden]]]
    hit = at >= 0
    picked = t.column("_right").take(pa.array(np.where(hit, v[at] if len(v) else 0, 0), mask=~hit))
    res = pa.table({"_left": t.column("_left").take(pa.array(e)), "_right": picked})
    yield from res.to_batches(max_chunksize=20_000)


def _carried(t: pa.Table, group: list[str]) -> pa.Table:
    """What of t may still answer events of its last group: versions that no later one, known as early, hides."""
    same = None
    for g in group:
        eq = pc.equal(t.column(g), t.column(g)[t.num_rows - 1])
        same = eq if same is None else pc.and_(same, eq)
    mine = t.slice(pc.index(same, pa.scalar(True)).as_py())
    mine = mine.filter(pc.equal(mine.column("_event"), 0))
    known = _long(mine.column("_known"))
    later = np.minimum.accumulate(known[::-1])[::-1]
    return mine.filter(pa.array(known < np.append(later[1:], np.iinfo(np.int64).max)))


def _merger(group: list[str]):
    """Merges sorted batches as they come: events leave at once, versions stay while they may be needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = carried = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= max(STEP, carried):  # so that what is carried is read again a bounded number of times for each row
                t = pa.Table.from_batches(held)
                yield from _merge(t, group)
                keep = _carried(t, group)
                held, carried, n = keep.to_batches(), keep.num_rows, 0
        if held:
            yield from _merge(pa.Table.from_batches(held), group)

    return run


def asof_candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], id_cols: Sequence[str], at: str, known: str, order: Sequence[str], right_known: str, take: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Rows of (id_cols of left, match struct of order, right_known and take, or null), at most two for each row of
    left, of which the greater match counts.

    at, order[0]: whole numbers. known, right_known: timestamps or whole numbers. Rows with a null key, position or
    time can match nothing; they are left out. Ties in (order, right_known) are the same version.
    """
    lf = left.select(*keys, F.col(at).cast("long").alias("_pos"), F.col(known).alias("_known"), F.struct(*id_cols).alias("_left")).dropna(subset=[*keys, "_pos", "_known"])
    rt = right.select(*keys, F.col(order[0]).cast("long").alias("_pos"), F.col(right_known).alias("_known"), F.struct(*order, right_known, *[c for c in take if c not in order and c != right_known]).alias("_right")).dropna(subset=[*keys, "_pos", "_known"])
    bounds = shard_bounds(rt.select(*keys, "_pos").unionByName(lf.select(*keys, "_pos")), keys, "_pos", rows)
    rs, ls = with_shard(rt, keys, "_pos", bounds), with_shard(lf, keys, "_pos", bounds)
    if bounds is not None:
        grid = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_shard"))
        sums = (
            rs.join(F.broadcast(bounds.select(*keys)), list(keys), "left_semi")
            .groupBy(*keys, "_shard")
            .agg(F.max("_right").alias("_last"), F.min("_known").alias("_first_known"))
        )
        w = W.partitionBy(*keys).orderBy("_shard")
        grid = grid.join(sums, [*keys, "_shard"], "left").withColumn("_carry", F.last("_last", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
        carry = grid.filter("_carry is not null").select(*keys, F.col(f"_carry.{order[0]}").cast("long").alias("_pos"), F.col(f"_carry.{right_known}").alias("_known"), F.col("_carry").alias("_right"), "_shard")
        # for each shard what its carry-in was known at, and when the first version of each earlier shard was known
        plan = grid.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_shard", F.col(f"_carry.{right_known}").alias("ck"), F.col("_first_known").alias("fk")))).alias("_plan"))
        back = (
            ls.join(F.broadcast(plan), list(keys))
            .filter("_plan[_shard].ck > _known")
            .withColumn("_shard", F.expr("aggregate(slice(_plan, 1, _shard), -1, (s, x) -> if(x.fk <= _known, x._shard, s))"))
            .filter("_shard >= 0")
            .drop("_plan")
        )
        rs, ls = rs.unionByName(carry), ls.unionByName(back)
    lt, rtt = ls.schema["_left"].dataType, rs.schema["_right"].dataType
    # beyond order and time, plain values decide, so that ties come out alike each time
    plain = [f.name for f in rs.schema["_right"].dataType.fields if f.name not in order and f.name != right_known and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    order2 = [F.col("_right")[c] for c in order[1:]]
    both = rs.select(*keys, "_shard", "_pos", F.lit(0).alias("_event"), "_known", F.lit(None).cast(lt).alias("_left"), "_right").unionByName(
        ls.select(*keys, "_shard", "_pos", F.lit(1).alias("_event"), "_known", "_left", F.lit(None).cast(rtt).alias("_right"))
    )
    group = [*keys, "_shard"]
    both = both.repartition(*group).sortWithinPartitions(*group, "_pos", "_event", *order2, "_known", *[F.col("_right")[c] for c in plain])
    schema = T.StructType([T.StructField("_left", lt), T.StructField("_right", rtt)])
    got = both.mapInArrow(_merger(group), schema)
    return got.select("_left.*", F.col("_right").alias("match"))


def asof_known(left: DataFrame, right: DataFrame, keys: Sequence[str], id_cols: Sequence[str], at: str, known: str, order: Sequence[str], right_known: str, take: Sequence[str], rows: int = ROWS) -> DataFrame:
    """One row for each distinct id of left with its match struct, null where no version was valid and known."""
    got = asof_candidates(left, right, keys, id_cols, at, known, order, right_known, take, rows)
    none = left.select(*id_cols, F.lit(None).cast(got.schema["match"].dataType).alias("match"))
    return got.unionByName(none).groupBy(*id_cols).agg(F.max("match").alias("match"))
