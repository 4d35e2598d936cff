"""References to records that do not exist.

Parent keys and child references are brought into one long form (referred table, scope, key, position) with a tag,
grouped with partial aggregation, and groups without a parent's tag are kept; what the key's other groups say tells
whether it was deleted, comes later or is missing. Only then are the records looked up again, by a join in which keys
with many references are salted: how many each has is known from its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.skew import ROWS, hot_keys, lookup_join, salted_join, sized
from tidemark.session import materialize


def snapshot_orphans(child: DataFrame, parent: DataFrame, rows: int = ROWS) -> DataFrame:
    """child (scope, record_id, ref_id, at) refers to parent (scope, key, at), given as full snapshots per scope.

    Returns the child rows, distinct, whose ref_id the last snapshot of the parent at or before `at` lacks, with
    ref_status: deleted (an earlier snapshot has it), later (a later one has it), missing. Where there is no snapshot
    at or before `at`, nothing exists yet. Null ref_id refers to nothing; null scope, key or time are no record.
    """
    c = child.select("scope", "record_id", "ref_id", "at").dropna(subset=["scope", "ref_id", "at"]).distinct()
    p = parent.select("scope", "key", "at").dropna()
    times = p.select("scope", "at", F.lit(1).alias("_p")).distinct().unionByName(child.select("scope", "at").dropna().distinct().withColumn("_p", F.lit(0)))
    w = W.partitionBy("scope").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    times = sized(times.groupBy("scope", "at").agg(F.max("_p").alias("_p")).withColumn("ord", F.sum("_p").over(w)).select("scope", "at", "ord"))
    c = materialize(lookup_join(c, times, ["scope", "at"], ["record_id", "ref_id"], rows))
    p = lookup_join(p, times, ["scope", "at"], ["key"], rows)
    tagged = c.select("scope", F.col("ref_id").alias("key"), "ord", F.lit(0).alias("_p"), F.lit(1).alias("_c")).unionByName(p.select("scope", "key", "ord", F.lit(1).alias("_p"), F.lit(0).alias("_c")))
    groups = tagged.groupBy("scope", "key", "ord").agg(F.max("_p").alias("_p"), F.sum("_c").alias("_c"))
    # a key has at most one group for each snapshot of its scope
    wk = W.partitionBy("scope", "key").orderBy("ord")
    had = F.max("_p").over(wk.rowsBetween(W.unboundedPreceding, W.currentRow))
    has = F.max("_p").over(W.partitionBy("scope", "key"))
    status = F.when(had == 1, "deleted").when(has == 1, "later").otherwise("missing")
    bad = materialize(groups.select("*", status.alias("ref_status")).filter("_p = 0 and _c > 0").select("scope", F.col("key").alias("ref_id"), "ord", "ref_status", "_c"))
    on = ["scope", "ref_id", "ord"]
    return salted_join(c, bad.drop("_c"), on, ["record_id", "at"], rows=rows, hot=hot_keys(bad, on, rows, "_c")).select("scope", "record_id", "ref_id", "at", "ref_status")


def event_orphans(child: DataFrame, events: DataFrame, rows: int = ROWS) -> DataFrame:
    """child (scope, record_id, ref_id, xid, lsn, at) refers to keys that events (scope, key, kind create | drop, xid,
    lsn) bring and take away.

    Returns the child rows, distinct, with ref_status: missing (the scope never creates the key), later (its first
    create comes after the row), deleted (its first drop comes before it). Rows with a null scope or ref_id refer to
    nothing; a position of null sorts before all others.
    """
    c = child.select("scope", "record_id", "ref_id", "xid", "lsn", "at").dropna(subset=["scope", "ref_id"]).distinct()
    pos = F.struct("xid", "lsn")
    tagged = c.select("scope", F.col("ref_id").alias("key"), F.lit(1).alias("_c"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("xid"), F.lit(None).cast("long").alias("lsn")).unionByName(
        events.select("scope", "key", F.lit(0).alias("_c"), "kind", "xid", "lsn").dropna(subset=["scope", "key"])
    )
    groups = tagged.groupBy("scope", "key").agg(F.sum("_c").alias("_c"), F.min(F.when(F.col("kind") == "create", pos)).alias("_made"), F.min(F.when(F.col("kind") == "drop", pos)).alias("_gone"))
    bad = materialize(groups.filter("_c > 0").select("scope", F.col("key").alias("ref_id"), "_made", "_gone", "_c"))
    on = ["scope", "ref_id"]
    got = salted_join(c, bad.drop("_c"), on, ["record_id"], rows=rows, hot=hot_keys(bad, on, rows, "_c"))
    status = F.when(F.col("_made").isNull(), "missing").when(F.col("_made") > pos, "later").when(F.col("_gone") < pos, "deleted")
    return got.select("scope", "record_id", "ref_id", "at", status.alias("ref_status")).filter("ref_status is not null")
