"""Changes between full snapshots, from validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.skew import ROWS, lookup_join, sized


def as_set(c: str) -> Column:
    """An array as a set: order and repeats do not count, null is empty."""
    return F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.expr("array()").cast("array<string>"))))


def squeeze(c: str) -> Column:
    """Each run of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " "))


def snapshots(df: DataFrame, scope: str, time: str) -> DataFrame:
    """The snapshots of each scope in order: scope, time, _ord from 1, _last (the number of them)."""
    w = W.partitionBy(scope).orderBy(time)
    d = df.select(scope, time).dropna().distinct()
    return d.select(scope, time, F.row_number().over(w).alias("_ord"), F.count(F.lit(1)).over(W.partitionBy(scope)).alias("_last"))


def intervals(df: DataFrame, scope: str, key: str, time: str, ingested: str, state: Sequence[Column], ords: tuple[DataFrame, bool], rows: int = ROWS) -> DataFrame:
    """Validity intervals (scope, key, _hash, _from, _to, _last) in numbers of snapshots: as long as a key stays in
    consecutive snapshots with equal state. Of several deliveries of a key in one snapshot the last one ingested
    counts; of deliveries at the same time, the greater hash. Rows without scope, key or time are no records.
    ords: the snapshots, sized. A snapshot that holds most of the rows is salted where these are too many to be sent."""
    doc = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(state)]), {"ignoreNullFields": "false"})
    last = (
        df.select(F.col(scope).alias("_s"), F.col(time).alias("_t"), F.col(key).alias("_k"), F.struct(F.col(ingested).alias("at"), F.md5(doc).alias("h")).alias("_d"))
        .dropna(subset=["_s", "_t", "_k"])
        .groupBy("_s", "_t", "_k")
        .agg(F.max("_d").alias("_d"))
    )
    got = lookup_join(last, ords, ["_s", "_t"], ["_k"], rows).select("_s", "_k", "_ord", "_last", F.col("_d.h").alias("_hash"))
    w = W.partitionBy("_s", "_k").orderBy("_ord")
    new = F.coalesce((F.lag("_ord").over(w) != F.col("_ord") - 1) | (F.lag("_hash").over(w) != F.col("_hash")), F.lit(True))
    island = got.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("_s", "_k", "_island").agg(F.min("_ord").alias("_from"), F.max("_ord").alias("_to"), F.first("_last").alias("_last"), F.first("_hash").alias("_hash"))


def snapshot_changes(df: DataFrame, scope: str, key: str, time: str, ingested: str, state: Sequence[Column], rows: int = ROWS) -> DataFrame:
    """(scope, key, time, change_kind): an interval that starts after the first snapshot is an addition or, if another
    one ends just before, a change; one that ends before the last snapshot and is not followed is a removal.

    A row in a snapshot with a null key is ignored, but the snapshot itself counts. No snapshots: no rows."""
    ords = sized(snapshots(df, scope, time).select(F.col(scope).alias("_s"), F.col(time).alias("_t"), "_ord", "_last"))
    iv = intervals(df, scope, key, time, ingested, state, ords, rows)
    w = W.partitionBy("_s", "_k").orderBy("_from")
    iv = iv.select("*", F.lag("_to").over(w).alias("_before"), F.lead("_from").over(w).alias("_after"))
    starts = F.when(F.col("_from") > 1, F.struct(F.col("_from").alias("o"), F.when(F.coalesce(F.col("_before") == F.col("_from") - 1, F.lit(False)), "changed").otherwise("added").alias("kind")))
    ends = F.when((F.col("_to") < F.col("_last")) & F.coalesce(F.col("_after") != F.col("_to") + 1, F.lit(True)), F.struct((F.col("_to") + 1).alias("o"), F.lit("removed").alias("kind")))
    ev = iv.select("_s", "_k", F.explode(F.array_compact(F.array(starts, ends))).alias("e")).select("_s", "_k", F.col("e.o").alias("_ord"), F.col("e.kind").alias("change_kind"))
    return lookup_join(ev, (ords[0].drop("_last"), ords[1]), ["_s", "_ord"], ["_k"], rows).select(F.col("_s").alias(scope), F.col("_k").alias(key), F.col("_t").alias(time), "change_kind")
