"""Change data to states of a table.

A change log has: op (I insert, U update, D delete, T truncate), xid, lsn, the key and the value columns, and
optionally _undef (array of names of columns that an update left as they were, other than set to null).
Positions are (xid, lsn). States are folded by aggregation with partial aggregates in the map tasks, so that a key
with a third of all changes is no bottleneck, and a truncation is one number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POS = ("xid", "lsn")


def pos() -> Column:
    return F.struct(*POS)


def committed(changes: DataFrame, transactions: DataFrame) -> DataFrame:
    """Changes (pg_xid, lsn, ...) of committed transactions (pg_xid, top_xid, status, commit_xid), with xid: the commit
    order's number. Sub-transactions come with the top transaction they belong to (top_xid; null for a top one); each
    may be aborted alone, and with its top. Changes of unknown or open transactions are left out."""
    top = transactions.filter("top_xid is null and status = 'commit'").select(F.col("pg_xid").alias("top_xid"), F.col("commit_xid").alias("xid"))
    part = transactions.filter("coalesce(status, '') <> 'abort'").select("pg_xid", F.coalesce("top_xid", "pg_xid").alias("top_xid"))
    return changes.join(part.join(top, "top_xid").select("pg_xid", "xid"), "pg_xid")


def after_truncate(changes: DataFrame) -> DataFrame:
    """The changes behind the last truncation, whose position is a scalar subquery of the plan."""
    last = changes.filter("op = 'T'").agg(F.max(pos()).alias("t")).scalar()
    return changes.filter(last.isNull() | (pos() > last))


def split_key_updates(changes: DataFrame, keys: Sequence[str], old: str = "_old") -> DataFrame:
    """An update with an old key (struct in column `old`) is a delete of the old row and an insert of the new one."""
    moved = (F.col("op") == "U") & F.col(old).isNotNull()
    gone = F.struct(F.lit("D").alias("op"), *[F.col(f"{old}.{k}").alias(k) for k in keys])
    came = F.struct(F.when(moved, "I").otherwise(F.col("op")).alias("op"), *keys)
    e = changes.withColumn("_e", F.explode(F.when(moved, F.array(gone, came)).otherwise(F.array(came))))
    rest = [c for c in changes.columns if c not in ("op", *keys, old)]
    # the delete comes first within one position
    return e.select(F.col("_e.op").alias("op"), *[F.col(f"_e.{k}").alias(k) for k in keys], *rest)


def fold(changes: DataFrame, keys: Sequence[str], values: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The rows (keys, values) after all changes, or those with xid up to as_of.

    Of each key the last change decides; deleted keys are gone. A column that an update left undefined has its last
    defined value since the key was last deleted; null where there is none. Changes at the same position: a delete
    comes before the others. Rows with a null position are no changes; null keys are keys like others.
    """
    c = changes if as_of is None else changes.filter(F.col("xid") <= as_of)
    c = after_truncate(c.dropna(subset=list(POS))).filter("op <> 'T'")
    at = F.struct(*POS, (F.col("op") != "D").cast("int").alias("o"))
    undef = F.col("_undef") if "_undef" in c.columns else F.lit(None).cast("array<string>")
    live = F.col("op") != "D"
    got = c.groupBy(*keys).agg(
        F.max(at).alias("_last"),
        F.max(F.when(~live, at)).alias("_gone"),
        *[F.max_by(F.struct(at.alias("at"), F.col(v).alias("v")), F.when(live & ~F.coalesce(F.array_contains(undef, v), F.lit(False)), at)).alias(f"_v_{v}") for v in values],
    )
    alive = got.filter("_last.o = 1")
    return alive.select(*keys, *[F.when(F.col("_gone").isNull() | (F.col(f"_v_{v}.at") > F.col("_gone")), F.col(f"_v_{v}.v")).alias(v) for v in values])


def fold_no_key(changes: DataFrame, columns: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The rows of a table without a key: a delete takes away one row that equals it in all columns."""
    c = changes if as_of is None else changes.filter(F.col("xid") <= as_of)
    c = after_truncate(c).filter("op in ('I', 'D')")
    n = F.sum(F.when(F.col("op") == "I", 1).otherwise(-1))
    got = c.groupBy(*columns).agg(n.alias("_n")).filter("_n > 0")
    return got.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")


def as_inserts(base: DataFrame, xid: int) -> DataFrame:
    """A base table as inserts at a transaction, to be folded with what came later."""
    return base.select(F.lit("I").alias("op"), F.lit(xid).cast("long").alias("xid"), F.lit(0).cast("long").alias("lsn"), *base.columns)


def merge_pending(base: DataFrame, base_xid: int, pending: DataFrame, keys: Sequence[str], as_of: int | None = None) -> DataFrame:
    """A snapshot with pending changes on top; changes up to base_xid are in the base already. Only the base's rows with a
    key that was touched are folded; the others pass by. The touched keys are sent to the base's scan where the planner
    knows their log to be small (spark.sql.autoBroadcastJoinThreshold), so that the base is not shuffled."""
    values = [c for c in base.columns if c not in keys]
    later = pending.filter(F.col("xid") > base_xid)
    later = later if as_of is None else later.filter(F.col("xid") <= as_of)
    touched = later.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    emptied = later.filter("op = 'T'").agg(F.count(F.lit(1)).alias("n")).scalar()
    rest = base.join(touched, same, "left_anti").filter(emptied == 0)
    changed = fold(as_inserts(base.join(touched, same, "left_semi"), base_xid).unionByName(later, allowMissingColumns=True), keys, values)
    return rest.select(*keys, *values).unionByName(changed)


def after_copy(changes: DataFrame, xmin: int, xmax: int, running: Sequence[int]) -> DataFrame:
    """The changes that a copy taken at the snapshot (xmin, xmax, running) does not hold: transactions from xmax on,
    and those that ran then."""
    seen = (F.col("pg_xid") < xmin) | ((F.col("pg_xid") < xmax) & ~F.col("pg_xid").isin([int(x) for x in running]))
    return changes.filter(~seen)


def compact(changes: DataFrame, keys: Sequence[str], values: Sequence[str], cutoff: int) -> DataFrame:
    """The change log with all versions up to cutoff folded into inserts at cutoff; reads at or after cutoff stay as
    they were."""
    base = as_inserts(fold(changes, keys, values, cutoff), cutoff)
    return base.unionByName(changes.filter(F.col("xid") > cutoff), allowMissingColumns=True)


def latest_only(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of each key, deletes among them (an index of what changed)."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct("op", *POS), pos()).alias("_b")).select(*keys, "_b.*")
