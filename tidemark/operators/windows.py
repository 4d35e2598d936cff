"""Window frames that Spark SQL lacks: GROUPS, and EXCLUDE."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_JOIN: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}


def groups_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column], lo: int, hi: int, out: dict[str, Column]) -> DataFrame:
    """Adds aggregates over GROUPS BETWEEN lo AND hi: peer groups are numbered, and the numbers framed by RANGE. One
    shuffle and one sort, as the second window has the partitioning of the first. lo, hi: as for rowsBetween."""
    g = df.withColumn("_g", F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    w = W.partitionBy(*partition).orderBy("_g").rangeBetween(lo, hi)
    return g.select("*", *[c.over(w).alias(n) for n, c in out.items()]).drop("_g")


def exclude_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column], lo: int, hi: int, what: str, agg: str, value: str, name: str) -> DataFrame:
    """Adds one of sum, count, min, max over a frame without some of its rows: `current row` of ROWS BETWEEN lo AND hi,
    `group` or `ties` of GROUPS BETWEEN lo AND hi. The frame is split around what is left out and the parts are joined.
    lo must not be above 0, hi not below."""
    f, both = getattr(F, agg), _JOIN[agg]
    if what == "current row":
        w = W.partitionBy(*partition).orderBy(*order)
        a = f(value).over(w.rowsBetween(lo, -1)) if lo < 0 else F.lit(None)
        b = f(value).over(w.rowsBetween(1, hi)) if hi > 0 else F.lit(None)
        return df.withColumn(name, both(a, b))
    g = df.withColumn("_g", F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    w = W.partitionBy(*partition).orderBy("_g")
    a = f(value).over(w.rangeBetween(lo, -1)) if lo < 0 else F.lit(None)
    b = f(value).over(w.rangeBetween(1, hi)) if hi > 0 else F.lit(None)
    got = both(a, b)
    if what == "ties":
        own = F.when(F.col(value).isNotNull(), F.lit(1)).otherwise(0) if agg == "count" else F.col(value)
        got = both(got, own)
    return g.withColumn(name, got).drop("_g")


def range_agg(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): the union of the half-open ranges [lo, hi) of each key as ranges that neither overlap nor touch.
    Empty ranges (lo >= hi) and ranges with a null key or bound are left out."""
    r = df.select(*keys, lo, hi).dropna().filter(F.col(lo) < F.col(hi)).groupBy(*keys, lo).agg(F.max(hi).alias(hi))
    w = W.partitionBy(*keys).orderBy(lo)
    so_far = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_new", F.coalesce((F.col(lo) > so_far).cast("int"), F.lit(1)))
    r = r.withColumn("_n", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_n").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_n")


def hypothetical_rank(df: DataFrame, keys: Sequence[str], value: str, given: object) -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist that `given` would have among the values of each key."""
    below, n = F.count_if(F.col(value) < F.lit(given)), F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (below + 1).alias("rank"),
        (F.count_distinct(F.when(F.col(value) < F.lit(given), F.col(value))) + 1).alias("dense_rank"),
        (below / n).alias("percent_rank"),
        ((F.count_if(F.col(value) <= F.lit(given)) + 1) / (n + 1)).alias("cume_dist"),
    )
