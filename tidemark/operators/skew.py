"""Hot keys: finding them, sharding them by order, salting joins on them.

A key counts as hot if it holds more than `rows` rows. The KEYS largest hot keys are listed: a key beyond them holds
less than 1/KEYS of all rows, no more than an ordinary task of a job over so much data, and is worked on as other keys
are. All hot keys together get about TOTAL parts (and one each), so a part holds `rows` rows, or 1/TOTAL of the hot
rows if that is more. What is collected or broadcast here is thus bounded whatever the size of the data: KEYS rows of a
key and a number, TOTAL bounds. Results never depend on which keys are listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

KEYS = 1 << 16
TOTAL = 1 << 17
ROWS = 50_000
#: Rows up to which a narrow table is sent to all tasks.
SENT = 1 << 17
_STEP = 128


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = ROWS, n: str | None = None) -> DataFrame | None:
    """The hot keys with their counts (_n) and the number of parts that each is to have (_parts), at most KEYS rows, or
    None if there are none. n: a column of df that holds the count, if df has one row for each key."""
    counts = df.select(*keys, F.col(n).alias("_n")) if n else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.filter(F.col("_n") > rows)
    top = counts.orderBy(F.desc("_n")).limit(KEYS).collect()
    if not top:
        return None
    each = max(rows, sum(r["_n"] for r in top) // TOTAL)
    return df.sparkSession.createDataFrame([(*r, -(-r["_n"] // each)) for r in top], T.StructType([*counts.schema.fields, T.StructField("_parts", T.LongType())]))


def sized(df: DataFrame) -> tuple[DataFrame, bool]:
    """df as a table of its own, and whether it has at most SENT rows, so that it may be sent to all tasks."""
    df = materialize(df)
    return df, df.limit(SENT + 1).count() <= SENT


def lookup_join(big: DataFrame, small: tuple[DataFrame, bool], on: Sequence[str], salt_on: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Equi-join with a sized() table of few and narrow rows a key: it is sent to the tasks if it is small, else hot keys
    of big are salted."""
    return big.join(F.broadcast(small[0]), list(on)) if small[1] else salted_join(big, small[0], on, salt_on, rows=rows)


def shard_bounds(df: DataFrame, keys: Sequence[str], at: str, rows: int = ROWS) -> DataFrame | None:
    """For each hot key the values of `at` that part it into its shards (_bounds)."""
    hot = hot_keys(df, keys, rows)
    if hot is None:
        return None
    most = hot.agg(F.max("_parts")).first()[0]
    grid = 64
    while grid < most and grid < TOTAL // 2:
        grid *= 2
    got = (
        df.join(F.broadcast(hot), list(keys))
        .groupBy(*keys)
        .agg(F.first("_parts").alias("_parts"), F.percentile_approx(at, [i / grid for i in range(1, grid)], 16 * grid).alias("_q"))
        .withColumn("_step", F.greatest(F.lit(1), F.expr(f"cast({grid} / _parts as int)")))
        .select(*keys, F.expr("array_distinct(filter(_q, (v, i) -> (i + 1) % _step = 0))").alias("_bounds"))
        # the last bound of each _STEP, so that a bound is found in two short scans
        .withColumn("_coarse", F.expr(f"transform(filter(sequence(0, size(_bounds) div {_STEP}), k -> k > 0), k -> _bounds[k * {_STEP} - 1])"))
    )
    return df.sparkSession.createDataFrame(got.collect(), got.schema)


def with_shard(df: DataFrame, keys: Sequence[str], at: str | Column, bounds: DataFrame | None) -> DataFrame:
    """Adds _shard: the number of the key's bounds not above `at`, 0 for all other keys."""
    if bounds is None:
        return df.withColumn("_shard", F.lit(0))
    at = F.col(at) if isinstance(at, str) else at
    block = F.expr("size(filter(_coarse, b -> b <= _at))")
    fine = F.expr(f"_block * {_STEP} + size(filter(slice(_bounds, _block * {_STEP} + 1, {_STEP}), b -> b <= _at))")
    return (
        df.withColumn("_at", at)
        .join(F.broadcast(bounds), list(keys), "left")
        .withColumn("_block", block)
        .withColumn("_shard", F.when(F.col("_bounds").isNull() | F.col("_at").isNull(), F.lit(0)).otherwise(fine))
        .drop("_bounds", "_coarse", "_block", "_at")
    )


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt_on: Sequence[str], how: str = "inner", rows: int = ROWS, hot: DataFrame | None | bool = False) -> DataFrame:
    """Equi-join in which a hot key of `big` is spread over a task for each of its parts, and its rows of `small` are
    repeated for each; other keys are joined as usual. The salt is a hash of salt_on, so that a task that runs again
    deals its rows alike. hot: the hot_keys() of big, where they are known already."""
    if hot is False:
        hot = hot_keys(big, on, rows)
    if hot is None:
        return big.join(small, list(on), how)
    marks = F.broadcast(hot.select(*on, F.col("_parts").cast("int").alias("_hot")))
    b = big.join(marks, list(on), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt_on), F.col("_hot")).cast("int"), F.lit(0))).drop("_hot")
    s = small.join(marks, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_hot"), F.lit(1)) - 1))).drop("_hot")
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], lag: dict[str, Column] | None = None, lead: dict[str, Column] | None = None, fill: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """Adds, by name, the value of the row before (lag) or after (lead) within the key by `order`, and the last value
    that is not null up to and including the row (fill).

    A hot key is cut into shards by the first column of `order`; each shard is a window of its own, and what a row at
    a shard's edge needs comes from the summary of the shards beside it. Ties beyond `order` are as good as equal.
    """
    lag, lead, fill = lag or {}, lead or {}, fill or {}
    bounds = shard_bounds(df, keys, order[0], rows)
    s = with_shard(df, keys, order[0], bounds)
    w = W.partitionBy(*keys, "_shard").orderBy(*order)
    out = s.select(
        "*",
        *[F.lag(F.struct(c.alias("v"))).over(w).alias(f"_lag_{n}") for n, c in lag.items()],
        *[F.lead(F.struct(c.alias("v"))).over(w).alias(f"_lead_{n}") for n, c in lead.items()],
        *[F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"_fill_{n}") for n, c in fill.items()],
    )
    if bounds is None:
        val = lambda k, n: F.col(f"_{k}_{n}.v") if k != "fill" else F.col(f"_fill_{n}")
    else:
        o = F.struct(*order)
        sums = (
            s.join(F.broadcast(bounds.select(*keys)), list(keys), "left_semi")
            .groupBy(*keys, "_shard")
            .agg(
                *[F.max_by(F.struct(c.alias("v")), o).alias(f"_e_lag_{n}") for n, c in lag.items()],
                *[F.min_by(F.struct(c.alias("v")), o).alias(f"_e_lead_{n}") for n, c in lead.items()],
                *[F.max_by(c, F.when(c.isNotNull(), o)).alias(f"_e_fill_{n}") for n, c in fill.items()],
            )
        )
        ws = W.partitionBy(*keys).orderBy("_shard")
        sums = sums.select(
            *keys,
            "_shard",
            *[F.lag(f"_e_lag_{n}").over(ws).alias(f"_e_lag_{n}") for n in lag],
            *[F.lead(f"_e_lead_{n}").over(ws).alias(f"_e_lead_{n}") for n in lead],
            *[F.last(f"_e_fill_{n}", True).over(ws.rowsBetween(W.unboundedPreceding, -1)).alias(f"_e_fill_{n}") for n in fill],
        )
        out = out.join(F.broadcast(sums), [*keys, "_shard"], "left")
        val = lambda k, n: F.coalesce(F.col(f"_{k}_{n}"), F.col(f"_e_{k}_{n}"))["v"] if k != "fill" else F.coalesce(F.col(f"_fill_{n}"), F.col(f"_e_fill_{n}"))
    return out.select(*[F.col(c) for c in df.columns], *[val(k, n).alias(n) for k, d in (("lag", lag), ("lead", lead), ("fill", fill)) for n in d])
