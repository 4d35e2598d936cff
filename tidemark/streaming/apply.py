"""A change stream applied to a store, exactly once in effect."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cdc import committed
from tidemark.session import materialize, release
from tidemark.sources.store import Store

_L, _S = T.LongType(), T.StringType()
MESSAGE = T.StructType([T.StructField(n, k) for n, k in (("kind", _S), ("pg_xid", _L), ("top_xid", _L), ("lsn", _L), ("schema_name", _S), ("table_name", _S), ("op", _S), ("commit_xid", _L), ("row", _S), ("undef", T.ArrayType(_S)))])
"""kind: change, ddl, commit, abort. row: the columns, or what the DDL operation says, as one JSON object."""


def messages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of JSON messages in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


class Applier:
    """foreachBatch target: keeps changes of open transactions in a side table until they commit or abort."""

    def __init__(self, store: Store, schemas: dict[str, T.StructType], include: Sequence[str] = ("*",)) -> None:
        self.store, self.schemas, self.include = store, schemas, tuple(include)
        self.open_path = f"{store.root}/_open"

    def _open(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """What the batches before this one left open."""
        fs, path = self.store._fs, self.store._path
        return spark.read.schema(MESSAGE).parquet(f"{self.open_path}/{batch - 1}") if fs.exists(path(f"{self.open_path}/{batch - 1}/_SUCCESS")) else None

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if "*" not in self.include:
            df = df.filter(F.col("schema_name").isNull() | F.col("schema_name").isin(*self.include))
        left = self._open(spark, batch)
        msgs = materialize(df.unionByName(left) if left is not None else df)
        ends = msgs.filter("kind in ('commit', 'abort')").select("pg_xid", "top_xid", F.col("kind").alias("status"), "commit_xid")
        subs = msgs.filter("kind in ('change', 'ddl')").select("pg_xid", "top_xid").distinct().join(ends.select("pg_xid"), "pg_xid", "left_anti")
        tx = ends.unionByName(subs.filter("top_xid is not null").select("pg_xid", "top_xid", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("commit_xid")))
        changes = msgs.filter("kind in ('change', 'ddl')")
        done = materialize(committed(changes.drop("commit_xid"), tx).filter(F.col("xid") > self.store.committed()))
        last = done.agg(F.max("xid")).first()[0]
        if last is not None:
            # changes of the catalog, as many as statements: rows up to each are applied before it
            ddl = done.filter("kind = 'ddl'").select("xid", "lsn", "table_name", "op", "row").orderBy("xid", "lsn").collect()
            at = 0
            for x in sorted({r.xid for r in ddl}):
                self._rows(done, at, x - 1)
                # rows of the transaction itself count under its new columns
                self._rows(done, x - 1, x, [(r.table_name, r.op, json.loads(r.row or "{}")) for r in ddl if r.xid == x])
                at = x
            self._rows(done, at, last, final=True)
        release(done)
        ended = ends.filter("top_xid is null").select(F.col("pg_xid").alias("_x")).distinct()
        rest = msgs.withColumn("_x", F.coalesce("top_xid", "pg_xid")).join(ended, "_x", "left_anti").drop("_x")
        rest.write.mode("overwrite").parquet(f"{self.open_path}/{batch}")
        release(msgs)
        self.store._fs.delete(self.store._path(f"{self.open_path}/{batch - 2}"), True)  # a replay reads one batch back

    def _schema(self, table: str, columns: Sequence[str], types: dict[str, str]) -> T.StructType:
        known = {f.name: f for f in self.schemas.get(table, T.StructType())}
        return T.StructType([known.get(c) or T.StructField(c, T.DataType.fromDDL(types[c])) for c in columns])

    def _rows(self, done: DataFrame, after: int, to: int, ddl: Sequence[tuple[str, str, dict]] = (), final: bool = False) -> None:
        """Changes of the catalog and rows with after < xid <= to as one commit; none where there is nothing to say."""
        if to <= self.store.committed():
            return
        part = done.filter((F.col("kind") == "change") & (F.col("xid") > after) & (F.col("xid") <= to))
        tables = self.store.manifest()["tables"]
        for change in ddl:
            self.store._altered(tables, *change)
        names = [r.table_name for r in part.select("table_name").distinct().collect() if r.table_name in tables]  # as many as tables
        out = {}
        for t in names:
            shape = self._schema(t, tables[t]["columns"], tables[t]["types"])
            rows = part.filter(F.col("table_name") == t).withColumn("_r", F.from_json("row", shape))
            out[t] = rows.select("op", "xid", "lsn", "_r.*", F.col("undef").alias("_undef"))
        if out or ddl or final:
            self.store.apply(out, to, ddl)


def start(spark: SparkSession, folder: str, applier: Applier, checkpoint: str, once: bool = True, files_per_batch: int = 100) -> StreamingQuery:
    """Starts applying; with `once`, until all that is there has been read."""
    w = messages(spark, folder, files_per_batch).writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and key; works on streams and batches. Rows later than `late` are dropped by streams."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
