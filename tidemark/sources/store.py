"""Tables kept as a base and a change log of Parquet files, published by manifests.

A manifest names, for one transaction, the folders that make up each table. It is written aside and renamed, so that a
reader sees all of a commit or nothing; where renaming is no atomic step, as on object stores, there must be one writer.
Folders are never changed once a manifest names them: a column that was renamed or dropped since keeps its name in the
files, and the manifest says what each folder's columns are called now (`names`; null for dropped ones).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cdc import as_inserts, fold, fold_no_key, merge_pending


def _renamed(names: Column, old: str, new: str) -> Column:
    return F.transform(names, lambda x: F.when(x == old, F.lit(new)).otherwise(x))


class Store:
    """Snapshots by transaction id under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifests"))

    def remove(self) -> None:
        """Everything under the root."""
        self._fs.delete(self._path(self.root), True)

    # manifests

    def xids(self) -> list[int]:
        """The published transactions, rising."""
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/_manifests")) if s.getPath().getName().endswith(".json"))

    def committed(self) -> int:
        return max(self.xids(), default=0)

    def manifest(self, as_of: int | None = None) -> dict:
        ok = [x for x in self.xids() if as_of is None or x <= as_of]
        if not ok:
            return {"xid": 0, "tables": {}}
        s = self._fs.open(self._path(f"{self.root}/_manifests/{ok[-1]}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()

    def _publish(self, m: dict) -> None:
        tmp, to = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_manifests/{m['xid']}.json")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise FileExistsError(f"transaction {m['xid']} is published already")

    def _write(self, table: str, kind: str, df: DataFrame, keys: Sequence[str]) -> str:
        path = f"{self.root}/{table}/{kind}-{uuid.uuid4().hex}"
        # sorted within files by key: range predicates on the key skip row groups
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(path)
        return path

    # writing

    def copy(self, table: str, df: DataFrame, keys: Sequence[str], xid: int) -> None:
        """A full copy of a table becomes its base at xid; changes up to xid no longer count (first copy, resync)."""
        if xid <= self.committed():
            return
        m = self.manifest()
        path = self._write(table, "base", df, keys)
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        m["tables"][table] = {"base": path, "base_xid": xid, "keys": list(keys), "columns": df.columns, "types": types, "logs": [], "names": {}, "rows": self.spark.read.parquet(path).count(), "resync": False}
        self._publish({**m, "xid": xid})

    def apply(self, changes: dict[str, DataFrame], xid: int, ddl: Sequence[tuple[str, str, dict]] = ()) -> bool:
        """Changes of the catalog (table, op, r: see alter) and of several tables, published as one commit; a commit that is published already is skipped, so that a
        batch may be replayed. Tables that are not known are skipped."""
        if xid <= self.committed():
            return False
        m = self.manifest()
        for change in ddl:
            self._altered(m["tables"], *change)
        known = [t for t in changes if t in m["tables"]]
        with ThreadPoolExecutor(max(1, min(8, len(known)))) as pool:  # tables are independent until they are published
            paths = list(pool.map(lambda t: self._write(t, "log", changes[t], m["tables"][t]["keys"]), known))
        for t, p in zip(known, paths):
            m["tables"][t]["logs"].append(p)
            m["tables"][t]["rows"] = self._counted(p, m["tables"][t]["rows"])
        self._publish({**m, "xid": xid})
        return True

    def _counted(self, log: str, rows: int) -> int:
        """The number of rows after a log, from its inserts and deletes; a truncation starts from none."""
        at = F.struct("xid", "lsn")
        df = self.spark.read.parquet(log)
        gone = df.filter("op = 'T'").agg(F.max(at).alias("t")).scalar()
        r = df.filter(gone.isNull() | (at > gone)).agg(F.count_if(F.col("op") == "I") - F.count_if(F.col("op") == "D"), F.first(gone.isNull())).first()
        return (r[0] or 0) + (rows if r[1] is None or r[1] else 0)

    def drop(self, table: str, xid: int) -> None:
        self.alter(table, "drop_table", {}, xid)

    def alter(self, table: str, op: str, r: dict, xid: int) -> bool:
        """One change of the catalog as a commit of its own; skipped where xid is published already. op and r: as for
        plans.ddl.statements, with the types of columns as Spark's. A change of type asks for a new copy (needs_copy);
        other operations change nothing that is read here."""
        return self.apply({}, xid, [(table, op, r)])

    @staticmethod
    def _altered(tables: dict, table: str, op: str, r: dict) -> None:
        t = tables.get(table)
        if op == "drop_table":
            tables.pop(table, None)
        elif op == "create_table":
            cols = {c["name"]: c["type"] for c in r["columns"]}
            tables[table] = {"base": None, "base_xid": 0, "keys": list(r.get("keys", ())), "columns": list(cols), "types": cols, "logs": [], "names": {}, "rows": 0, "resync": False}
        elif t is None:
            return
        elif op == "rename_table":
            tables[r["table"]] = tables.pop(table)
        elif op in ("rename_column", "drop_column"):
            old, new = r["old_name"], r.get("new_name")
            for p in (t["base"], *t["logs"]):
                names = t["names"].setdefault(p, {})
                # the file's own name of the column, which may have been another before
                own = next((k for k, v in names.items() if v == old), old)
                if own != old or old not in names:
                    names[own] = new if op == "rename_column" else None
            kind = t["types"].pop(old, None)
            if op == "rename_column":
                t["columns"] = [new if c == old else c for c in t["columns"]]
                t["keys"] = [new if c == old else c for c in t["keys"]]
                t["types"][new] = kind
            else:
                t["columns"] = [c for c in t["columns"] if c != old]
        elif op == "add_column":
            c = r["column"]
            if c["name"] not in t["columns"]:
                # older files may hold a dropped column of that name
                for p in (t["base"], *t["logs"]):
                    t["names"].setdefault(p, {}).setdefault(c["name"], None)
                t["columns"], t["types"] = [*t["columns"], c["name"]], {**t["types"], c["name"]: c["type"]}
        elif op in ("set_type", "resync"):
            t["resync"] = True

    def needs_copy(self) -> list[str]:
        """Tables whose types changed since their copy."""
        return sorted(n for n, t in self.manifest()["tables"].items() if t.get("resync"))

    def catalog(self) -> dict[str, DataFrame]:
        """What the manifests say, by transaction: roots (the folders of each table) and row counts."""
        roots, stats = [], []
        for x in self.xids():  # as many as transactions that are kept
            for n, t in self.manifest(x)["tables"].items():
                roots += [(n, x, p) for p in (t["base"], *t["logs"]) if p]
                stats.append((n, x, t["rows"]))
        return {"table_roots": self.spark.createDataFrame(roots, "table_name string, xid bigint, path string"), "table_stats": self.spark.createDataFrame(stats, "table_name string, xid bigint, row_count bigint")}

    def compact(self, table: str, xid: int) -> None:
        """Folds a table's log into a new base. Readers of earlier manifests keep their files until vacuum()."""
        if xid <= self.committed():
            raise ValueError("a compaction is a commit of its own")
        df, m = self.read(table), self.manifest()
        t = m["tables"][table]
        t.update(base=self._write(table, "base", df, t["keys"]), base_xid=m["xid"], logs=[], names={})
        t["rows"] = self.spark.read.parquet(t["base"]).count()
        self._publish({**m, "xid": xid})

    def vacuum(self, oldest: int) -> list[str]:
        """Removes manifests that no reader at or after `oldest` needs, and folders that no manifest names any more."""
        xs = self.xids()
        keep = [x for x in xs if x >= oldest] or xs[-1:]
        before = [x for x in xs if x < oldest]
        keep = sorted({*keep, *([] if oldest in xs else before[-1:])})
        named = {p for x in keep for t in self.manifest(x)["tables"].values() for p in [t["base"], *t["logs"]]}
        gone = []
        for x in xs:
            if x not in keep:
                self._fs.delete(self._path(f"{self.root}/_manifests/{x}.json"), False)
        for d in self._fs.listStatus(self._path(self.root)):
            if d.isDirectory() and not d.getPath().getName().startswith("_"):
                for f in self._fs.listStatus(d.getPath()):
                    p = f"{self.root}/{d.getPath().getName()}/{f.getPath().getName()}"
                    if p not in named:
                        self._fs.delete(f.getPath(), True)
                        gone.append(p)
        return gone

    # reading

    def read(self, table: str, as_of: int | None = None) -> DataFrame:
        """A table as of a transaction (the last one by default): base and the log on top of it, the last version of
        each key. Column pruning and key predicates reach the base's scan where there is no log."""
        t = self.manifest(as_of)["tables"].get(table)
        if t is None:
            raise KeyError(f"{table} does not exist at {as_of}")
        base = self._files(t, [t["base"]]) if t["base"] else self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in t["types"].items()))
        if not t["logs"]:
            return base.select(*t["columns"])
        log = self._files(t, t["logs"])
        if not t["keys"]:
            both = as_inserts(base, t["base_xid"]).unionByName(log.filter(F.col("xid") > t["base_xid"]), allowMissingColumns=True)
            return fold_no_key(both, t["columns"], as_of)
        return merge_pending(base, t["base_xid"], log, t["keys"], as_of).select(*t["columns"])

    def _files(self, t: dict, paths: Sequence[str]) -> DataFrame:
        """Folders of a table under the names that its columns have now; folders whose names agree are one scan."""
        groups: dict[str, list[str]] = {}
        for p in paths:
            groups.setdefault(json.dumps(t["names"].get(p, {}), sort_keys=True), []).append(p)
        out = None
        for key, ps in groups.items():
            names, df = json.loads(key), self.spark.read.option("mergeSchema", str(len(ps) > 1).lower()).parquet(*ps)
            df = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if names.get(c, c) is not None])
            if "_undef" in df.columns and names:
                renamed = {k: v for k, v in names.items() if v}
                pick = F.col("_undef")
                for k, v in renamed.items():
                    pick = _renamed(pick, k, v)
                df = df.withColumn("_undef", pick)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out.select("*", *[F.lit(None).cast(t["types"][c]).alias(c) for c in t["columns"] if c not in out.columns])

    def history(self, table: str, values: Sequence[str], as_of: int) -> DataFrame:
        """fold() over the log alone."""
        t = self.manifest()["tables"][table]
        return fold(self.spark.read.parquet(*t["logs"]), t["keys"], values, as_of)

    def tables(self, as_of: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
        """Names of the tables at a transaction: all, or those to include, without those to exclude."""
        return sorted(t for t in self.manifest(as_of)["tables"] if (not include or t in include) and t not in exclude)

    def register(self, as_of: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> int:
        """All tables as temporary views of one transaction, whose id is returned."""
        xid = self.manifest(as_of)["xid"]
        for t in self.tables(xid, include, exclude):
            self.read(t, xid).createOrReplaceTempView(t)
        return xid
