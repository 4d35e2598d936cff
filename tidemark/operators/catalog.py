"""The versioned catalog: what tables and columns were called at a transaction, and rows of old versions under it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.hierarchy import hierarchy

# Kinds of catalog updates.
NEW, REMOVED, RENAMED, NULLABLE, RESYNC, NEW_INDEX, DROP_INDEX, NO_CHANGE = range(8)


def as_of(versions: DataFrame, keys: Sequence[str], xid: int, exists: str | None = None, order: Sequence[str] = ("xid", "lsn")) -> DataFrame:
    """The entry of each key in force at a transaction: the one greatest by `order` with xid up to it; a tombstone
    (exists false) ends a key."""
    cols = [c for c in versions.columns if c not in keys]
    got = versions.filter(F.col("xid") <= xid).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_b")).select(*keys, "_b.*")
    return got.filter(F.coalesce(F.col(exists), F.lit(True))) if exists else got


def project(df: DataFrame, stored: dict[int, str], wanted: dict[int, tuple[str, str]]) -> DataFrame:
    """Rows stored under one version of the columns, as of another: by position, a renamed column is renamed, a new one
    is null, a removed one is left out, a type that changed is cast (what does not fit is null). Positions may have
    holes. stored: position to name; wanted: position to (name, Spark type)."""
    return df.select(*[(F.col(f"`{stored[p]}`").try_cast(t) if p in stored else F.lit(None).cast(t)).alias(n) for p, (n, t) in sorted(wanted.items())])


def diff(old: dict[int, tuple[str, str, bool]], new: dict[int, tuple[str, str, bool]]) -> list[tuple[int, int]]:
    """(position, kind) of each difference between two versions: position to (name, type, nullable). A removed or new
    column and a change of type ask for a copy of the table; names and nullability do not."""
    out = []
    for p in sorted(old.keys() | new.keys()):
        if p not in new:
            out.append((p, REMOVED))
        elif p not in old:
            out.append((p, NEW))
        else:
            (n0, t0, u0), (n1, t1, u1) = old[p], new[p]
            out += [(p, RESYNC)] * (t0 != t1) + [(p, RENAMED)] * (n0 != n1) + [(p, NULLABLE)] * (u0 != u1)
    return out


def union_view(leaves: Sequence[tuple[DataFrame, Column | None]]) -> DataFrame:
    """A partitioned table: all leaves by name, each under its bound as a predicate, so that the optimizer drops leaves
    that a query's filter contradicts. Columns that a leaf lacks are null."""
    out = None
    for df, bound in leaves:
        d = df.filter(bound) if bound is not None else df
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def leaves_of(parts: DataFrame, root: int) -> list[int]:
    """The tables without children below root in (tid, parent), which are its leaf partitions."""
    p = parts.select(F.lit(0).alias("_s"), "tid", "parent")
    below = hierarchy(p, ["_s"], "tid", "parent", every_ancestor=True).filter(F.col("root") == root).select(F.col("node").alias("tid"))
    return sorted(r.tid for r in below.join(p.select(F.col("parent").alias("tid")), "tid", "left_anti").distinct().collect())


def enum_rank(col: str, labels: dict[str, float]) -> Column:
    """The place of an enum's label, to sort and compare by; a label that is not listed is null."""
    return F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(col)]


def enum_add(labels: dict[str, float], label: str, before: str | None = None, after: str | None = None) -> dict[str, float]:
    """The labels with one more, put between two others by a fractional place."""
    order = sorted(labels, key=labels.get)
    i = order.index(before) if before else order.index(after) + 1 if after else len(order)
    lo = labels[order[i - 1]] if i else labels[order[0]] - 2 if order else 0.0
    hi = labels[order[i]] if i < len(order) else lo + 2
    return {**labels, label: (lo + hi) / 2}


def valid_table(columns: DataFrame, ok_schemas: Sequence[str]) -> DataFrame:
    """(tid, reason) of tables that cannot be kept: a generated column, a collation of its own, a user type other than
    an enum or an extension's, or a type of a schema that is not replicated."""
    every = "*" in ok_schemas
    why = (
        F.when(F.col("generated"), "generated column")
        .when(F.coalesce("collation", F.lit("default")).isin("default", "C", "POSIX") == F.lit(False), "collation")
        .when(F.col("type_category").isin("E", "U", "base") == F.lit(False), "user type")
        .when(F.lit(not every) & ~F.col("type_schema").isin("pg_catalog", *ok_schemas), "schema of type")
    )
    return columns.select("tid", why.alias("reason")).filter("reason is not null").groupBy("tid").agg(F.min("reason").alias("reason"))


def struct_of(columns: Sequence[tuple[str, str, bool]]) -> T.StructType:
    """A Spark schema of catalog columns (name, Spark type, nullable)."""
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t), u) for n, t, u in columns])


def system_tables(ddl: DataFrame, columns: DataFrame) -> dict[str, DataFrame]:
    """The catalog as tables, each entry versioned by (xid, lsn), from DDL records and column versions.

    Namespaces have their names as ids. A record that came twice is one entry. Indexes, roots and user types have no
    source among these records; their tables are there, and empty.
    """
    rec = ddl.dropna(subset=["tid", "xid", "lsn"]).dropDuplicates(["db_id", "tid", "xid", "lsn", "op"])
    cols = columns.groupBy("db_id", "table_id", "col_position", "xid", "lsn").agg(F.max_by(F.struct("col_exists", "col_name", "type_name", "pg_type", "is_nullable", "update_type"), F.struct("recorded_at", "history_id")).alias("c"))
    spark = ddl.sparkSession
    empty = lambda ddl_text: spark.createDataFrame([], ddl_text)
    first = rec.filter("schema_name is not null").groupBy("db_id", "schema_name").agg(F.min(F.struct("xid", "lsn")).alias("f"))
    return {
        "table_names": rec.select("db_id", F.col("schema_name").alias("namespace"), F.col("table_name").alias("name"), F.col("tid").alias("table_id"), "xid", "lsn", (F.col("op") != "drop_table").alias("exists"), "parent_table_id", "partition_key", "partition_bound", "rls_enabled"),
        "schemas": cols.select("db_id", "table_id", F.col("col_position").alias("position"), "xid", "lsn", F.col("c.col_exists").alias("exists"), F.col("c.col_name").alias("name"), F.col("c.type_name").alias("type"), "c.pg_type", F.col("c.is_nullable").alias("nullable"), "c.update_type"),
        "namespace_names": first.select("db_id", F.col("schema_name").alias("name"), "f.xid", "f.lsn", F.lit(True).alias("exists")),
        "table_roots": empty("db_id bigint, table_id bigint, index_id bigint, xid bigint, path string"),
        "indexes": empty("db_id bigint, table_id bigint, index_id bigint, xid bigint, lsn bigint, position int, column_id int"),
        "table_stats": empty("db_id bigint, table_id bigint, xid bigint, row_count bigint"),
        "index_names": empty("db_id bigint, table_id bigint, index_id bigint, xid bigint, lsn bigint, namespace string, name string, state int, is_unique boolean"),
        "user_types": empty("db_id bigint, type_id bigint, namespace string, name string, value string, xid bigint, lsn bigint, type string, exists boolean"),
    }


# States of an index.
NOT_READY, READY, DELETED, BEING_DELETED = range(4)


def ready_indexes(names: DataFrame, xid: int) -> DataFrame:
    """The indexes that reads at a transaction may rely on, from the versions of index_names."""
    return as_of(names, ["db_id", "table_id", "index_id"], xid).filter(F.col("state") == READY)
