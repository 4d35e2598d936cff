"""Queries p1 to p5 over the catalog and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators.asof import asof_candidates
from tidemark.operators.hierarchy import hierarchy
from tidemark.operators.orphans import event_orphans, snapshot_orphans
from tidemark.operators.snapshot_diff import as_set, snapshot_changes, squeeze
from tidemark.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(load(spark, d, "ddl_log"), load(spark, d, "table_dump"), load(spark, d, "type_catalog"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """The lines of table_dump as one table per tid, under its columns' last names: as one JSON object in their order."""
    got = drift.unified(load(spark, d, "ddl_log"), load(spark, d, "table_dump"), load(spark, d, "type_catalog"))
    return got.withColumn("columns", F.to_json("columns"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(tree, scope_key, child, parent) of both trees."""
    drops = load(spark, d, "ddl_log").filter("op = 'drop_table'").select(F.lit("table").alias("tree"), F.col("db_id").cast("string").alias("scope_key"), F.col("tid").alias("child"), F.col("parent_table_id").alias("parent"))
    m = load(spark, d, "role_member_snapshot_history")
    last = m.groupBy("fdw_id").agg(F.max("snapshot_time").alias("snapshot_time"))
    roles = m.join(last, ["fdw_id", "snapshot_time"]).select(F.lit("role").alias("tree"), F.col("fdw_id").alias("scope_key"), F.col("member_oid").alias("child"), F.col("role_oid").alias("parent"))
    return drops.unionByName(roles)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(_links(spark, d), ["tree", "scope_key"], "child", "parent", node="node_id")
    return h.select("tree", "scope_key", "node_id", F.coalesce("root", F.lit(-1)).alias("root_id"), F.col("depth").alias("node_depth"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each node's path from each of its roots."""
    h = hierarchy(_links(spark, d), ["tree", "scope_key"], "child", "parent", node="node_id", paths=True)
    return h.filter("depth >= 0").select("tree", "scope_key", "node_id", F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.col("path").alias("node_path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each node, with the edges of the shortest way. A node on a cycle is a descendant of itself and
    of all others on it; on_cycle says whether the descendant lies on a cycle."""
    h = hierarchy(_links(spark, d), ["tree", "scope_key"], "child", "parent", node="descendant_id", every_ancestor=True, through_cycles=True)
    key = ["tree", "scope_key", "descendant_id"]
    marked = h.filter("depth > 0").join(h.filter("depth = -1").select(*key, F.lit(True).alias("on_cycle")), key, "left")
    return marked.select("tree", "scope_key", F.col("root").alias("node_id"), "descendant_id", F.col("depth").alias("distance"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    roles = snapshot_changes(
        load(spark, d, "role_snapshot_history"), "fdw_id", "role_oid", "snapshot_time", "ingested_at",
        [F.col("rolname"), F.col("rolsuper"), F.col("rolinherit"), F.col("rolcanlogin"), F.col("rolbypassrls"), as_set("rolconfig")],
    )
    policies = snapshot_changes(
        load(spark, d, "policy_snapshot_history"), "fdw_id", "policy_oid", "snapshot_time", "ingested_at",
        [F.col("policy_name"), F.col("policy_permissive"), as_set("policy_roles"), squeeze("policy_qual")],
    )
    pick = lambda df, name, key: df.select(F.lit(name).alias("source_table"), "fdw_id", F.col(key).alias("record_oid"), F.date_format("snapshot_time", "yyyy-MM-dd HH:mm:ss").alias("snapshot_at"), "change_kind")
    return pick(roles, "role_snapshot_history", "role_oid").unionByName(pick(policies, "policy_snapshot_history", "policy_oid"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    req = load(spark, d, "xid_request").filter("schema_xid is not null")
    hist = load(spark, d, "column_history")
    push = load(spark, d, "xid_push").filter("has_schema_changes and real_commit")
    col = asof_candidates(req, hist, ["db_id", "table_id", "col_position"], ["request_id"], "schema_xid", "requested_at", ["xid", "lsn"], "recorded_at", ["history_id", "col_exists"])
    sent = asof_candidates(req, push, ["db_id"], ["request_id"], "schema_xid", "requested_at", ["xid"], "pushed_at", [])
    kind = col.schema["match"].dataType
    both = col.select("request_id", "match", F.lit(None).cast("long").alias("push_xid")).unionByName(sent.select("request_id", F.lit(None).cast(kind).alias("match"), F.col("match.xid").alias("push_xid")))
    got = both.groupBy("request_id").agg(F.max("match").alias("m"), F.max("push_xid").alias("push_xid"))
    return got.filter("m.col_exists").select("request_id", F.col("m.history_id").alias("history_id"), "push_xid")


def _references(spark: SparkSession, d: str) -> DataFrame:
    pol, own, role, ddl = (load(spark, d, t) for t in ("policy_snapshot_history", "table_owner_snapshot_history", "role_snapshot_history", "ddl_log"))
    # a policy may be delivered again with other contents: the last one counts
    pol = pol.groupBy("fdw_id", "snapshot_time", "policy_oid").agg(F.max(F.struct("ingested_at", "table_oid")).alias("p"))
    a = snapshot_orphans(
        pol.select(F.col("fdw_id").alias("scope"), F.col("policy_oid").alias("record_id"), F.col("p.table_oid").alias("ref_id"), F.col("snapshot_time").alias("at")),
        own.select(F.col("fdw_id").alias("scope"), F.col("table_oid").alias("key"), F.col("snapshot_time").alias("at")),
    ).withColumn("source_table", F.lit("policy_snapshot_history"))
    b = snapshot_orphans(
        own.select(F.col("fdw_id").alias("scope"), F.col("table_oid").alias("record_id"), F.col("role_owner_oid").alias("ref_id"), F.col("snapshot_time").alias("at")),
        role.select(F.col("fdw_id").alias("scope"), F.col("role_oid").alias("key"), F.col("snapshot_time").alias("at")),
    ).withColumn("source_table", F.lit("table_owner_snapshot_history"))
    scope = F.col("db_id").cast("string").alias("scope")
    c = event_orphans(
        ddl.filter("op = 'drop_table'").select(scope, F.col("tid").alias("record_id"), F.col("parent_table_id").alias("ref_id"), "xid", "lsn", F.col("committed_at").alias("at")),
        ddl.filter("op in ('create_table', 'drop_table')").select(scope, F.col("tid").alias("key"), F.split("op", "_")[0].alias("kind"), "xid", "lsn"),
    ).withColumn("source_table", F.lit("ddl_log"))
    return a.unionByName(b).unionByName(c).withColumn("ref_month", F.date_format("at", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).select("source_table", F.col("scope").alias("scope_key"), "record_id", "ref_id", "ref_month", "ref_status").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and status."""
    return _references(spark, d).groupBy("source_table", "ref_month", "ref_status").agg(F.count(F.lit(1)).alias("n_refs"))


from tidemark.plans.pipeline_sql import SQL  # noqa: E402, F401

QUERIES = {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_paths, p2_descendants, p3_found, p4_found, p5_found, p5_report)}
