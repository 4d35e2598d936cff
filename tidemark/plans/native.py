"""Queries for the operators beyond SQL text: snapshots, change logs, catalog versions, frames, policies, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine import Engine
from tidemark.operators import catalog, cdc, windows
from tidemark.operators.asof import asof_known
from tidemark.plans.security import Policy, secured
from tidemark.session import materialize, shared_dir
from tidemark.sources import files
from tidemark.sources.store import Store
from tidemark.sources.tables import load
from tidemark.streaming.apply import Applier, start, windowed_counts

OP = "CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END"
X = 4000
LOG = f"SELECT {OP} AS op, event_id AS xid, CAST(0 AS BIGINT) AS lsn, user_id, value, event_type FROM events"
_LAST = "SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC) AS rn FROM ({log}) l WHERE {cond}) t WHERE rn = 1 AND op <> 'D'"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a change log of a table with key user_id."""
    return load(spark, d, "events").select(F.expr(OP).alias("op"), F.col("event_id").alias("xid"), F.lit(0).cast("long").alias("lsn"), "user_id", "value", "event_type")


KEY, VALS = ["user_id"], ["value", "event_type"]


def cdc_latest(spark, d):
    return cdc.fold(_log(spark, d), KEY, VALS)


def snapshot_asof(spark, d):
    return cdc.fold(_log(spark, d), KEY, VALS, X)


def cdc_delete(spark, d):
    return cdc.latest_only(_log(spark, d), KEY).filter("op = 'D'").select("user_id", "xid")


def cdc_truncate(spark, d):
    return cdc.fold(_log(spark, d).withColumn("op", F.when(F.col("xid") == X, "T").otherwise(F.col("op"))), KEY, VALS)


def cdc_update_partial(spark, d):
    log = _log(spark, d).withColumn("_undef", F.when((F.col("op") == "U") & (F.col("xid") % 3 == 0), F.array(F.lit("value"))))
    return cdc.fold(log, KEY, VALS)


def cdc_txn_abort(spark, d):
    log = _log(spark, d).withColumn("pg_xid", F.expr("xid div 10")).drop("xid").withColumn("lsn", F.monotonically_increasing_id() * 0)
    tx = log.select("pg_xid").distinct().select("pg_xid", F.when(F.col("pg_xid") % 5 == 0, F.col("pg_xid") + 1).alias("top_xid"), F.when(F.col("pg_xid") % 7 == 0, "abort").otherwise("commit").alias("status"), (F.col("pg_xid") + 1000).alias("commit_xid"))
    return cdc.committed(log, tx).groupBy("xid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "D").alias("deletes"))


def cdc_no_key_delete(spark, d):
    rows = load(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "D").otherwise("I").alias("op"), F.col("event_id").alias("xid"), F.lit(0).cast("long").alias("lsn"), (F.col("user_id") % 50).alias("u"), "event_type")
    return cdc.fold_no_key(rows, ["u", "event_type"]).groupBy("u", "event_type").agg(F.count(F.lit(1)).alias("n"))


def cdc_key_update(spark, d):
    log = _log(spark, d).withColumn("_old", F.when((F.col("op") == "U") & (F.col("xid") % 4 == 0), F.struct((F.col("user_id") + 1).alias("user_id"))))
    return cdc.fold(cdc.split_key_updates(log, KEY), KEY, VALS)


def cdc_merge_pending(spark, d):
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("event_type"))
    return cdc.merge_pending(base, 1000, _log(spark, d), KEY)


def cdc_copy_catchup(spark, d):
    log = _log(spark, d).withColumn("pg_xid", F.expr("xid div 10"))
    return cdc.after_copy(log, 100, 300, [120, 250]).groupBy("pg_xid").agg(F.count(F.lit(1)).alias("n"))


def compaction_view(spark, d):
    return cdc.fold(cdc.compact(_log(spark, d), KEY, VALS, X), KEY, VALS)


def _kept(st: Store, df: DataFrame) -> DataFrame:
    """The result, and the store that it came from removed."""
    got = materialize(df)
    st.remove()
    return got


def store_snapshot(spark, d):
    """A copy, two commits, a replay that is skipped, and a read between the commits."""
    st = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    st.copy("t", load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("event_type")), KEY, 1000)
    log = _log(spark, d).filter("xid > 1000")
    st.apply({"t": log.filter(f"xid <= {X}")}, X)
    st.apply({"t": log.filter(f"xid > {X}")}, 10**12)
    st.apply({"t": log}, X)
    return _kept(st, st.read("t", X))


SHOP = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("event_type", T.StringType())])


def _messages(spark, d, folder):
    """events as a replication stream in three files: each run of ten is a transaction (each seventh aborts, each fifth is
    a part of the next one), the last is left open, and after half of them the table's column is renamed and one is added."""
    e = load(spark, d, "events").filter("user_id is not null")
    part = F.expr("event_id div 10")
    row = F.to_json(F.struct("user_id", F.when(F.col("event_id") < X, F.col("value")).alias("value"), F.when(F.col("event_id") >= X, F.col("value")).alias("amount"), "event_type", F.when(F.col("event_id") >= X, F.lit("new")).alias("note")))
    body = F.when(F.col("event_id") % 3 == 0, F.lit("D")).otherwise("I")
    change = e.select(F.lit("change").alias("kind"), part.alias("pg_xid"), F.when(part % 5 == 0, part + 1).alias("top_xid"), F.col("event_id").alias("lsn"), F.lit("public").alias("schema_name"), F.when(F.col("event_id") % 11 == 0, "unknown").otherwise("shop").alias("table_name"), body.alias("op"), F.lit(None).cast("long").alias("commit_xid"), row.alias("row"))
    tx = e.select(part.alias("pg_xid")).distinct()
    end = tx.select(F.when(F.col("pg_xid") % 7 == 0, "abort").otherwise("commit").alias("kind"), "pg_xid", F.when(F.col("pg_xid") % 5 == 0, F.col("pg_xid") + 1).alias("top_xid"), (F.col("pg_xid") * 10 + 9).alias("lsn"), (F.col("pg_xid") * 2 + 1000).alias("commit_xid"))
    end = end.filter((F.col("pg_xid") < X / 10 + 500) & (F.col("kind").isin("abort") | F.col("top_xid").isNull()))
    ddl = spark.createDataFrame([("ddl", 2_000_000, X - 1, "public", "shop", "rename_column", '{"old_name": "value", "new_name": "amount"}'), ("ddl", 2_000_000, X - 1, "public", "shop", "add_column", '{"column": {"name": "note", "type": "string"}}')], "kind string, pg_xid bigint, lsn bigint, schema_name string, table_name string, op string, row string")
    mark = spark.createDataFrame([("commit", 2_000_000, X - 1, X // 10 * 2 + 999)], "kind string, pg_xid bigint, lsn bigint, commit_xid bigint")
    every = change.unionByName(end, allowMissingColumns=True).unionByName(ddl, allowMissingColumns=True).unionByName(mark, allowMissingColumns=True)
    third = F.when(F.col("lsn") < X / 2, 0).when(F.col("lsn") < X + 2000, 1).otherwise(2)
    for i in range(3):
        every.filter(third == i).coalesce(2).write.mode("append").json(folder)


def _applied(spark, d, then):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    st = Store(spark, f"{root}/store")
    st.copy("shop", spark.createDataFrame([], SHOP), KEY, 1)
    _messages(spark, d, f"{root}/in")
    # what was read last time is not applied again: a second run from the start must change nothing
    for again in ("a", "b"):
        start(spark, f"{root}/in", Applier(st, {"shop": SHOP}), f"{root}/ck-{again}", files_per_batch=2).awaitTermination()
    return _kept(Store(spark, root), then(st))


def stream_apply(spark, d):
    """Streamed transactions, aborts, parts, unknown tables, an ALTER on the way, and a replay: the table at the end."""
    return _applied(spark, d, lambda st: st.read("shop"))


def stream_apply_asof(spark, d):
    """The same before the ALTER: the columns as they were."""
    return _applied(spark, d, lambda st: st.read("shop", X // 10 * 2 + 998))


def table_stats(spark, d):
    """Row counts as kept with each commit, against a count."""
    st = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    st.copy("t", c.filter("c_acctbal < 5000"), ["c_custkey"], 10)
    log = lambda cond, op, xid: c.filter(cond).select(F.lit(op).alias("op"), F.lit(xid).cast("long").alias("xid"), F.lit(0).cast("long").alias("lsn"), "c_custkey", "c_acctbal")
    st.apply({"t": log("c_acctbal >= 5000", "I", 20)}, 20)
    st.apply({"t": log("c_acctbal < 0", "D", 30)}, 30)
    st.compact("t", 40)
    return _kept(st, st.catalog()["table_stats"].select("table_name", "xid", "row_count"))


def store_resync(spark, d):
    """A change of type asks for a new copy; after it the old log no longer counts. Vacuum leaves what is read."""
    st = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("int").alias("price"))
    st.copy("t", o, ["o_orderkey"], 10)
    st.apply({"t": o.filter("price % 2 = 0").select(F.lit("D").alias("op"), F.lit(20).cast("long").alias("xid"), F.lit(0).cast("long").alias("lsn"), "o_orderkey", "price")}, 20)
    st.alter("t", "set_type", {"column": "price", "type": "double"}, 30)
    assert st.needs_copy() == ["t"]
    st.copy("t", load(spark, d, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_totalprice").alias("price")), ["o_orderkey"], 40)
    st.vacuum(40)
    return _kept(st, st.read("t"))


def copy_out(spark, d):
    return Engine.over(spark, d, "customer").sql("COPY (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') FROM customer) TO STDOUT")


def csv_load(spark, d):
    """A table written as CSV with a header and read again under a schema."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", "true").csv(path)
    return _kept(Store(spark, path), files.read(spark, "csv", path, "s_suppkey bigint, s_name string, s_acctbal double", pathGlobFilter="*.csv"))


def prepared(spark, d):
    e = Engine.over(spark, d, "orders")
    e.sql("PREPARE q (int, text) AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_orderstatus <> $2")
    return e.sql("EXECUTE q(7, 'P')")


def register_tables(spark, d):
    """All tables of a store under one transaction, but those left out."""
    st = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for i, n in enumerate(("nation", "region", "supplier"), 1):
        t = load(spark, d, n)
        st.copy(f"imp_{n}", t, t.columns[:1], i)
    st.register(exclude=["imp_supplier"])
    return _kept(st, Engine(spark).sql("SELECT n_name, r_name FROM imp_nation JOIN imp_region ON n_regionkey = r_regionkey"))


def transaction_pin(spark, d):
    """Statements of one transaction see the commit that was the last at BEGIN; the next transaction sees what came."""
    st = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    st.copy("pinned", n.filter("n_nationkey < 10"), ["n_nationkey"], 10)
    e, out = Engine(spark), []
    e.attach(st)
    for words in (["BEGIN"], [], ["COMMIT"]):
        for w in words:
            e.sql(w)
        out.append(materialize(e.sql("SELECT count(*) AS n FROM pinned").withColumn("step", F.lit(len(out)))))
        if len(out) == 1:
            st.apply({"pinned": n.filter("n_nationkey >= 10").select(F.lit("I").alias("op"), F.lit(20).cast("long").alias("xid"), F.lit(0).cast("long").alias("lsn"), "n_nationkey", "n_name")}, 20)
    return _kept(st, out[0].unionByName(out[1]).unionByName(out[2]))


def catalog_columns_asof(spark, d):
    h = load(spark, d, "column_history")
    got = catalog.as_of(h, ["db_id", "table_id", "col_position"], 1_400_000, "col_exists", ("xid", "lsn", "recorded_at"))
    return got.select("db_id", "table_id", "col_position", "history_id")


def catalog_tables_asof(spark, d):
    h = load(spark, d, "ddl_log").filter("op is not null").withColumn("alive", F.col("op") != "drop_table")
    return catalog.as_of(h, ["db_id", "tid"], 1_400_000, "alive").select("db_id", "tid", "schema_name", "table_name")


def catalog_scan_tables(spark, d):
    return catalog.system_tables(load(spark, d, "ddl_log"), load(spark, d, "column_history"))["table_names"]


def catalog_scan_columns(spark, d):
    return catalog.system_tables(load(spark, d, "ddl_log"), load(spark, d, "column_history"))["schemas"]


def catalog_scan_namespaces(spark, d):
    return catalog.system_tables(load(spark, d, "ddl_log"), load(spark, d, "column_history"))["namespace_names"]


def schema_evolve_project(spark, d):
    old = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    stored = {1: "o_orderkey", 2: "o_custkey", 4: "price", 5: "o_orderstatus"}
    return catalog.project(old, stored, {1: ("id", "bigint"), 4: ("total_price", "double"), 5: ("status", "string"), 7: ("note", "string")}).withColumn("note", F.coalesce("note", F.lit("none")))


def partition_union(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [(o.filter(F.col("o_orderstatus") == s), F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return catalog.union_view(parts).filter("o_orderstatus = 'P' and o_totalprice > 100000")


def rls_view(spark, d):
    pol = [Policy("own", True, ["analyst"], "(c_nationkey = ANY (ARRAY[1, 2, 3]))"), Policy("seg", True, ["public"], "c_mktsegment::text ~~ 'B%'"), Policy("not_broke", False, [], "(c_acctbal >= 0)"), Policy("other", True, ["boss"], None)]
    return secured(load(spark, d, "customer"), pol, "ann", ["analyst"]).select("c_custkey")


def enum_order(spark, d):
    """Labels in their own order, one added between two others: those before O, with their places."""
    labels = catalog.enum_add({"P": 1.0, "O": 2.0}, "F", before="O")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", catalog.enum_rank("o_orderstatus", labels).alias("place"))
    return o.filter(F.col("place") < labels["O"])


def pivot_crosstab(spark, d):
    got = load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return got.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


def win_groups(spark, d):
    e = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return windows.groups_frame(e, ["l_suppkey"], [F.col("l_quantity").asc_nulls_last()], -2, 1, {"n": F.count(F.lit(1)), "top": F.max("l_orderkey")})


def win_exclude(spark, d):
    e = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    o = [F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    a = windows.exclude_frame(e, ["l_suppkey"], o, -2, 2, "current row", "sum", "l_orderkey", "without_row")
    b = windows.exclude_frame(a, ["l_suppkey"], o[:1], -1, 1, "group", "count", "l_orderkey", "without_group")
    return windows.exclude_frame(b, ["l_suppkey"], o[:1], -1, 1, "ties", "max", "l_orderkey", "without_ties")


def range_agg(spark, d):
    o = load(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("hi"))
    return windows.range_agg(o, ["o_custkey"], "lo", "hi")


def hypothetical_set(spark, d):
    h = windows.hypothetical_rank(load(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", 3000.0)
    return h.select("s_nationkey", "rank", "dense_rank", F.round("percent_rank", 8).alias("percent_rank"), F.round("cume_dist", 8).alias("cume_dist"))


def join_asof_lookup(spark, d):
    zero = F.lit(0)
    req = load(spark, d, "xid_request").withColumn("_z", zero)
    push = load(spark, d, "xid_push").withColumn("_z", zero)
    got = asof_known(req.filter("schema_xid is not null"), push, ["db_id"], ["request_id"], "schema_xid", "_z", ["xid"], "_z", [])
    return got.select("request_id", F.col("match.xid").alias("last_xid"))


def join_strategies(spark, d):
    """The same join by broadcast, sort-merge and shuffled hash."""
    o, c = load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = None
    for how in ("broadcast", "merge", "shuffle_hash"):
        j = o.join(c.hint(how), "o_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("how", F.lit(how))
        out = j if out is None else out.unionByName(j)
    return out


def sorted_merge(spark, d):
    """Sorted inputs as one sorted output: union, then one range-partitioned sort."""
    a, b = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("src")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("src"))
    return a.unionByName(b).orderBy("k", "src")


def stream_window_counts(spark, d):
    return windowed_counts(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "10 minutes").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


_S = "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, {} FROM lineitem"
SQL = {
    "cdc_latest": _LAST.format(log=LOG, cond="true"),
    "snapshot_asof": _LAST.format(log=LOG, cond=f"xid <= {X}"),
    "cdc_delete": f"SELECT user_id, xid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC) AS rn FROM ({LOG}) l) t WHERE rn = 1 AND op = 'D'",
    "cdc_truncate": _LAST.format(log=LOG, cond=f"xid > coalesce((SELECT max(event_id) FROM events WHERE event_id = {X}), -1)"),
    "cdc_update_partial": f"""WITH l AS ({LOG}), g AS (SELECT user_id, max(xid) FILTER (WHERE op = 'D') AS gone, max(xid) AS last FROM l GROUP BY user_id)
        SELECT g.user_id, (SELECT arg_max(l.value, l.xid) FROM l WHERE l.user_id = g.user_id AND l.xid > coalesce(g.gone, -1) AND NOT (l.op = 'U' AND l.xid % 3 = 0)) AS value,
               (SELECT arg_max(l.event_type, l.xid) FROM l WHERE l.user_id = g.user_id) AS event_type FROM g WHERE coalesce(g.gone, -1) < g.last""",
    "cdc_txn_abort": f"""WITH l AS (SELECT op, xid // 10 AS pg_xid FROM ({LOG}) x), s AS (SELECT DISTINCT pg_xid, CASE WHEN pg_xid % 5 = 0 THEN pg_xid + 1 END AS top FROM l)
        SELECT CAST(t.pg_xid + 1000 AS BIGINT) AS xid, count(*) AS n, count(*) FILTER (WHERE l.op = 'D') AS deletes FROM l JOIN s ON s.pg_xid = l.pg_xid JOIN s t ON t.pg_xid = coalesce(s.top, s.pg_xid)
        WHERE s.pg_xid % 7 <> 0 AND t.pg_xid % 7 <> 0 AND t.top IS NULL GROUP BY 1""",
    "cdc_no_key_delete": "SELECT user_id % 50 AS u, event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) > 0",
    "cdc_key_update": f"""WITH l AS ({LOG}), e AS (SELECT xid, user_id, value, event_type, op, 1 AS o FROM l UNION ALL SELECT xid, user_id + 1, value, event_type, 'D', 0 FROM l WHERE op = 'U' AND xid % 4 = 0)
        SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC, o DESC) AS rn FROM e) t WHERE rn = 1 AND op <> 'D'""",
    "cdc_merge_pending": f"""SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC) AS rn FROM (
        SELECT op, xid, user_id, value, event_type FROM ({LOG}) l WHERE xid > 1000 UNION ALL SELECT 'I', 1000, c_custkey, c_acctbal, c_mktsegment FROM customer) u) t WHERE rn = 1 AND op <> 'D'""",
    "cdc_copy_catchup": "SELECT event_id // 10 AS pg_xid, count(*) AS n FROM events WHERE event_id // 10 >= 300 OR event_id // 10 IN (120, 250) GROUP BY 1",
    "store_snapshot": f"""SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC) AS rn FROM (
        SELECT op, xid, user_id, value, event_type FROM ({LOG}) l WHERE xid > 1000 AND xid <= {X} UNION ALL SELECT 'I', 1000, c_custkey, c_acctbal, c_mktsegment FROM customer) u) t WHERE rn = 1 AND op <> 'D'""",
    "catalog_columns_asof": "SELECT db_id, table_id, col_position, history_id FROM (SELECT *, row_number() OVER (PARTITION BY db_id, table_id, col_position ORDER BY xid DESC, lsn DESC, recorded_at DESC) AS rn FROM column_history WHERE xid <= 1400000) t WHERE rn = 1 AND coalesce(col_exists, true)",
    "catalog_tables_asof": "SELECT db_id, tid, schema_name, table_name FROM (SELECT *, row_number() OVER (PARTITION BY db_id, tid ORDER BY xid DESC, lsn DESC) AS rn FROM ddl_log WHERE xid <= 1400000) t WHERE rn = 1 AND op <> 'drop_table'",
    "catalog_scan_tables": "SELECT DISTINCT db_id, schema_name AS namespace, table_name AS name, tid AS table_id, xid, lsn, op <> 'drop_table' AS exists, parent_table_id, partition_key, partition_bound, rls_enabled FROM ddl_log",
    "catalog_scan_columns": "SELECT db_id, table_id, col_position AS position, xid, lsn, col_exists AS exists, col_name AS name, type_name AS type, pg_type, is_nullable AS nullable, update_type FROM (SELECT *, row_number() OVER (PARTITION BY db_id, table_id, col_position, xid, lsn ORDER BY recorded_at DESC, history_id DESC) AS rn FROM column_history) t WHERE rn = 1",
    "catalog_scan_namespaces": "SELECT db_id, schema_name AS name, xid, lsn, true AS exists FROM (SELECT *, row_number() OVER (PARTITION BY db_id, schema_name ORDER BY xid, lsn) AS rn FROM ddl_log) t WHERE rn = 1",
    "schema_evolve_project": "SELECT o_orderkey AS id, o_totalprice AS total_price, o_orderstatus AS status, 'none' AS note FROM orders",
    "partition_union": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000",
    "rls_view": "SELECT c_custkey FROM customer WHERE (c_nationkey IN (1, 2, 3) OR c_mktsegment LIKE 'B%') AND c_acctbal >= 0",
    "enum_order": "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1.0 ELSE 1.5 END AS place FROM orders WHERE o_orderstatus IN ('P', 'F')",
    "pivot_crosstab": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority",
    "win_groups": _S.format("count(*) OVER w AS n, max(l_orderkey) OVER w AS top") + " WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "win_exclude": _S.format("""CAST(sum(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS without_row,
        count(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS without_group,
        max(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS without_ties"""),
    "range_agg": """WITH r AS (SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL '90' DAY AS hi FROM orders),
        s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r),
        g AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT o_custkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY o_custkey, k""",
    "hypothetical_set": "SELECT s_nationkey, count(*) FILTER (WHERE s_acctbal < 3000) + 1 AS rank, count(DISTINCT s_acctbal) FILTER (WHERE s_acctbal < 3000) + 1 AS dense_rank, round(count(*) FILTER (WHERE s_acctbal < 3000) / count(*), 8) AS percent_rank, round((count(*) FILTER (WHERE s_acctbal <= 3000) + 1) / (count(*) + 1), 8) AS cume_dist FROM supplier GROUP BY s_nationkey",
    "join_asof_lookup": "SELECT r.request_id, max(p.xid) AS last_xid FROM (SELECT DISTINCT request_id, db_id, schema_xid FROM xid_request WHERE schema_xid IS NOT NULL) r LEFT JOIN xid_push p ON p.db_id = r.db_id AND p.xid <= r.schema_xid GROUP BY 1",
    "join_strategies": "SELECT h.how, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) AS h(how) GROUP BY 1, 2",
    "sorted_merge": "SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier ORDER BY k, src",
    "stream_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
_STREAM = """WITH c AS (SELECT event_id, event_id // 10 AS p, user_id, value, event_type FROM events WHERE user_id IS NOT NULL),
        k AS (SELECT *, CASE WHEN p % 5 = 0 THEN p + 1 ELSE p END AS top FROM c WHERE event_id % 11 <> 0),
        ok AS (SELECT *, top * 2 + 1000 AS xid FROM k WHERE p % 7 <> 0 AND top % 7 <> 0 AND top % 5 <> 0 AND top < {x} / 10 + 500 AND EXISTS (SELECT 1 FROM c t WHERE t.p = k.top) {cond}),
        l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY xid DESC, event_id DESC) AS rn FROM ok)
        SELECT user_id, value AS {name}, event_type {note} FROM l WHERE rn = 1 AND event_id % 3 <> 0"""
SQL |= {
    "stream_apply": _STREAM.format(x=X, cond="", name="amount", note=f", CASE WHEN event_id >= {X} THEN 'new' END AS note"),
    "stream_apply_asof": _STREAM.format(x=X, cond=f"AND top < {X // 10}", name="value", note=""),
    "table_stats": "SELECT 't' AS table_name, CAST(x AS BIGINT) AS xid, CAST(CASE x WHEN 10 THEN lo WHEN 20 THEN n ELSE n - neg END AS BIGINT) AS row_count FROM (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 5000) AS lo, count(*) FILTER (WHERE c_acctbal < 0) AS neg FROM customer) c, (VALUES (10), (20), (30), (40)) v(x)",
    "store_resync": "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'O'",
    "copy_out": "SELECT c_custkey || chr(9) || c_name || chr(9) || CASE WHEN c_mktsegment = 'BUILDING' THEN chr(92) || 'N' ELSE c_mktsegment END AS line FROM customer",
    "csv_load": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "prepared": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'P'",
    "register_tables": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "transaction_pin": "SELECT CAST(CASE v WHEN 2 THEN count(*) ELSE count(*) FILTER (WHERE n_nationkey < 10) END AS BIGINT) AS n, v AS step FROM nation, (VALUES (0), (1), (2)) t(v) GROUP BY v",
}
SQL["compaction_view"] = SQL["cdc_latest"]
QUERIES = {n: globals()[n] for n in SQL}
