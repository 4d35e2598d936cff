"""Schemas that drift between files: versions of a table's columns, renames found from values, one consistent table.

Between consecutive versions the columns that went and those that came are profiled over the keys that both files
hold: a value sketch (the least hash of key and value in each of BUCKETS buckets), type and name. Pairs whose sketches
share a bucket's minimum are candidates, and so are all pairs of columns with at most FEW values each, for which
sketches are unsure; a candidate counts as a rename if an exact count over all keys says that more
than half of the values agree. If candidates compete, a bipartite matching of greatest weight decides. No rename of two
columns of at most FEW values is missed. Else more than FEW / 2 keys agree, which is more than a third of all (key,
value): the two sketches miss it only if none of the minima of their union, of which over 100 buckets have one, is
shared, a chance below (2/3)^100 or 1e-17.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_known
from tidemark.operators.hierarchy import hierarchy
from tidemark.operators.skew import hot_keys, neighbours, salted_join
from tidemark.session import materialize

BUCKETS = 256
FEW = 256
HEAD = ["db_id", "schema_name", "table_name", "xid"]


def _dotted() -> Column:
    return F.concat(F.coalesce("schema_name", F.lit("")), F.lit("."), F.coalesce("table_name", F.lit("")))


def records(ddl: DataFrame) -> DataFrame:
    """Each record (tid, xid, lsn) once, as received last. Rows without one of the three are no records."""
    cols = [c for c in ("schema_name", "table_name", "ddl_columns") if c in ddl.columns]
    got = ddl.dropna(subset=["tid", "xid", "lsn"]).groupBy("db_id", "tid", "xid", "lsn", "op").agg(F.max_by(F.struct(*cols), F.struct("received_at")).alias("_b"))
    return got.select("db_id", "tid", "xid", "lsn", "op", "_b.*")


def name_timeline(rec: DataFrame) -> DataFrame:
    """Of each record the name its table had before (prev_name), the xid of the table's next record (next_xid) and the
    declaration in force (ver: xid, lsn)."""
    named = rec.drop("ddl_columns").withColumn("name", _dotted())
    return neighbours(
        named, ["tid"], ["xid", "lsn"],
        lag={"prev_name": F.col("name")}, lead={"next_xid": F.col("xid")},
        fill={"ver": F.when(F.col("op") == "create_table", F.struct("xid", "lsn"))},
    )


def versions(rec: DataFrame, types: DataFrame) -> DataFrame:
    """(tid, xid, lsn, key, cols, p_xid, p_lsn, p_cols): each declaration with the one before. cols: map of name to
    type, being the oid (or that of the type's name in the catalog; else the name in lower case)."""
    oid = types.select(F.lower(F.trim("type_name")).alias("t"), "type_oid").dropna().groupBy("t").agg(F.min("type_oid").alias("o"))
    c = rec.filter("op = 'create_table' and ddl_columns is not null").select("tid", "xid", "lsn", F.posexplode("ddl_columns").alias("i", "c"))
    c = c.filter("c.name is not null").withColumn("t", F.lower(F.trim("c.type_name")))
    # the catalog is fixed and small, but its size is left to the planner
    c = c.join(oid, "t", "left").withColumn("type", F.when(F.col("c.type_oid") != 0, F.col("c.type_oid").cast("string")).otherwise(F.coalesce(F.col("o").cast("string"), F.col("t"), F.lit(""))))
    v = c.groupBy("tid", "xid", "lsn").agg(F.sort_array(F.collect_list(F.struct("i", F.col("c.name").alias("name"), "type"))).alias("l"))
    v = v.select("tid", "xid", "lsn", F.expr("l[0].name").alias("key"), F.expr("map_from_entries(transform(filter(l, (x, i) -> not exists(slice(l, 1, i), y -> y.name = x.name)), x -> struct(x.name, x.type)))").alias("cols"))
    whole = F.struct("xid", "lsn", "key", "cols")
    return neighbours(v, ["tid"], ["xid", "lsn"], lag={"p": whole})


def heads(dump: DataFrame) -> DataFrame:
    """(db_id, schema_name, table_name, xid, _c) of each file: what it says of itself, and the number of its lines."""
    return materialize(dump.select(*HEAD).dropna().groupBy(*HEAD).agg(F.count(F.lit(1)).alias("_c")))


def file_versions(files: DataFrame, timeline: DataFrame) -> DataFrame:
    """(db_id, schema_name, table_name, xid, tid, v_xid, v_lsn) of each of the heads: the table that held the file's name
    at the end of its xid, and the declaration then in force. Files of no table are left out."""
    head = HEAD
    files = files.select(*head, F.lit(0).alias("_known"))
    held = timeline.withColumn("_known", F.lit(0))
    m = asof_known(files, held, head[:3], head, "xid", "_known", ["xid", "lsn"], "_known", ["tid", "op", "next_xid", "ver"])
    # a name that its table had given up by then belongs to nobody
    m = m.filter("match is not null and match.op <> 'drop_table' and match.ver is not null and (match.next_xid is null or match.next_xid > xid)")
    return materialize(m.select(*head, F.col("match.tid").alias("tid"), F.col("match.ver.xid").alias("v_xid"), F.col("match.ver.lsn").alias("v_lsn")))


def _best(w: np.ndarray) -> list[tuple[int, int]]:
    """The bipartite matching of greatest weight, by shortest augmenting paths over potentials."""
    n = max(w.shape)
    cost = np.zeros((n, n))
    cost[: w.shape[0], : w.shape[1]] = -w
    u, v, at = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        least, way, used, at[n], j0 = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool), i, n
        while at[j0] >= 0:
            used[j0] = True
            i0, free = at[j0], np.flatnonzero(~used[:n])
            cur = cost[i0, free] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]] = cur[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            for j in np.flatnonzero(used):
                u[at[j]] += delta
                v[j] -= delta
            least[~used[:n]] -= delta
            j0 = j1
        while j0 != n:
            at[j0], j0 = at[way[j0]], way[j0]
    return [(int(at[j]), j) for j in range(n) if at[j] < w.shape[0] and j < w.shape[1] and w[at[j], j] > 0]


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of versions: its edges that make up the best matching."""
    a, b = pdf["old_name"].astype("category"), pdf["new_name"].astype("category")
    w = np.zeros((len(a.cat.categories), len(b.cat.categories)))
    w[a.cat.codes, b.cat.codes] = pdf["weight"]
    kept = set(_best(w))
    return pdf[[(x, y) in kept for x, y in zip(a.cat.codes, b.cat.codes)]]


def renames(vers: DataFrame, dump: DataFrame, files: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(tid, xid, lsn, old_name, new_name) of each declaration with one before. hot: the files of many lines."""
    pair = ["tid", "xid", "lsn"]
    gone = F.expr("array_except(map_keys(p.cols), map_keys(cols))")
    came = F.expr("array_except(map_keys(cols), map_keys(p.cols))")
    open_ = vers.filter("p is not null").select(*pair, "p", "key", gone.alias("gone"), came.alias("came")).filter("size(gone) > 0 and size(came) > 0")
    sides = open_.select(*pair, F.col("p.xid").alias("v_xid"), F.col("p.lsn").alias("v_lsn"), F.lit(0).alias("side"), F.col("p.key").alias("key"), F.col("gone").alias("names")).unionByName(
        open_.select(*pair, F.col("xid").alias("v_xid"), F.col("lsn").alias("v_lsn"), F.lit(1).alias("side"), "key", F.col("came").alias("names"))
    )
    head = [*HEAD[:3], "f_xid"]
    f = files.withColumnRenamed("xid", "f_xid").join(sides, ["tid", "v_xid", "v_lsn"]).drop("v_xid", "v_lsn")
    lines = salted_join(dump.select(*head[:3], F.col("xid").alias("f_xid"), "line_no", "payload"), f, head, ["line_no", "payload"], hot=hot and hot.withColumnRenamed("xid", "f_xid"))
    m = F.from_json("payload", "map<string,string>")
    rows = lines.withColumn("_m", m).select(*pair, "side", F.expr("_m[key]").alias("k"), F.expr("transform(names, n -> _m[n])").alias("v")).filter("k is not null")
    # both files' rows of a key meet in one group; doubled lines are alike
    rows = rows.groupBy(*pair, "k").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("o"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("n")).filter("o is not null and n is not null")
    rows = materialize(rows)
    # sketches
    long = rows.select(*pair, "k", F.lit(0).alias("side"), F.posexplode("o").alias("i", "v")).unionByName(rows.select(*pair, "k", F.lit(1).alias("side"), F.posexplode("n").alias("i", "v")))
    long = long.filter("v is not null").select(*pair, "side", "i", F.xxhash64("k", F.lit(0), "v").alias("h"))
    sk = long.groupBy(*pair, "side", "i", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.min("h").alias("h"))
    s0, s1 = sk.filter("side = 0").select(*pair, "b", "h", F.col("i").alias("i")), sk.filter("side = 1").select(*pair, "b", "h", F.col("i").alias("j"))
    # a rename of columns with few values may share no minimum: of these, all pairs
    few = long.groupBy(*pair, "side", "i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FEW)
    few = few.groupBy(*pair).agg(F.expr("collect_list(i) filter (where side = 0)").alias("i"), F.expr("collect_list(i) filter (where side = 1)").alias("j"))
    few = few.select(*pair, F.explode(F.expr("flatten(transform(i, x -> transform(j, y -> struct(x as i, y as j))))")).alias("ij"))
    cand = s0.join(s1, [*pair, "b", "h"]).select(*pair, F.struct("i", "j").alias("ij")).unionByName(few).groupBy(*pair).agg(F.collect_set("ij").alias("cand"))
    # the exact count, for the candidates only; their number is bounded by the columns of one version squared
    e = salted_join(rows, cand, pair, ["k"]).select(*pair, F.explode(F.expr("transform(cand, c -> struct(c.i as i, c.j as j, o[c.i] as a, n[c.j] as b))")).alias("e"))
    e = e.groupBy(*pair, "e.i", "e.j").agg(F.count_if(F.expr("e.a is not null or e.b is not null")).alias("n"), F.count_if(F.expr("e.a = e.b")).alias("eq"))
    e = e.filter("2 * eq > n").join(open_.join(vers.select(*pair, "cols"), pair), pair)
    e = e.withColumn("old_name", F.expr("gone[i]")).withColumn("new_name", F.expr("came[j]"))
    near = 1 - F.levenshtein("old_name", "new_name") / F.greatest(F.length("old_name"), F.length("new_name"), F.lit(1))
    weight = F.col("eq") / F.col("n") + F.expr("if(p.cols[old_name] = cols[new_name], 0.01, 0)") + 0.001 * near
    e = e.select(*pair, "old_name", "new_name", weight.alias("weight"))
    rival = F.greatest(F.count(F.lit(1)).over(W.partitionBy(*pair, "old_name")), F.count(F.lit(1)).over(W.partitionBy(*pair, "new_name")))
    e = materialize(e.withColumn("r", rival))
    torn = e.filter("r > 1").select(*pair).distinct()
    calm = e.join(torn, pair, "left_anti").drop("r")
    fought = e.join(torn, pair, "left_semi").drop("r")
    return calm.unionByName(fought.groupBy(*pair).applyInPandas(_match, calm.schema)).select(*pair, "old_name", "new_name")


def _moves(vers: DataFrame, ren: DataFrame) -> DataFrame:
    """Each declaration with one before, with its renames as a map."""
    r = ren.groupBy("tid", "xid", "lsn").agg(F.map_from_entries(F.collect_list(F.struct("old_name", "new_name"))).alias("ren"))
    return vers.filter("p is not null").join(r, ["tid", "xid", "lsn"], "left").withColumn("ren", F.coalesce("ren", F.expr("cast(map() as map<string,string>)")))


def changes(ddl: DataFrame, dump: DataFrame, types: DataFrame) -> DataFrame:
    """(tid, xid, lsn, change_kind, old_name, new_name): added, removed, renamed and retyped columns of each
    declaration against the one before, and each table_renamed and schema_moved. No records: no rows; a declaration
    without a file has no evidence for renames, so its names are removed and added."""
    rec = materialize(records(ddl))
    tl = materialize(name_timeline(rec))
    vers = materialize(versions(rec, types))
    files = heads(dump)
    ren = renames(vers, dump, file_versions(files, tl), hot_keys(files, HEAD, n="_c"))
    one = lambda arr, kind, old, new: F.expr(f"transform({arr}, x -> struct('{kind}' as change_kind, {old} as old_name, {new} as new_name))")
    m = _moves(vers, ren).withColumn("gone", F.expr("array_except(map_keys(p.cols), map_keys(cols))")).withColumn("came", F.expr("array_except(map_keys(cols), map_keys(p.cols))"))
    m = m.withColumn("same", F.expr("concat(transform(array_intersect(map_keys(p.cols), map_keys(cols)), x -> struct(x as key, x as value)), map_entries(ren))"))
    ev = F.concat(
        one("array_except(gone, map_keys(ren))", "removed", "x", "''"),
        one("array_except(came, map_values(ren))", "added", "''", "x"),
        one("map_entries(ren)", "renamed", "x.key", "x.value"),
        one("filter(same, y -> p.cols[y.key] <> cols[y.value])", "retyped", "x.key", "x.value"),
    )
    cols = m.select("tid", "xid", "lsn", F.explode(ev).alias("e")).select("tid", "xid", "lsn", "e.*")
    names = tl.filter("op in ('rename_table', 'set_namespace') and prev_name <> name")
    kind = F.when(F.col("op") == "rename_table", "table_renamed").otherwise("schema_moved").alias("change_kind")
    return cols.unionByName(names.select("tid", "xid", "lsn", kind, F.col("prev_name").alias("old_name"), F.col("name").alias("new_name")))


def unified(ddl: DataFrame, dump: DataFrame, types: DataFrame) -> DataFrame:
    """(tid, file_xid, v_xid, v_lsn, row_key, columns): each line of a file of a known table, once, its fields under the
    last name that their column had. A column that is not in the table's last version is called name@xid of the last
    version that had it, so that a name that was given up and taken again stays two columns. Lines that are no JSON
    object, and files of no table, are left out."""
    rec = materialize(records(ddl))
    vers = materialize(versions(rec, types))
    files = heads(dump)
    held, hot = file_versions(files, materialize(name_timeline(rec))), hot_keys(files, HEAD, n="_c")
    ren = renames(vers, dump, held, hot)
    node = lambda n, x, l: F.concat_ws("@", n, x, l)
    m = _moves(vers, ren).withColumn("same", F.expr("concat(transform(array_intersect(map_keys(p.cols), map_keys(cols)), x -> struct(x as key, x as value)), map_entries(ren))"))
    links = m.select("tid", "xid", "lsn", "p", F.explode("same").alias("c")).select("tid", node(F.col("c.key"), F.col("p.xid"), F.col("p.lsn")).alias("child"), node(F.col("c.value"), F.col("xid"), F.col("lsn")).alias("parent"))
    every = vers.select("tid", "xid", "lsn", F.explode(F.map_keys("cols")).alias("name")).withColumn("node", node(F.col("name"), F.col("xid"), F.col("lsn")))
    last = vers.groupBy("tid").agg(F.max(F.struct("xid", "lsn")).alias("last"))
    ends = hierarchy(links, ["tid"], "child", "parent", every.select("tid", "node"))
    ends = ends.join(every.select("tid", F.col("node").alias("root"), F.col("name").alias("end_name"), F.struct("xid", "lsn").alias("end")), ["tid", "root"]).join(last, "tid")
    ends = ends.select("tid", "node", F.when(F.col("end") == F.col("last"), F.col("end_name")).otherwise(F.concat_ws("@", "end_name", F.col("end.xid"))).alias("to"))
    per = every.join(ends, ["tid", "node"]).groupBy("tid", "xid", "lsn").agg(F.map_from_entries(F.collect_list(F.struct("name", "to"))).alias("names"))
    per = per.join(vers.select("tid", "xid", "lsn", "key"), ["tid", "xid", "lsn"]).withColumnsRenamed({"xid": "v_xid", "lsn": "v_lsn"})
    f = held.join(per, ["tid", "v_xid", "v_lsn"])
    lines = salted_join(dump.select(*HEAD, "line_no", "payload"), f, HEAD, ["line_no", "payload"], hot=hot).withColumn("_m", F.from_json("payload", "map<string,string>")).filter("_m is not null")
    out = lines.select("tid", F.col("xid").alias("file_xid"), "v_xid", "v_lsn", F.expr("_m[key]").alias("row_key"), F.expr("array_sort(transform(filter(map_entries(_m), e -> e.value is not null), e -> struct(coalesce(names[e.key], if(array_contains(map_values(names), e.key), concat(e.key, '@undeclared'), e.key)) as key, e.value as value)))").alias("columns"))
    # a field that a line states twice counts once
    once = F.expr("filter(columns, (e, i) -> not exists(slice(columns, 1, i), y -> y.key = e.key))")
    return out.distinct().withColumn("columns", F.map_from_entries(once))
