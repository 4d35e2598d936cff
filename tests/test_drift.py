import json

import numpy as np

from tidemark.operators import drift

COL = "array<struct<name string, type_oid bigint, type_name string, type_namespace string, nullable boolean, default_value string>>"
DDL = f"log_id bigint, db_id bigint, xid bigint, lsn bigint, op string, tid bigint, schema_name string, table_name string, ddl_columns {COL}, received_at timestamp_ntz, extra string"
DUMP = "file_id bigint, db_id bigint, schema_name string, table_name string, xid bigint, line_no int, payload string, received_at timestamp_ntz"


def c(name, oid=25, kind="text"):
    return (name, oid, kind, "pg_catalog", True, None)


def frames(spark, ddl, dump):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(i, 1, *x, t, "x") for i, x in enumerate(ddl)], DDL)
    f = spark.createDataFrame([(1, 1, s, n, x, i, p if isinstance(p, (str, type(None))) else json.dumps(p), t) for s, n, x, ps in dump for i, p in enumerate(ps)], DUMP)
    k = spark.createDataFrame([("text", 25), ("int4", 23), ("INTEGER", 23)], "type_name string, type_oid bigint")
    return d, f, k


DDLS = [
    (10, 1, "create_table", 7, "public", "t", [c("id", 23), c("a"), c("b"), c("n", 0, "Integer"), c("gone")]),
    (10, 1, "create_table", 7, "public", "t", [c("id", 23), c("a"), c("b"), c("n", 0, "Integer"), c("gone")]),
    (15, 1, "rename_table", 7, "public", "u", None),
    (16, 1, "create_table", 8, "public", "t", [c("id", 23)]),
    (20, 1, "create_table", 7, "public", "u", [c("id", 23), c("b2", 23), c("a"), c("n", 23), c("new")]),
    (25, 1, "set_namespace", 7, "arch", "u", None),
    (26, 1, "set_namespace", 7, "arch", "u", None),
    (30, 1, "create_table", 7, "arch", "u", [c("id", 23), c("b3", 23), c("a"), c("n", 23), c("gone")]),
    (40, 1, "drop_table", 7, "arch", "u", None),
]
DUMPS = [
    ("public", "t", 12, [{"id": 1, "a": "x", "b": "5", "n": 1, "gone": None}, {"id": 2, "a": "y", "b": "6", "n": 2}, {"id": 3, "a": "z", "b": "9", "n": 2, "gone": "q"}, {"id": 1, "a": "x", "b": "5", "n": 1, "gone": None}, "not json", None]),
    ("public", "t", 17, [{"id": 99}]),
    ("public", "u", 22, [{"id": 1, "b2": 5, "a": "x", "n": 1, "new": "w"}, {"id": 2, "b2": 6, "a": "y", "new": "v"}, {"id": 9, "b2": 1}]),
    ("arch", "u", 33, [{"id": 1, "b3": 5, "a": "x", "n": 1}, {"id": 9, "b3": 1, "gone": "g"}]),
    ("arch", "u", 44, [{"id": 1}]),
]


def test_changes(spark):
    got = {(x.tid, x.xid, x.change_kind, x.old_name, x.new_name) for x in drift.changes(*frames(spark, DDLS, DUMPS)).collect()}
    assert got == {
        (7, 15, "table_renamed", "public.t", "public.u"), (7, 25, "schema_moved", "public.u", "arch.u"),
        (7, 20, "renamed", "b", "b2"), (7, 20, "retyped", "b", "b2"), (7, 20, "removed", "gone", ""), (7, 20, "added", "", "new"),
        (7, 30, "renamed", "b2", "b3"), (7, 30, "removed", "new", ""), (7, 30, "added", "", "gone"),
    }


def test_unified(spark):
    rows = drift.unified(*frames(spark, DDLS, DUMPS)).collect()
    by = {(x.tid, x.file_xid, x.row_key): x.columns for x in rows if x.row_key}
    assert by[7, 12, "1"] == {"id": "1", "a": "x", "b3": "5", "n": "1"} and by[7, 12, "3"]["gone@10"] == "q"
    assert by[7, 22, "1"] == {"id": "1", "a": "x", "b3": "5", "n": "1", "new@20": "w"} and by[7, 33, "9"] == {"id": "9", "b3": "1", "gone": "g"}
    assert by[8, 17, "99"] == {"id": "99"} and (7, 44, "1") not in by
    assert len(rows) == 3 + 1 + 3 + 2


def test_undeclared(spark):
    """A field that no declaration names stays beside the column that ends under its name."""
    ddl = [(1, 1, "create_table", 7, "p", "t", [c("id", 23), c("a")]), (5, 1, "create_table", 7, "p", "t", [c("id", 23), c("b")])]
    dump = [("p", "t", 2, [{"id": i, "a": str(i), "b": "other", "z": "free"} for i in range(4)]), ("p", "t", 6, [{"id": i, "b": str(i)} for i in range(4)])]
    got = {(x.file_xid, x.row_key): x.columns for x in drift.unified(*frames(spark, ddl, dump)).collect()}
    assert got[2, "3"] == {"id": "3", "b": "3", "b@undeclared": "other", "z": "free"} and got[6, "3"] == {"id": "3", "b": "3"}


def test_small_renames_are_not_missed(spark):
    """Files of 2 to 7 keys of which just more than half agree."""
    import random

    r, ddl, dump, want = random.Random(9), [], [], set()
    for tid in range(1500):
        n = r.randint(2, 7)
        same = r.randint(n // 2 + 1, n)
        ddl += [(10 * tid, 1, "create_table", tid, "p", f"t{tid}", [c("id", 23), c("old")]), (10 * tid + 5, 1, "create_table", tid, "p", f"t{tid}", [c("id", 23), c("new")])]
        dump += [("p", f"t{tid}", 10 * tid + 1, [{"id": i, "old": f"{tid}-{i}"} for i in range(n)]), ("p", f"t{tid}", 10 * tid + 6, [{"id": i, "new": f"{tid}-{i}" if i < same else "else"} for i in range(n)])]
        want.add((tid, "renamed", "old", "new"))
    assert {(x.tid, x.change_kind, x.old_name, x.new_name) for x in drift.changes(*frames(spark, ddl, dump)).collect()} == want


def test_empty(spark):
    d, f, k = frames(spark, DDLS, DUMPS)
    assert drift.changes(d.limit(0), f, k).count() == 0 and drift.unified(d, f.limit(0), k).count() == 0
    assert {x.change_kind for x in drift.changes(d, f.limit(0), k.limit(0)).filter("xid = 30").collect()} == {"added", "removed"}


def test_best_matching():
    assert sorted(drift._best(np.array([[0.9, 0.8], [0.85, 0.0]]))) == [(0, 1), (1, 0)]
    assert drift._best(np.array([[0.6, 0.9, 0.0]])) == [(0, 1)]
    r = np.random.default_rng(1)
    import itertools

    for _ in range(60):
        w = np.where(r.random((3, 4)) < 0.6, r.random((3, 4)), 0)
        best = max(sum(w[i, p[i]] for i in range(3)) for p in itertools.permutations(range(4), 3))
        assert abs(sum(w[i, j] for i, j in drift._best(w)) - best) < 1e-9


def test_rivals(spark):
    """Two new columns hold the old one's values: the greater agreement wins, the other is new."""
    ddl = [(1, 1, "create_table", 7, "p", "t", [c("id", 23), c("a"), c("x")]), (5, 1, "create_table", 7, "p", "t", [c("id", 23), c("b"), c("y")])]
    one = [{"id": i, "a": str(i), "x": "k"} for i in range(10)]
    two = [{"id": i, "b": str(i) if i < 7 else "-", "y": str(i)} for i in range(10)]
    got = {(x.change_kind, x.old_name, x.new_name) for x in drift.changes(*frames(spark, ddl, [("p", "t", 2, one), ("p", "t", 6, two)])).collect()}
    assert got == {("renamed", "a", "y"), ("added", "", "b"), ("removed", "x", "")}


def test_renames_of_few_values(spark):
    """Three keys of which two agree, all values in one bucket, where the old file's third value has the least hash."""
    rows = spark.sql(f"select k, v, h from (select k, v, xxhash64(k, 0, v) as h from (select cast(x as string) as k, cast(id as string) as v from range(6000) lateral view explode(array(1, 2, 3)) e as x)) where pmod(h, {drift.BUCKETS}) = 0").collect()
    by = {k: sorted((x.h, x.v) for x in rows if x.k == k) for k in "123"}
    (h3, o3), n3 = by["3"][0], "other"
    a, b = (next(v for h, v in by[k] if h > h3) for k in "12")
    ddl = [(10, 1, "create_table", 7, "public", "t", [c("id", 23), c("old")]), (20, 1, "create_table", 7, "public", "t", [c("id", 23), c("new")])]
    dump = [("public", "t", x, [{"id": i, n: v} for i, v in enumerate(vs, 1)]) for x, n, vs in ((12, "old", (a, b, o3)), (22, "new", (a, b, n3)))]
    got = {(x.tid, x.xid, x.change_kind, x.old_name, x.new_name) for x in drift.changes(*frames(spark, ddl, dump)).collect()}
    assert got == {(7, 20, "renamed", "old", "new")}
