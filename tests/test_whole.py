"""Queries over all rows of their tables, against brute force on small fixtures whose ids are not the smallest."""

import random

import pytest

from tidemark.plans import native, pipeline, relational


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with lineitem, and its rows: suppliers 5 to 25 and 40 to 60, of which 57 is hot."""
    r = random.Random(3)
    rows = [(i // 4, i % 4, r.choice([5, 19, 20, 25, 40, 57, 57, 57, 60]), float(r.randrange(1, 12))) for i in range(400)]
    d = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d, rows


def peers(rows, row):
    """The rows of row's supplier with their distance in peer groups."""
    own = [x for x in rows if x[2] == row[2]]
    at = {q: i for i, q in enumerate(sorted({x[3] for x in own}))}
    return [(x, at[x[3]] - at[row[3]]) for x in own]


def test_win_groups_whole(spark, lines):
    d, rows = lines
    want = set()
    for x in rows:
        f = [y[0] for y, k in peers(rows, x) if -2 <= k <= 1]
        want.add((*x, len(f), max(f)))
    got = native.QUERIES["win_groups"](spark, d).collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == want


def test_win_exclude_whole(spark, lines):
    d, rows = lines
    want = set()
    for x in rows:
        own = sorted((y for y in rows if y[2] == x[2]), key=lambda y: (y[3], y[0], y[1]))
        i = own.index(x)
        near = [y[0] for y in own[max(0, i - 2) : i] + own[i + 1 : i + 3]]
        others = [y[0] for y, k in peers(rows, x) if abs(k) == 1]
        want.add((*x, sum(near) if near else None, len(others), max([*others, x[0]])))
    got = native.QUERIES["win_exclude"](spark, d).collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == want


def test_win_range_whole(spark, lines):
    d, rows = lines
    want = {(*x[:2], sum(y[2] == x[2] and x[3] - 5 <= y[3] <= x[3] for y in rows)) for x in rows}
    got = relational.QUERIES["win_range"](spark, d).collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == want


@pytest.mark.parametrize("name", ["join_full", "join_full_anti"])
def test_join_full_whole(spark, tmp_path, name):
    """Whole tables with ids above 500, a hot key, null keys, customers without orders and orders without customers."""
    r = random.Random(5)
    cust = [(k, float(r.randrange(-500, 9000))) for k in range(700, 760)] + [(None, 1.0)]
    orders = [(k, r.choice([705, 705, None, *range(690, 770)]), float(r.randrange(400_000))) for k in range(5000, 5200)]
    spark.createDataFrame(cust, "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    on = [(c[0], o[0]) for c in cust for o in orders if c[0] is not None and c[0] == o[1] and o[2] > 40 * c[1]]
    alone = [(c[0], None) for c in cust if c[0] not in {x for x, _ in on}] + [(None, o[0]) for o in orders if o[0] not in {y for _, y in on}]
    want = alone + (on if name == "join_full" else [])
    got = [tuple(x) for x in relational.QUERIES[name](spark, str(tmp_path)).collect()]
    assert on and sorted(got, key=str) == sorted(want, key=str)


def test_with_ties_whole(spark, tmp_path):
    """The top quantities and their ties lie behind order 400."""
    rows = [(1000 + i, i % 3, float(50 if i % 20 == 0 else i % 50)) for i in range(300)] + [(i, 0, 49.0) for i in range(20)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(x) for x in relational.QUERIES["with_ties"](spark, str(tmp_path)).collect()}
    assert got == {x for x in rows if sum(y[2] > x[2] for y in rows) < 5} and len(got) == 15


def test_scan_reverse_whole(spark, tmp_path):
    keys = random.Random(6).sample(range(5000), 700)
    spark.createDataFrame([(k, k % 7) for k in keys], "o_orderkey bigint, o_custkey bigint").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    got = relational.QUERIES["scan_reverse"](spark, str(tmp_path)).collect()
    assert [tuple(x) for x in got] == [(k, k % 7) for k in sorted(keys, reverse=True)]


def reach(edges):
    """(ancestor, node): edges of the shortest way between them, of one at least."""
    up, out = {}, {}
    for n, a in edges:
        up.setdefault(n, set()).add(a)
    for n in up:
        front, k = {n}, 0
        while front:
            k += 1
            front = {a for x in front for a in up.get(x, ()) if (a, n) not in out}
            out.update({(a, n): k for a in front})
    return out


def test_p2_descendants_whole(spark, tmp_path):
    """All pairs, of nodes on, above and below cycles too: rings, loops, cycles that share nodes, several parents."""
    r = random.Random(7)
    drops, want = [], set()
    for db in range(25):
        n = r.randint(2, 12)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))]
        if db < 5:  # a ring of up to 21 nodes with chains above and below it
            m = 5 + 4 * db
            edges = [(i, (i + 1) % m) for i in range(m)] + [(0, 100), (100, 101), (200, 1), (201, 200)]
        drops += [(db, "drop_table", c, p) for c, p in edges]
        pairs = reach(edges)
        want |= {("table", str(db), a, x, k, (x, x) in pairs) for (a, x), k in pairs.items()}
    members = [("n1", 2, 3, 1), ("n1", 3, 2, 1), ("n1", 4, 3, 1), ("n1", 9, 8, 0)]
    spark.createDataFrame(drops + drops[:9], "db_id int, op string, tid bigint, parent_table_id bigint").write.parquet(f"{tmp_path}/ddl_log.parquet")
    spark.createDataFrame(members, "fdw_id string, member_oid bigint, role_oid bigint, snapshot_time int").write.parquet(f"{tmp_path}/role_member_snapshot_history.parquet")
    pairs = reach([(2, 3), (3, 2), (4, 3)])
    want |= {("role", "n1", a, x, k, (x, x) in pairs) for (a, x), k in pairs.items()}
    got = [tuple(x) for x in pipeline.QUERIES["p2_descendants"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_tablesample(spark, tmp_path):
    """About a tenth of the rows, each at most once, the same again for the same seed."""
    spark.range(20_000).selectExpr("id as o_orderkey", "id % 7 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda: sorted(r.o_orderkey for r in relational.QUERIES["tablesample"](spark, str(tmp_path)).collect())
    got = run()
    assert 1700 < len(got) < 2300 and len(set(got)) == len(got) and got == run()


def test_offset_ties(spark, tmp_path):
    """Behind three rows, four more and those that tie with the last."""
    sizes = [9, 8, 8, 8, 7, 7, 6, 6, 6, 5, 5, 1]
    spark.createDataFrame(list(enumerate(sizes)), "p_partkey int, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.p_size for r in relational.QUERIES["offset_ties"](spark, str(tmp_path)).collect()) == [6, 6, 6, 7, 7, 8]
