import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, catalog, forest, skew, windows
from tidemark.operators.asof import asof_known
from tidemark.operators.hierarchy import hierarchy
from tidemark.operators.orphans import event_orphans, snapshot_orphans
from tidemark.operators.snapshot_diff import as_set, snapshot_changes, squeeze


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


@pytest.mark.parametrize("rows", [20, 10_000])
def test_asof_against_brute_force(spark, rows):
    r = random.Random(rows)
    keys = ["hot"] * 6 + ["a", "b", None]
    vers = [(r.choice(keys), r.choice([None, *range(60)]), r.randrange(3), r.choice([None, day(r.randrange(80))]), i, "x") for i in range(600)]
    evs = [(i % 900, r.choice(keys), r.choice([None, *range(-2, 62)]), r.choice([None, day(r.randrange(-3, 90))]), "y") for i in range(900)]
    v = spark.createDataFrame(vers, "k string, xid int, lsn int, seen timestamp_ntz, vid int, _pos string")
    e = spark.createDataFrame(evs + evs[:50], "id int, k string, at int, known timestamp_ntz, vid string")
    got = {x.id: x.match.vid if x.match else None for x in asof_known(e, v, ["k"], ["id"], "at", "known", ["xid", "lsn"], "seen", ["vid"], rows).collect()}
    assert len(got) == 900
    for i, k, at, known, _ in evs:
        ok = [(x[1], x[2], x[3], x[4]) for x in vers if k is not None and x[0] == k and None not in (x[1], x[3], at, known) and x[1] <= at and x[3] <= known]
        if not ok:
            assert got[i] is None
        else:  # ties in order and time are the same version
            assert max(ok)[:3] == next((x[1], x[2], x[3]) for x in vers if x[4] == got[i])


def test_asof_empty(spark):
    v = spark.createDataFrame([], "k string, xid int, seen int")
    e = spark.createDataFrame([(1, "a", 5, 5)], "id int, k string, at int, known int")
    assert asof_known(e, v, ["k"], ["id"], "at", "known", ["xid"], "seen", []).first().match is None
    assert asof_known(e.limit(0), v, ["k"], ["id"], "at", "known", ["xid"], "seen", []).count() == 0


@pytest.mark.parametrize("rows", [15, 10_000])
def test_neighbours(spark, rows):
    r = random.Random(1)
    data = [(r.choice("hhhhab"), i // 2, i, r.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, x int, l int, v int")
    got = skew.neighbours(df, ["k"], ["x", "l"], lag={"p": F.col("v")}, lead={"n": F.col("l")}, fill={"f": F.col("v")}, rows=rows)
    by = {}
    for x in sorted(data, key=lambda x: (x[1], x[2])):
        by.setdefault(x[0], []).append(x)
    want = set()
    for k, xs in by.items():
        f = None
        for i, x in enumerate(xs):
            f = x[3] if x[3] is not None else f
            want.add((k, x[2], xs[i - 1][3] if i else None, xs[i + 1][2] if i + 1 < len(xs) else None, f))
    assert {(x.k, x.l, x.p, x.n, x.f) for x in got.collect()} == want


def test_salted_join(spark):
    big = spark.createDataFrame([("h" if i % 3 else str(i % 7), i) for i in range(500)], "k string, i int")
    small = spark.createDataFrame([("h", 1), ("h", 2), ("0", 3), ("9", 4)], "k string, j int")
    a = skew.salted_join(big, small, ["k"], ["i"], rows=50)
    assert sorted(a.collect()) == sorted(big.join(small, "k").collect())


@pytest.mark.parametrize("listed", [1 << 16, 100])
def test_many_hot_keys(spark, monkeypatch, listed):
    """5,000 hot keys and one that holds a third: the same rows however many keys are listed, and balanced tasks."""
    monkeypatch.setattr(skew, "KEYS", listed)
    big = spark.range(75_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"), "id")
    small = big.select("k").distinct().withColumn("j", F.col("k") * 2)
    got = skew.salted_join(big, small, ["k"], ["id"], rows=5)
    assert got.agg(F.count("*"), F.sum("id"), F.sum("j")).first() == big.join(small, "k").agg(F.count("*"), F.sum("id"), F.sum("j")).first()
    hot = skew.hot_keys(big, ["k"], 5)
    assert hot.count() == min(listed, 5001) and hot.filter("k = -1").first()["_parts"] == 5000
    parts = hot.withColumn("each", F.col("_n") / F.col("_parts"))
    assert parts.agg(F.max("each")).first()[0] <= 6
    ev = spark.range(20_000).select((F.col("id") % 500).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 9973).alias("at"), F.col("id").alias("seen"))
    ver = spark.range(20_000).select((F.col("id") % 500).alias("k"), (F.col("id") * 5 % 9973).alias("xid"), (F.col("id") * 3 % 20_000).alias("seen"))
    run = lambda rows: sorted((r.i, r.match.xid if r.match else -1) for r in asof_known(ev, ver, ["k"], ["i"], "at", "seen", ["xid"], "seen", [], rows).collect())
    assert run(10) == run(10**6)


def test_merger_streams(monkeypatch):
    """Batches of any size give what one batch gives, and events are not held."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    n = 4000
    g, pos, ev = np.sort(r.integers(0, 3, n)), r.integers(0, 900, n), (r.random(n) < 0.7).astype(np.int32)
    o = np.lexsort((ev, pos, g))
    g, pos, ev = g[o], pos[o], ev[o]
    t = pa.table({"k": g, "_event": ev, "_known": r.integers(0, 1000, n), "_left": np.where(ev == 1, np.arange(n), -1), "_right": np.where(ev == 0, np.arange(n), -1)})
    out = lambda size: pa.Table.from_batches(asof._merger(["k"])(iter(t.to_batches(max_chunksize=size)))).to_pydict()
    want = out(n)
    monkeypatch.setattr(asof, "STEP", 1)
    assert out(7) == want and out(333) == want and len(want["_left"]) == int(ev.sum())


def test_hot_snapshots(spark, monkeypatch):
    """Where the snapshots are too many to be sent, they are joined with salts."""
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "h").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("s"), F.timestamp_seconds(F.col("id") % 7).alias("t"), (F.col("id") % 90).alias("k"), (F.col("id") % 11).alias("v"), F.timestamp_seconds("id").alias("g"))
    run = lambda: sorted(map(tuple, snapshot_changes(d, "s", "k", "t", "g", [F.col("v")], rows=20).collect()))
    c, p = d.select(F.col("s").alias("scope"), F.col("k").alias("record_id"), F.col("v").alias("ref_id"), F.col("t").alias("at")), d.select(F.col("s").alias("scope"), F.col("k").alias("key"), F.col("t").alias("at"))
    orph = lambda: sorted(map(tuple, snapshot_orphans(c, p, rows=20).collect()))
    a, b = run(), orph()
    monkeypatch.setattr(skew, "SENT", 3)
    assert a and b and run() == a and orph() == b


def brute_tree(edges, nodes):
    up = {}
    for n, a in edges:
        if a is not None and n is not None:
            up.setdefault(n, set()).add(a)
    ns = {x for e in edges for x in e if x is not None} | set(nodes)
    dist = {}
    for n in ns:
        d, front, k = {}, {n}, 0
        while front:
            k += 1
            front = {a for x in front for a in up.get(x, ())} - d.keys()
            d.update(dict.fromkeys(front, k))
        dist[n] = d
    out = set()
    for n in ns:
        if n in dist[n]:
            out.add((n, None, -1))
            continue
        rs = [(a, k) for a, k in dist[n].items() if a not in up]
        if n not in up:
            rs = [(n, 0)]
        out |= {(n, a, k) for a, k in rs} or {(n, None, -2)}
    return out


def test_hierarchy_against_brute_force(spark):
    r = random.Random(4)
    all_edges, want = [], set()
    for s in range(40):
        n = r.randint(1, 14)
        if s < 15:  # trees
            edges = [(i, r.randrange(i) if i and r.random() < 0.9 else None) for i in range(n)]
        elif s < 20:  # long chains and rings
            edges = [(i, i - 1) for i in range(1, 40)] + ([(0, 39)] if s % 2 else [])
        else:  # anything
            edges = [(r.randrange(n), r.choice([None, r.randrange(n), r.randrange(n)])) for _ in range(r.randint(1, 2 * n))]
        edges += edges[:2] + [(None, 3)] * (s % 2)
        all_edges += [(f"s{s}", a, b, "x") for a, b in edges]
        want |= {(f"s{s}", *x) for x in brute_tree(edges, [])}
    df = spark.createDataFrame(all_edges, "scope string, c int, p int, node string")
    got = hierarchy(df, ["scope"], "c", "p").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    for some, rows in ((["s3", "s15", "s16", "s24", "s31", "s37"], 50_000), (["s4", "s17", "s30"], 9)):  # by joins; salted, and both ways
        got = hierarchy(df.filter(F.col("scope").isin(some)), ["scope"], "c", "p", rows=rows, local=0 if rows > 9 else 12).collect()
        assert {tuple(x) for x in got} == {x for x in want if x[0] in some}
    paths = hierarchy(df, ["scope"], "c", "p", paths=True).filter("depth >= 0").collect()
    have = {(s, a, b) for s, a, b, _ in all_edges}
    assert {(x.scope, x.node, x.root, x.depth) for x in paths} == {x for x in want if x[3] >= 0}
    for x in paths:
        p = [int(y) for y in x.path.split("/")]
        assert p[0] == x.root and p[-1] == x.node and len(p) == x.depth + 1
        assert all((x.scope, c, a) in have for a, c in zip(p, p[1:]))
    every = hierarchy(df.filter("scope = 's3'"), ["scope"], "c", "p", every_ancestor=True).collect()
    assert {x.node for x in every if x.depth == 0} == {y for e in all_edges if e[0] == "s3" for y in e[1:3] if y is not None}


def test_forest_against_brute_force():
    """The solver of whole scopes: any graph, rings with ways in and out, blocks in which cycles share nodes."""
    import numpy as np

    r = random.Random(1)
    for i in range(1500):
        n = r.randint(1, 14)
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, int((0.5 + 2 * r.random()) * n)))}
        if i % 3 == 0:
            edges = {(k, (k + 1) % n) for k in range(n)} | {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 3))}
        e = np.array(sorted(edges), np.int64).reshape(-1, 2)
        got = {(a, None if b < 0 else b, d) for a, b, d in zip(*(v.tolist() for v in forest.roots(e[:, 0], e[:, 1], n)))}
        assert got == brute_tree(sorted(edges), range(n)), sorted(edges)


def test_forest_stays_linear():
    """A block of 3,000 nodes and 24,000 links on cycles beside a chain of 200,000 in the same scope."""
    import numpy as np

    k = np.arange(1, 200_000)
    b = np.unique(np.random.default_rng(0).integers(0, 3000, (24_000, 2)), axis=0) + 200_000
    x, t, d = forest.roots(np.r_[k, b[:, 0]], np.r_[k - 1, b[:, 1]], 203_000)
    assert len(x) == 203_000 and d.max() == 199_999 and (d[x >= 200_000] < 0).all()


def test_block_beside_a_chain(spark, monkeypatch):
    """By joins: a cyclic block's pointers are not multiplied while a chain of the same scope resolves."""
    from tidemark.operators import hierarchy as h

    r = random.Random(2)
    block = {(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(2400)}
    df = spark.createDataFrame([("s", i, i - 1) for i in range(1, 200)] + [("s", *e) for e in block], "scope string, c int, p int")
    most, was = [0], h.materialize

    def counted(x):
        y = was(x)
        most[0] = max(most[0], y.count())
        return y

    monkeypatch.setattr(h, "materialize", counted)
    got = h.hierarchy(df, ["scope"], "c", "p", local=0).collect()
    assert {(x.node, x.depth) for x in got if x.node < 1000} == {(i, i) for i in range(200)} and all(x.depth < 0 for x in got if x.node >= 1000)
    assert most[0] <= 4 * (200 + 2400)


def test_hierarchy_edges(spark):
    e = spark.createDataFrame([], "s string, c int, p int")
    assert hierarchy(e, ["s"], "c", "p").count() == 0
    only = spark.createDataFrame([("a", 7)], "s string, node int")
    assert [tuple(x) for x in hierarchy(e, ["s"], "c", "p", only).collect()] == [("a", 7, 7, 0)]
    loop = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), (None, 5, 6)], "s string, c int, p int")
    assert {tuple(x) for x in hierarchy(loop, ["s"], "c", "p").collect()} == {("a", 1, None, -1), ("a", 2, None, -2)}


def test_snapshot_changes(spark):
    r = random.Random(2)
    rows, final = [], {}
    for s in "abc":
        for t in range(7):
            for k in range(12):
                if r.random() < 0.6:
                    for d in range(r.choice([1, 1, 2])):
                        v, conf, q = r.choice([None, 1, 2]), r.choice([None, [], ["x", "y"], ["y", "x", "x"], [None]]), r.choice([None, "", "a  b", " a\tb\n", "ab"])
                        rows.append((s, day(t), k, v, conf, q, day(t * 10 + d)))
                        final[s, t, k] = (v, frozenset(conf or ()), None if q is None else " ".join(q.split()))
    rows += rows[:20] + [(None, day(1), 1, 1, None, None, day(1)), ("a", day(1), None, 1, None, None, day(1))]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, k int, v int, conf array<string>, q string, ing timestamp_ntz").withColumn("_ord", F.lit("clash"))
    got = {(x.s, x.k, x.t, x.change_kind) for x in snapshot_changes(df, "s", "k", "t", "ing", [F.col("v"), as_set("conf"), squeeze("q")]).collect()}
    want = set()
    for s in "abc":
        ts = sorted({t for x, t, _ in final if x == s} | ({1} if s == "a" else set()))
        for a, b in zip(ts, ts[1:]):
            for k in range(12):
                o, n = final.get((s, a, k)), final.get((s, b, k))
                if o != n:
                    want.add((s, k, day(b), "added" if o is None else "removed" if n is None else "changed"))
    assert got == want
    assert snapshot_changes(df.limit(0), "s", "k", "t", "ing", [F.col("v")]).count() == 0


def test_snapshot_orphans(spark):
    r = random.Random(8)
    kids = [(r.choice("ab"), r.randrange(9), r.choice([None, *range(6)]), day(r.randrange(8))) for _ in range(200)]
    par = [(r.choice("ab"), r.randrange(5), day(r.choice([1, 2, 4, 6]))) for _ in range(25)]
    c = spark.createDataFrame(kids + kids[:9] + [(None, 1, 1, day(1))], "scope string, record_id int, ref_id int, at timestamp_ntz").withColumn("key", F.lit("clash"))
    p = spark.createDataFrame(par + [(None, 1, day(1)), ("a", None, day(1))], "scope string, key int, at timestamp_ntz")
    want = set()
    for s, i, ref, t in kids:
        ts = sorted({x[2] for x in par if x[0] == s})
        now = [x for x in ts if x <= t]
        if ref is None or (now and (s, ref, now[-1]) in set(par)):
            continue
        at = [x[2] for x in par if x[:2] == (s, ref)]
        want.add((s, i, ref, t, "deleted" if any(x < t for x in at) else "later" if at else "missing"))
    assert {tuple(x) for x in snapshot_orphans(c, p).collect()} == want
    assert snapshot_orphans(c.limit(0), p).count() == 0 and snapshot_orphans(c, p.limit(0)).filter("ref_status <> 'missing'").count() == 0


def test_event_orphans(spark):
    ev = [("a", 1, "create", 5, 0), ("a", 1, "drop", 9, 0), ("a", 1, "create", 12, 0), ("a", 2, "create", 5, 1)]
    kids = [("a", 10, 1, 4, 9), ("a", 11, 1, 7, 0), ("a", 12, 1, 9, 1), ("a", 13, 2, 5, 0), ("b", 14, 2, 5, 0), ("a", 15, None, 1, 1)]
    c = spark.createDataFrame([(*k, day(1)) for k in kids], "scope string, record_id int, ref_id int, xid bigint, lsn bigint, at timestamp_ntz")
    e = spark.createDataFrame(ev, "scope string, key int, kind string, xid bigint, lsn bigint")
    assert {(x.record_id, x.ref_status) for x in event_orphans(c, e).collect()} == {(10, "later"), (12, "deleted"), (13, "later"), (14, "missing")}


def test_range_agg(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 4, 6), ("a", 8, 9), ("a", 8, 12), ("a", 3, 3), ("b", 5, 7), (None, 1, 2), ("b", None, 9)], "k string, lo int, hi int")
    assert {tuple(x) for x in windows.range_agg(df, ["k"], "lo", "hi").collect()} == {("a", 1, 6), ("a", 8, 12), ("b", 5, 7)}


def test_catalog(spark):
    old = {1: ("id", "int", False), 2: ("a", "int", True), 4: ("c", "text", True)}
    new = {1: ("id", "bigint", False), 4: ("d", "text", False), 5: ("e", "int", True)}
    assert catalog.diff(old, new) == [(1, catalog.RESYNC), (2, catalog.REMOVED), (4, catalog.RENAMED), (4, catalog.NULLABLE), (5, catalog.NEW)]
    df = spark.createDataFrame([(1, 2, "x")], "id int, a int, c string")
    assert [tuple(x) for x in catalog.project(df, {1: "id", 2: "a", 4: "c"}, {1: ("id", "bigint"), 4: ("d", "string"), 5: ("e", "int")}).collect()] == [(1, "x", None)]
    assert catalog.leaves_of(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4)], "tid int, parent int"), 1) == [3, 5]
    lab = catalog.enum_add({"lo": 1.0, "hi": 2.0}, "mid", after="lo")
    assert sorted(lab, key=lab.get) == ["lo", "mid", "hi"]
    cols = spark.createDataFrame([(1, False, None, "base", "pg_catalog"), (2, True, None, "base", "pg_catalog"), (3, False, "de_DE", "base", "pg_catalog"), (4, False, None, "E", "other")], "tid int, generated boolean, collation string, type_category string, type_schema string")
    assert {x.tid for x in catalog.valid_table(cols, ["public"]).collect()} == {2, 3, 4}
