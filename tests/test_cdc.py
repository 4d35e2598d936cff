import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cdc
from tidemark.sources.store import Store
from tidemark.streaming.apply import MESSAGE, Applier, start, windowed_counts

LOG = "op string, xid bigint, lsn bigint, k int, a int, b string, _undef array<string>"


def random_log(seed, n=250):
    r = random.Random(seed)
    out = []
    for i in range(n):
        op = r.choices("IUDT", [3, 5, 2, 0.03])[0]
        undef = r.choice([None, None, ["a"], ["b"], ["a", "b"]]) if op == "U" else None
        out.append((op, i // 3, i % 3, None if op == "T" else r.choice([None, *range(9)]), r.choice([None, i]), r.choice([None, str(i)]), undef))
    return out


def replay(log, as_of=10**9):
    rows = {}
    for op, xid, _, k, a, b, undef in log:
        if xid > as_of:
            break
        if op == "T":
            rows.clear()
        elif op == "D":
            rows.pop(k, None)
        else:
            old = rows.get(k, (None, None))
            u = undef or ()
            rows[k] = (old[0] if "a" in u else a, old[1] if "b" in u else b)
    return {(k, *v) for k, v in rows.items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_like_replay(spark, seed):
    log = random_log(seed)
    shuffled = list(log)
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, LOG)
    assert {tuple(x) for x in cdc.fold(df, ["k"], ["a", "b"]).collect()} == replay(log)
    assert {tuple(x) for x in cdc.fold(df, ["k"], ["a", "b"], 40).collect()} == replay(log, 40)
    assert {tuple(x) for x in cdc.fold(cdc.compact(df, ["k"], ["a", "b"], 40), ["k"], ["a", "b"]).collect()} == replay(log)


def test_fold_empty(spark):
    df = spark.createDataFrame([], LOG)
    assert cdc.fold(df, ["k"], ["a"]).count() == 0


def test_no_key(spark):
    rows = [("I", 1, i, "x") for i in range(3)] + [("D", 2, 0, "x"), ("I", 2, 1, None), ("I", 2, 2, None), ("D", 3, 0, None)]
    df = spark.createDataFrame(rows, "op string, xid bigint, lsn bigint, v string")
    assert sorted((tuple(x) for x in cdc.fold_no_key(df, ["v"]).collect()), key=str) == [("x",), ("x",), (None,)]
    with_t = df.unionByName(spark.createDataFrame([("T", 2, 1, None)], df.schema))
    assert cdc.fold_no_key(with_t, ["v"]).count() == 0


def test_transactions(spark):
    ch = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "pg_xid bigint, lsn bigint")
    tx = spark.createDataFrame([(1, None, "commit", 10), (2, 1, None, None), (3, 1, "abort", None), (4, None, "abort", None)], "pg_xid bigint, top_xid bigint, status string, commit_xid bigint")
    assert {tuple(x) for x in cdc.committed(ch, tx).select("pg_xid", "xid").collect()} == {(1, 10), (2, 10)}


def test_copy_visibility(spark):
    ch = spark.createDataFrame([(x,) for x in (5, 10, 12, 15, 20, 25)], "pg_xid bigint")
    assert {x.pg_xid for x in cdc.after_copy(ch, 10, 20, [12]).collect()} == {12, 20, 25}


def test_store(spark, tmp_path):
    st = Store(spark, str(tmp_path / "st"))
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    st.copy("t", base, ["k"], 5)
    st.copy("nokey", base.select("v"), [], 6)
    log = spark.createDataFrame([("U", 7, 0, 1, "A"), ("D", 7, 1, 2, None), ("I", 8, 0, 4, "d"), ("U", 4, 0, 3, "old")], "op string, xid bigint, lsn bigint, k int, v string")
    assert st.apply({"t": log, "unknown": log, "nokey": log.filter("op = 'I'").drop("k")}, 8)
    assert not st.apply({"t": log}, 8)
    rows = lambda *a: {tuple(x) for x in st.read("t", *a).collect()}
    assert rows() == {(1, "A"), (3, "c"), (4, "d")} and rows(6) == {(1, "a"), (2, "b"), (3, "c")}
    assert sorted(x.v for x in st.read("nokey").collect()) == ["a", "b", "c", "d"]
    st.compact("t", 9)
    assert rows() == {(1, "A"), (3, "c"), (4, "d")} and st.tables() == ["nokey", "t"] and st.tables(5) == ["t"]
    before = rows(6)
    gone = st.vacuum(9)
    assert gone and rows() == {(1, "A"), (3, "c"), (4, "d")} and before
    assert st.register(include=["t"]) == 9 and spark.table("t").count() == 3
    st.drop("t", 10)
    with pytest.raises(KeyError):
        st.read("t")


def test_stream(spark, tmp_path):
    st = Store(spark, str(tmp_path / "st"))
    st.copy("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], 1)
    src = tmp_path / "in"
    os.makedirs(src)

    def put(name, *ms):
        with open(src / name, "w") as f:
            f.writelines(json.dumps(dict(zip(MESSAGE.names, (*m, *[None] * (10 - len(m)))))) + "\n" for m in ms)

    ch = lambda px, lsn, op, row, top=None, undef=None, schema="public": ("change", px, top, lsn, schema, "t", op, None, json.dumps(row), undef)
    put("1.json", ch(100, 1, "U", {"k": 1, "v": "A"}), ch(101, 2, "I", {"k": 3, "v": "c"}), ch(102, 3, "D", {"k": 2}, top=101), ch(103, 4, "I", {"k": 9, "v": "no"}), ch(104, 4, "I", {"k": 8, "v": "other"}, schema="private"))
    ap = Applier(st, {"t": T.StructType.fromDDL("k int, v string")}, ["public"])
    run = lambda: start(spark, str(src), ap, str(tmp_path / "cp")).awaitTermination()
    run()
    assert st.committed() == 1
    put("2.json", ("commit", 100, None, 5, None, None, None, 20), ("abort", 102, 101, 6), ("abort", 103, None, 7), ("commit", 104, None, 7, None, None, None, 19))
    run()
    rows = lambda: {tuple(x) for x in st.read("t").collect()}
    assert st.committed() == 20 and rows() == {(1, "A"), (2, "b")}
    put("3.json", ch(105, 8, "U", {"k": 1}, undef=["v"]), ("commit", 105, None, 9, None, None, None, 21), ("commit", 101, None, 9, None, None, None, 22))
    run()
    assert rows() == {(1, "A"), (2, "b"), (3, "c")}
    run()
    assert st.committed() == 22


def test_windowed_counts_streaming(spark, tmp_path, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    s = windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "ts", "event_type", "1 hour", "1 day")
    q = s.writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("wc").collect(), key=str) == sorted(windowed_counts(ev, "ts", "event_type", "1 hour", "1 day").collect(), key=str)
