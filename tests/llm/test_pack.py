import random

import pytest

from tidemark.llm import pack as P


def test_fill_is_best():
    rnd = random.Random(2)
    for _ in range(200):
        room = rnd.randint(1, 40)
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 5))}
        sums = {0}
        for z, n in counts.items():
            sums = {s + k * z for s in sums for k in range(n + 1)}
        got = P.fill(room, sorted(counts, reverse=True), counts)
        assert all(k <= counts[z] for z, k in got.items())
        assert sum(z * k for z, k in got.items()) == max(s for s in sums if s <= room)


def check(spark, sizes, cap, **kw):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    rows = P.pack(df, "doc_id", cap, **kw).collect()
    used = {}
    per = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.token_end))
        assert r.n_tokens == r.token_end - r.token_start
    assert max(used.values()) <= cap
    assert sorted(used) == list(range(len(used)))
    for i, z in enumerate(sizes):
        p = sorted(per[i])
        assert p[0][1] == 0 and p[-1][2] == (z or 0) and all(a[2] == b[1] for a, b in zip(p, p[1:]))
        assert len(p) == max(1, -(-(z or 0) // cap))
    return used


def test_all_items_whole(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([rnd.randint(0, 30), 7, 7, rnd.randint(0, 400), None]) for _ in range(600)]
    used = check(spark, sizes, 100)
    assert len(used) <= -(-sum(z or 0 for z in sizes) // 100) + 1


def test_plan_too_large_to_send(spark):
    rnd = random.Random(4)
    sizes = [rnd.randint(0, 60) for _ in range(300)]
    assert check(spark, sizes, 50, send=0) == check(spark, sizes, 50)


def test_hot_size(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 20)
    used = check(spark, [9] * 200 + [1] * 50 + [0] * 100, 10)
    assert len(used) == 200


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert P.pack(df, "doc_id", 10).count() == 0
    assert check(spark, [0, None, 0], 10) == {0: 0}
    with pytest.raises(ValueError):
        P.pack(df, "doc_id", 0)
