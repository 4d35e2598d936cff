import pytest

from tidemark.engine import Engine
from tidemark.plans import dialect
from tidemark.plans.classify import READ, SESSION, UNSUPPORTED, WRITE, classify, split
from tidemark.plans.security import Policy, predicate, secured


@pytest.fixture(scope="module")
def eng(spark):
    t = spark.createDataFrame([(1, "abc", 5.5, [1, 2]), (2, None, -1.0, []), (3, "A_c", None, None)], "id int, s string, x double, arr array<int>")
    return Engine(spark, {"t": t})


ONE = [
    ("7 / 2", 3), ("7 / 2.0", 3.5), ("-7 / 2", -3), ("2 ^ 3", 8), ("5 # 3", 6), ("'a' || 'b'", "ab"), ("'it''s'", "it's"), (r"'a\d'", r"a\d"), ("$$x'y$$", "x'y"), (r"E'a\nb'", "a\nb"),
    ("'abc' ~ '^a'", True), ("'ABC' ~* '^a'", True), ("'abc' !~ 'z'", True), ("'abc' SIMILAR TO '%(b|z)%'", True), ("'abc' SIMILAR TO 'b'", False), ("'abc' ~~ 'a%'", True), (r"'a cat' ~ '\mcat\M'", True),
    ("'12'::int4 + 1", 13), ("CAST('2.5' AS numeric(4,1))::text", "2.5"), ("(ARRAY[1,2,3])[2]", 2), ("(ARRAY[1,2,3])[9]", None), ("3 = ANY (ARRAY[1,3])", True), ("ARRAY[1,2] @> ARRAY[2]", True), ("ARRAY[1,2] && ARRAY[5]", False),
    ("ROW(1,'b') < ROW(1,'c')", True), ("ROW(2,1) <= ROW(1,9)", False), ("concat('a', NULL, 'b')", "ab"), ("left('abcdef', -2)", "abcd"), ("right('abcdef', -2)", "cdef"), ("substr('abc', 0, 2)", "a"), ("substring('abcdef' from 2 for 3)", "bcd"),
    ("regexp_replace('aXbX', 'X', '-')", "a-bX"), ("regexp_replace('aXbX', 'x', '-', 'gi')", "a-b-"), ("split_part('a,b,c', ',', 2)", "b"), ("array_to_string(string_to_array('a.b.c', '.'), '|')", "a|b|c"), ("initcap('hello world')", "Hello World"),
    ("quote_literal('a''b')", "'a''b'"), ("quote_ident('Ab')", '"Ab"'), ("to_hex(255)", "ff"), ("md5('a')", "0cc175b9c0f1b6a831c399e269772661"), ("translate('abc','ab','x')", "xc"), ("log(100)", 2.0), ("trunc(-2.567, 1)::float8", -2.5), ("gcd(12, 18)", 6), ("lcm(4, 6)", 12),
    ("div(7, 2)", 3), ("num_nulls(1, NULL, 2)", 1), ("round(erf(1.0), 6)", 0.842701), ("extract(dow FROM DATE '2024-01-07')", 0), ("extract(isodow FROM DATE '2024-01-07')", 7), ("to_char(TIMESTAMP '2024-03-05 14:07:09', 'YYYY/MM/DD HH24:MI')", "2024/03/05 14:07"),
    ("age(TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2022-01-15 00:00:00')", "2 years 1 mon 15 days"), ("'{\"a\": {\"b\": [1, 2]}}' -> 'a' ->> 'b'", "[1,2]"), ("json_array_length('[1,2,3]')", 3), ("jsonb_set('{\"a\": 1}', '{b}', '2')", '{"a": 1, "b": 2}'), ("json_typeof('[1]')", "array"),
    ("jsonb_contains('{\"a\": 1, \"b\": [1, 2]}', '{\"b\": [2]}')", True), ("jsonb_path_query_first('{\"a\": [{\"x\": 1}, {\"x\": 5}]}', '$.a[*] ? (@.x > 2)')", '{"x": 5}'), ("jsonb_delete('{\"a\": 1, \"b\": 2}', 'a')", '{"b": 2}'), ("jsonb_concat('{\"a\": 1}', '{\"b\": 2}')", '{"a": 1, "b": 2}'),
    ("range_overlaps(int4range(1, 5), int4range(4, 9))", True), ("range_overlaps(int4range(1, 4), int4range(4, 9))", False), ("range_contains_elem(int4range(1, 5, '[]'), 5)", True), ("range_adjacent(numrange(1, 2), numrange(2, 3))", True), ("isempty(int4range(3, 3))", True), ("range_contains(int4range(1, 9), int4range(2, 9))", True),
    ("point_distance(point(0, 0), point(3, 4))", 5.0), ("circle_contain_pt(circle(point(0, 0), 2), point(1, 1))", True), ("area(box(point(0, 0), point(2, 3)))", 6.0), ("masklen('10.0.0.0/8')", 8), ("network_sub('10.1.0.0/16', '10.0.0.0/8')", True), ("host('10.1.2.3/24')", "10.1.2.3"),
    ("ts_match_vq(to_tsvector('The quick brown fox'), 'quick & !dog')", True), ("int4pl(2, 3)", 5), ("float8larger(1.5, 2.5)::float8", 2.5), ("btint4cmp(1, 2)", -1), ("textlike('abc', 'a%')", True), ("xml_is_well_formed('<a/>')", True),
    ("cube_distance(cube(ARRAY[0,0]), cube(ARRAY[3,4]))", 5.0), ("(akeys(hstore('a', 'b')))[1]", "a"), ("round(similarity('word', 'two words')::float8, 6)", 0.363636), ("int4out(5)", "5"), ("hashtext('a') = hashtext('a')", True),
    ("box_left(box(point(0,0), point(1,1)), box(point(2,0), point(3,1)))", True), ("circle_lt(circle(point(0,0), 1), circle(point(5,5), 2))", True), ("circle_contain(circle(point(0,0), 3), circle(point(1,0), 1))", True), ("lseg_perp(lseg(point(0,0), point(1,0)), lseg(point(0,0), point(0,2)))", True),
    ("multirange_contains_elem(int4multirange(int4range(1, 3), int4range(5, 7)), 6)", True), ("multirange_contains_elem(int4multirange(int4range(1, 3), int4range(5, 7)), 3)", False), ("date_eq_timestamp(DATE '2024-01-02', TIMESTAMP '2024-01-02 00:00:00')", True), ("to_char(date_pli(DATE '2024-01-02', 3), 'YYYY-MM-DD')", "2024-01-05"),
    ("nameeqtext('a', 'a')", True), ("text_pattern_lt('a', 'b')", True), ("cash_mul_int4(2.50, 2)::float8", 5.0), ("int4in('17')", 17), ("texticregexeq('ABC', 'b')", True), ("numeric_power(2.0, 3.0)::float8", 8.0), ("ts_match_tt('a quick fox', tsquery_and('quick', 'fox'))", True),
    ("array_position(ARRAY[1,2], 9)", None), ("array_remove(ARRAY[1,2,1], 1)[1]", 2), ("width_bucket(5.35, 0.024, 10.06, 5)", 3), ("btrim('xxaxx', 'x')", "a"), ("position('b' in 'abc')", 2), ("overlay('abcdef' placing 'ZZ' from 3 for 2)", "abZZef"),
]


def test_expressions(eng):
    cases = ONE
    row = eng.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(cases))).first()
    for (e, v), got in zip(cases, row):
        assert got == v or (isinstance(v, float) and abs(float(got) - v) < 1e-9), e


def test_clauses(eng):
    ids = lambda q: [r[0] for r in eng.sql(q).collect()]
    assert ids("SELECT id FROM t ORDER BY s") == [3, 1, 2] and ids("SELECT id FROM t ORDER BY x DESC") == [3, 1, 2] and ids("SELECT id FROM t ORDER BY x NULLS FIRST") == [3, 2, 1]
    assert ids("SELECT DISTINCT ON (x > 0) id FROM t ORDER BY x > 0, id DESC") and ids("SELECT id FROM t WHERE (x > 0) IS NOT TRUE ORDER BY id") == [2, 3]
    assert ids("SELECT id FROM t ORDER BY id FETCH FIRST 2 ROWS ONLY") == [1, 2] and sorted(ids("SELECT id FROM (SELECT id, 1 AS k FROM t) u ORDER BY k FETCH FIRST 1 ROW WITH TIES")) == [1, 2, 3]
    assert ids("SELECT id FROM t WHERE id > ALL (SELECT 1 UNION ALL SELECT 2)") == [3] and ids("SELECT count(*) FROM t WHERE id <> ALL (SELECT 1)") == [2]
    assert ids("SELECT string_agg(s, ',' ORDER BY s DESC) FROM t") == ["abc,A_c"] and ids("SELECT array_agg(s ORDER BY id DESC) FROM t") == [["A_c", None, "abc"]]
    assert ids("SELECT x FROM generate_series(1, 3) AS g(x)") == [1, 2, 3] and ids("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 2) % 7 FROM r) SELECT n FROM r ORDER BY n") == [1, 2, 4]
    assert [r[0] for r in eng.sql("SELECT id FROM t WHERE id = $1 AND s ~ $2", 1, "a").collect()] == [1]


def test_sessions(eng):
    eng.sql("PREPARE p (int) AS SELECT id, s FROM t WHERE id >= $1 ORDER BY id")
    assert [r.id for r in eng.sql("EXECUTE p(2)").collect()] == [2, 3]
    eng.sql("DEALLOCATE p")
    eng.cursor("c", "SELECT id FROM t ORDER BY id")
    assert [r.id for r in eng.fetch("c", 2)] == [1, 2] and [r.id for r in eng.fetch("c", 5)] == [3]
    eng.close("c")
    assert "Scan" in " ".join(r.plan for r in eng.sql("EXPLAIN SELECT * FROM t").collect())
    with pytest.raises(dialect.Unsupported):
        eng.sql("INSERT INTO t VALUES (1)")


def test_copy_out(eng):
    assert [r.line for r in eng.sql("COPY (SELECT id, s FROM t ORDER BY id) TO STDOUT").collect()] == ["1\tabc", "2\t\\N", "3\tA_c"]
    assert [r.line for r in eng.sql("COPY t (id, s) TO STDOUT WITH (FORMAT csv)").collect()][0] == "1,abc"


def test_pin(spark, eng):
    eng.pin(lambda n, x: spark.createDataFrame([(x,)], "v int"), ["pinned"], 7)
    assert eng.sql("SELECT v FROM pinned").first().v == 7


@pytest.mark.parametrize(
    "sql,kind",
    [
        ("SELECT 1", READ), ("select * from a join b using (id)", READ), ("WITH x AS (SELECT 1) SELECT * FROM x", READ), ("VALUES (1)", READ), ("EXPLAIN SELECT 1", READ), ("COPY (SELECT 1) TO STDOUT", READ), ("TABLE t", READ),
        ("INSERT INTO t VALUES (1)", WRITE), ("UPDATE t SET a = 1", WRITE), ("DELETE FROM t", WRITE), ("MERGE INTO t USING u ON true WHEN MATCHED THEN DELETE", WRITE), ("CREATE TABLE x (a int)", WRITE), ("SELECT * INTO n FROM t", WRITE), ("SELECT * FROM t FOR UPDATE", WRITE), ("COPY t FROM STDIN", WRITE), ("EXPLAIN DELETE FROM t", WRITE),
        ("WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", WRITE), ("BEGIN", SESSION), ("SET search_path = a", SESSION), ("SET session_replication_role = x", UNSUPPORTED), ("BEGIN ISOLATION LEVEL SERIALIZABLE", UNSUPPORTED),
        ("SELECT nextval('s')", UNSUPPORTED), ("SELECT pg_sleep(1)", UNSUPPORTED), ("SELECT * FROM pg_catalog.pg_class", UNSUPPORTED), ("SELECT * FROM information_schema.tables", UNSUPPORTED), ("SELECT (1", UNSUPPORTED), ("", UNSUPPORTED), ("SELECT 'delete from t; x'", READ), ("SELECT 1; DROP TABLE t", WRITE),
    ],
)
def test_classify(sql, kind):
    assert classify(sql).kind == kind


def test_classify_tables():
    s = classify("SELECT f(a) FROM x.t1 JOIN t2 ON true WHERE EXISTS (SELECT 1 FROM t3)", extra=None)
    assert s.tables == {"x.t1", "t2", "t3"} and "f" in s.functions
    assert classify("SELECT * FROM other", known={"t"}).kind == UNSUPPORTED and classify("SELECT my_fn(1)", extra=set()).kind == UNSUPPORTED
    assert split("SELECT ';'; SELECT 2;") == ["SELECT ';'", "SELECT 2"]


def test_policies(spark):
    df = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, None)], "id int, owner string")
    pol = [Policy("own", True, ["staff"], "(owner = CURRENT_USER)"), Policy("low", False, [], "id < 3")]
    see = lambda role, **k: sorted(r.id for r in secured(df, pol, role, **k).collect())
    assert see("ann", groups=["staff"]) == [1] and see("ann") == [] and see("ann", bypass=True) == [1, 2, 3] and see("ann", enabled=False) == [1, 2, 3]
    assert see("o", owner="o") == [1, 2, 3] and see("o", owner="o", forced=True) == []
    assert predicate([Policy("all")], "x") == "(true)"


@pytest.fixture(scope="module")
def wide(spark):
    t = spark.createDataFrame([(1, "abc", 5.5, 10), (2, None, -1.0, 10), (3, "A_c", None, 20), (4, "A_c", 2.0, 20)], "id int, s string, x double, k int")
    return Engine(spark, {"w": t, "graph": spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (4, 5), (5, 1)], "f int, t int")})


def test_whole_division(wide):
    got = wide.sql("SELECT 9007199254740993 / 1 AS a, -7 / 2 AS b, 7 / 2 * 2 AS c, 10 / 3 / 2 AS d, 7.0 / 2 AS e, 7 / 2.5 AS f").first()
    assert tuple(got)[:4] == (9007199254740993, -3, 6, 1) and float(got.e) == 3.5 and float(got.f) == 2.8
    assert [tuple(r) for r in wide.sql("SELECT id / 2, x / 2, sum(id) / count(*) FROM w WHERE id IN (1, 4) GROUP BY id, x ORDER BY id").collect()] == [(0, 2.75, 1), (2, 1.0, 4)]


def test_ordered_aggregates(wide):
    got = wide.sql("SELECT array_agg(DISTINCT k ORDER BY k DESC) AS a, array_agg(id ORDER BY k DESC, id) AS b, jsonb_agg(DISTINCT k ORDER BY k) AS c, array_agg(s ORDER BY s NULLS FIRST, id DESC) AS d FROM w").first()
    assert tuple(got) == ([20, 10], [3, 4, 1, 2], "[10,20]", [None, "A_c", "A_c", "abc"])
    got = wide.sql("SELECT k, rank(2) WITHIN GROUP (ORDER BY id) AS r, dense_rank(2) WITHIN GROUP (ORDER BY id DESC) AS d, percent_rank(2) WITHIN GROUP (ORDER BY id) AS p, round(cume_dist(2) WITHIN GROUP (ORDER BY id), 4) AS c FROM w GROUP BY k ORDER BY k").collect()
    assert [tuple(r) for r in got] == [(10, 2, 1, 0.5, 1.0), (20, 1, 3, 0.0, 0.3333)]
    got = wide.sql("SELECT range_agg(int4range(id, id + 1)) AS r, range_intersect_agg(int4range(id, 9)) AS i, cardinality(range_agg(int4range(id * 3, id * 3 + 1))) AS n FROM w").first()
    assert [tuple(x)[:2] for x in got.r] == [(1, 5)] and tuple(got.i) == (4, 9, True, False) and got.n == 4


def test_frames_in_text(wide):
    run = lambda q: [tuple(r) for r in wide.sql(q).collect()]
    q = "SELECT id, sum(id) OVER v AS a, count(*) OVER v AS n, first_value(id) OVER v AS f, avg(x) OVER v AS m FROM w WINDOW v AS (ORDER BY k GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING EXCLUDE TIES) ORDER BY id"
    assert [r[:4] for r in run(q)] == [(1, 8, 3, 1), (2, 9, 3, 2), (3, 6, 3, 1), (4, 7, 3, 1)]
    q = "SELECT u.id, max(id) OVER (ORDER BY k RANGE BETWEEN 10 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS m, array_agg(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS l FROM w AS u ORDER BY u.id"
    assert run(q) == [(1, None, [2]), (2, None, [1, 3]), (3, 2, [2, 4]), (4, 2, [3])]
    with pytest.raises(dialect.Unsupported):
        wide.sql("SELECT k, count(*) OVER (ORDER BY k GROUPS 1 PRECEDING) FROM w GROUP BY k")


def test_recursion(wide):
    run = lambda q: [tuple(r) for r in wide.sql(q).collect()]
    assert run("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 300) SELECT max(n) FROM r") == [(300,)]
    got = run("WITH RECURSIVE g(f, t) AS (SELECT * FROM graph x UNION ALL SELECT x.* FROM graph x, g WHERE x.f = g.t) CYCLE f, t SET is_cycle USING path SELECT f, t, is_cycle, cardinality(path) FROM g")
    assert len(got) == 25 and {x[:3] for x in got} >= {(1, 2, False), (1, 4, True)}
    step = "SELECT x.f, x.t FROM graph x, g s WHERE x.f = s.t AND x.f < x.t"
    assert run(f"WITH RECURSIVE g(f, t) AS (SELECT f, t FROM graph WHERE f = 1 UNION ALL {step}) SEARCH DEPTH FIRST BY f, t SET seq SELECT f, t FROM g ORDER BY seq") == [(1, 2), (2, 3), (1, 3), (1, 4), (4, 5)]
    assert run(f"WITH RECURSIVE g(f, t) AS (SELECT f, t FROM graph WHERE f = 1 UNION ALL {step}) SEARCH BREADTH FIRST BY f, t SET seq SELECT f, t FROM g ORDER BY seq") == [(1, 2), (1, 3), (1, 4), (2, 3), (4, 5)]
    assert run("SELECT a, b, n FROM ROWS FROM (generate_series(1, 3), unnest(ARRAY['x', 'y'])) WITH ORDINALITY AS z(a, b, n)") == [(1, "x", 1), (2, "y", 2), (3, None, 3)]
    assert run("SELECT B'101', substring('foobar' from 'o.b'), substring('foobar' from 'o(.)b'), substring('foobar' from 'z')") == [("101", "oob", "o", None)]


def test_engines_do_not_disturb_each_other(spark):
    a, b = (Engine(spark, {"same": spark.createDataFrame([(v,)], "v int")}) for v in (1, 2))
    assert [e.sql("SELECT v FROM same").first().v for e in (a, b, a)] == [1, 2, 1]


def test_pin_never_goes_back(spark, wide):
    e = Engine(spark)
    read = lambda n, x: spark.createDataFrame([(x,)], "v int")
    e.pin(read, ["held"], 9)
    with pytest.raises(dialect.Unsupported):
        e.pin(read, ["held"], 8)


def test_errors_are_errors(wide):
    with pytest.raises(Exception, match="JSONDecodeError|Expecting value"):
        wide.sql("SELECT jsonb_set('nonsense', '{b}', '2')").collect()
