from tidemark.operators.catalog import READY, ready_indexes, system_tables
from tidemark.plans.security import groups_of, policies_of
from tidemark.sources.files import read, scope


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, v string")
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert sorted(read(spark, kind, str(tmp_path / kind), "id int, v string").collect(), key=str) == sorted(df.collect(), key=str)
    df.write.option("header", "true").csv(str(tmp_path / "csv"))
    assert read(spark, "csv", str(tmp_path / "csv"), "id int, v string").filter("id = 1").first().v == "a,b"


def test_scope():
    all_ = [("a", "x"), ("a", "y"), ("b", "x")]
    assert scope(all_) == all_ and scope(all_, ["b"]) == [("b", "x")] and scope(all_, only=[("a", "y")]) == [("a", "y")]


def test_catalog_tables(spark, sf):
    got = system_tables(spark.read.parquet(f"{sf}/ddl_log.parquet"), spark.read.parquet(f"{sf}/column_history.parquet"))
    assert len(got) == 8 and got["table_names"].count() > 0 and got["indexes"].count() == 0
    ix = spark.createDataFrame([(1, 1, 1, 5, 0, "n", "i", 0, True), (1, 1, 1, 7, 0, "n", "i", READY, True), (1, 1, 1, 9, 0, "n", "i", 2, True)], got["index_names"].schema)
    assert [ready_indexes(ix, x).count() for x in (5, 8, 9)] == [0, 1, 0]


def test_roles_and_policies(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "role_oid bigint, member_oid bigint")
    assert groups_of(m, 3) == [1, 2] and groups_of(m, 1) == []
    p = spark.createDataFrame([("a", True, ["x"], "true"), ("b", None, None, None)], "policy_name string, policy_permissive boolean, policy_roles array<string>, policy_qual string")
    assert [x.name for x in policies_of(p)] == ["a", "b"] and not policies_of(p)[1].permissive
