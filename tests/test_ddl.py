import pytest

from tidemark.plans.ddl import statements


@pytest.mark.parametrize(
    "op,r,want",
    [
        ("create_table", {"schema": "s", "table": 't"x', "columns": [{"name": "id", "type": "int4", "nullable": False}, {"name": "v", "type": "text", "default": "'a'"}]}, 'CREATE TABLE "s"."t""x" ("id" int4 NOT NULL, "v" text DEFAULT \'a\')'),
        ("create_table", {"schema": "s", "table": "p1", "parent": ("s", "p"), "bound": "FOR VALUES IN (1)"}, 'CREATE TABLE "s"."p1" PARTITION OF "s"."p" FOR VALUES IN (1)'),
        ("rename_table", {"schema": "s", "table": "b", "old_schema": "s", "old_table": "a"}, 'ALTER TABLE "s"."a" RENAME TO "b"'),
        ("set_namespace", {"schema": "n", "table": "t", "old_schema": "o"}, 'ALTER TABLE "o"."t" SET SCHEMA "n"'),
        ("set_nullable", {"schema": "s", "table": "t", "old_name": "c", "nullable": False}, 'ALTER TABLE "s"."t" ALTER COLUMN "c" SET NOT NULL'),
        ("add_type_value", {"schema": "s", "name": "e", "value": "it's", "after": "x"}, "ALTER TYPE \"s\".\"e\" ADD VALUE 'it''s' AFTER 'x'"),
        ("detach_partition", {"schema": "s", "table": "t", "parent": ("s", "p")}, 'ALTER TABLE "s"."p" DETACH PARTITION "s"."t"'),
        ("set_rls_forced", {"schema": "s", "table": "t", "forced": True}, 'ALTER TABLE "s"."t" FORCE ROW LEVEL SECURITY'),
    ],
)
def test_statements(op, r, want):
    assert statements(op, r) == [want]


def test_others():
    assert statements("resync", {}) == []
    with pytest.raises(ValueError):
        statements("explode", {})
