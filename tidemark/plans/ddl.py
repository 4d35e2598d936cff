"""Catalog changes as SQL statements for query nodes."""

from __future__ import annotations

from collections.abc import Mapping


def q(*names: str) -> str:
    return ".".join('"' + n.replace('"', '""') + '"' for n in names)


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _column(c: Mapping) -> str:
    return f"{q(c['name'])} {c['type']}" + ("" if c.get("nullable", True) else " NOT NULL") + (f" DEFAULT {c['default']}" if c.get("default") else "")


def statements(op: str, r: Mapping) -> list[str]:
    """The statements of one operation; none where it changes nothing that is visible (resync, no_change).

    r: schema, table, and as the operation needs: columns, column, old_schema, old_table, old_name, new_name, nullable,
    parent, bound, partition_key, name, labels, value, before, after, enabled, forced, owner.
    """
    t = q(r["schema"], r["table"]) if r.get("table") else ""
    name = q(r["schema"], r["name"]) if r.get("name") and r.get("schema") else q(r["name"]) if r.get("name") else ""
    match op:
        case "create_table":
            tail = f" PARTITION BY {r['partition_key']}" if r.get("partition_key") else ""
            if r.get("parent"):
                return [f"CREATE TABLE {t} PARTITION OF {q(*r['parent'])} {r['bound']}{tail}"]
            return [f"CREATE TABLE {t} ({', '.join(map(_column, r.get('columns', ())))}){tail}"]
        case "drop_table":
            return [f"DROP TABLE IF EXISTS {t} CASCADE"]
        case "rename_table":
            return [f"ALTER TABLE {q(r['old_schema'], r['old_table'])} RENAME TO {q(r['table'])}"]
        case "set_namespace":
            return [f"ALTER TABLE {q(r['old_schema'], r['table'])} SET SCHEMA {q(r['schema'])}"]
        case "add_column":
            return [f"ALTER TABLE {t} ADD COLUMN {_column(r['column'])}"]
        case "drop_column":
            return [f"ALTER TABLE {t} DROP COLUMN {q(r['old_name'])}"]
        case "rename_column":
            return [f"ALTER TABLE {t} RENAME COLUMN {q(r['old_name'])} TO {q(r['new_name'])}"]
        case "set_nullable":
            return [f"ALTER TABLE {t} ALTER COLUMN {q(r['old_name'])} {'DROP' if r['nullable'] else 'SET'} NOT NULL"]
        case "create_namespace":
            return [f"CREATE SCHEMA IF NOT EXISTS {q(r['name'])}"]
        case "alter_namespace":
            return [f"ALTER SCHEMA {q(r['old_name'])} RENAME TO {q(r['name'])}"]
        case "drop_namespace":
            return [f"DROP SCHEMA IF EXISTS {q(r['name'])} CASCADE"]
        case "create_type":
            return [f"CREATE TYPE {name} AS ENUM ({', '.join(map(lit, r['labels']))})"]
        case "rename_type":
            return [f"ALTER TYPE {q(r['schema'], r['old_name'])} RENAME TO {q(r['name'])}"]
        case "rename_type_value":
            return [f"ALTER TYPE {name} RENAME VALUE {lit(r['old_name'])} TO {lit(r['new_name'])}"]
        case "add_type_value":
            at = f" BEFORE {lit(r['before'])}" if r.get("before") else f" AFTER {lit(r['after'])}" if r.get("after") else ""
            return [f"ALTER TYPE {name} ADD VALUE {lit(r['value'])}{at}"]
        case "drop_type":
            return [f"DROP TYPE IF EXISTS {name} CASCADE"]
        case "attach_partition":
            return [f"ALTER TABLE {q(*r['parent'])} ATTACH PARTITION {t} {r['bound']}"]
        case "detach_partition":
            return [f"ALTER TABLE {q(*r['parent'])} DETACH PARTITION {t}"]
        case "set_rls_enabled":
            return [f"ALTER TABLE {t} {'ENABLE' if r['enabled'] else 'DISABLE'} ROW LEVEL SECURITY"]
        case "set_rls_forced":
            return [f"ALTER TABLE {t} {'FORCE' if r['forced'] else 'NO FORCE'} ROW LEVEL SECURITY"]
        case "resync" | "no_change" | "resync_partitions":
            return []
    raise ValueError(f"the operation {op} is not known")
