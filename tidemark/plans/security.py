"""Row-level security as predicates in views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import hierarchy
from tidemark.plans.dialect import lex, quote, show, tree
from tidemark.plans.dialect import expr as rewrite


@dataclass
class Policy:
    """One policy of a table. roles: empty or public for all; qual: PostgreSQL text, None for no restriction."""

    name: str
    permissive: bool = True
    roles: Sequence[str] = ()
    qual: str | None = None


def predicate(policies: Sequence[Policy], role: str, groups: Sequence[str] = ()) -> str:
    """What a role may see, as a Spark SQL condition: any of the permissive policies that hold for it or one of its
    groups, and all of the restrictive ones. Without a permissive policy: nothing."""
    mine = {role, *groups}
    on = [p for p in policies if not p.roles or "public" in p.roles or mine & set(p.roles)]

    def text(p: Policy) -> str:
        if p.qual is None:
            return "true"
        toks = [("str", quote(role)) if k == "id" and t.lower() in ("current_user", "session_user", "current_role") else (k, t) for k, t in lex(p.qual)]
        return "(" + show(rewrite(tree(toks))) + ")"

    allow, also = [text(p) for p in on if p.permissive], [text(p) for p in on if not p.permissive]
    return " AND ".join([f"({' OR '.join(allow)})" if allow else "false", *also])


def secured(df: DataFrame, policies: Sequence[Policy], role: str, groups: Sequence[str] = (), enabled: bool = True, forced: bool = False, owner: str | None = None, bypass: bool = False) -> DataFrame:
    """The rows of df that a role sees. Security that is not enabled, a role that bypasses it, and the owner unless it is
    forced, see all. A row for which the condition is unknown is not seen."""
    if not enabled or bypass or (role == owner and not forced):
        return df
    return df.filter(F.expr(predicate(policies, role, groups)))


def policies_of(snapshot: DataFrame) -> list[Policy]:
    """The policies of one table from the rows of one snapshot: a handful."""
    return [Policy(r.policy_name, bool(r.policy_permissive), tuple(r.policy_roles or ()), r.policy_qual) for r in snapshot.select("policy_name", "policy_permissive", "policy_roles", "policy_qual").collect()]


def groups_of(members: DataFrame, role: int) -> list[int]:
    """All groups that a role belongs to, through others too; (role_oid, member_oid) of one query node's snapshot.
    A role on a cycle belongs to the groups of the cycle as PostgreSQL forbids them: none are followed."""
    up = hierarchy(members.select(F.lit(0).alias("_s"), "member_oid", "role_oid"), ["_s"], "member_oid", "role_oid", every_ancestor=True)
    return sorted(r.root for r in up.filter((F.col("node") == role) & (F.col("depth") > 0)).select("root").distinct().collect())
