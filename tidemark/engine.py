"""The SQL front: statements in, DataFrames out, all tables as of one transaction."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import udfs
from tidemark.plans import classify, dialect
from tidemark.session import materialize
from tidemark.sources.tables import load


class Engine:
    """Answers PostgreSQL-flavoured reads by Catalyst plans over registered tables."""

    _owner: dict[tuple[int, str], Engine] = {}

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.prepared, self.cursors, self.tables = spark, {}, {}, {}
        self.store = self.xid = None
        # a recursion ends when it brings no more rows, not at a level
        for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
            spark.conf.set(limit, "-1")
        if not spark.catalog.functionExists("tm_gcd"):
            udfs.register(spark)
        for n, df in (tables or {}).items():
            self.register(n, df)

    @classmethod
    def over(cls, spark: SparkSession, folder: str, *names: str) -> Engine:
        return cls(spark, {n: load(spark, folder, n) for n in names})

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        Engine._owner[id(self.spark), name] = self

    def _views(self) -> None:
        """Views are the session's: another engine may have taken a name meanwhile."""
        for n, df in self.tables.items():
            if Engine._owner.get((id(self.spark), n)) is not self:
                self.register(n, df)

    def pin(self, read: Callable[[str, int], DataFrame], names: list[str], xid: int) -> None:
        """All tables as of one transaction id: what a transaction sees from its first statement on. The id never goes
        back: an earlier one than the last is no longer answered."""
        if self.xid is not None and xid < self.xid:
            raise dialect.Unsupported(f"transaction {xid} lies before {self.xid}, which was read already")
        self.xid = xid
        for n in names:
            self.register(n, read(n, xid))

    def attach(self, store: object) -> None:
        """Reads come from a store: outside a transaction each statement sees the last commit; BEGIN pins the one that is
        the last then for all statements up to COMMIT or ROLLBACK."""
        self.store, self._pinned = store, False

    def _fresh(self) -> None:
        if self.store is not None and not self._pinned:
            xid = self.store.committed()
            if xid != self.xid:
                for n in self.tables.keys() - set(self.store.tables(xid)):
                    self.tables.pop(n)
                    self.spark.catalog.dropTempView(n)
                self.pin(self.store.read, self.store.tables(xid), xid)

    def _run(self, text: str, args: dict | None = None) -> DataFrame:
        """The statement in Spark's terms. Which divisions are of whole numbers is known from the types of their operands,
        so each that is refused is taken for one of other numbers."""
        self._views()
        other: frozenset[int] = frozenset()
        while True:
            sql = dialect.to_spark(text, other, lambda t: self.spark.table(t).columns)
            try:
                return self.spark.sql(sql, args=args)
            except AnalysisException as e:
                # the expression that was refused, whose own division comes last
                said = re.search(r'DATATYPE_MISMATCH.*?Cannot resolve "(.*?)" due to', str(e), re.S)
                bad = [int(m[1]) for m in dialect.DIVISION.finditer(said[1])] if said else []
                if not bad or bad[-1] in other:
                    raise
                other |= {bad[-1]}

    def sql(self, text: str, *args: object) -> DataFrame:
        """One read, with $1 ... bound to args."""
        kind = classify.classify(text)
        if kind.kind not in (classify.READ, classify.SESSION):
            raise dialect.Unsupported(f"{kind.kind}: {kind.why}")
        word = text.split(None, 1)[0].lower()
        if self.store is not None:
            if word in ("begin", "start"):
                self._fresh()
                self._pinned = True
            elif word in ("commit", "end", "rollback", "abort") and not re.search(r"\bto\b", text, re.I):
                self._pinned = False
            elif kind.kind == classify.READ:
                self._fresh()
        if word == "prepare":
            m = re.match(r"prepare\s+(\w+)\s*(?:\([^)]*\))?\s+as\s+(.*)", text, re.I | re.S)
            self.prepared[m[1].lower()] = m[2].rstrip().rstrip(";")
            return self.spark.createDataFrame([("PREPARE",)], "status string")
        if word == "execute":
            m = re.match(r"execute\s+(\w+)\s*(?:\((.*)\))?\s*;?\s*$", text, re.I | re.S)
            body = self.prepared[m[1].lower()]
            vals = [dialect.show(v) for v in dialect.split_commas(dialect.tree(dialect.lex(m[2] or "")))]
            sent = {f"p{i}": self.spark.sql(f"SELECT {v} AS v").first().v for i, v in enumerate(vals, 1)}
            return self._run(body, sent)
        if word == "deallocate":
            self.prepared.pop(text.split()[-1].rstrip(";").lower(), None)
            return self.spark.createDataFrame([("DEALLOCATE",)], "status string")
        if word == "copy":
            m = re.match(r"copy\s*(\(.*\)|[\w.\"]+(?:\s*\([^)]*\))?)\s+to\s+stdout(.*)$", text.strip().rstrip(";"), re.I | re.S)
            src = m[1][1:-1] if m[1].startswith("(") else "SELECT " + ((re.search(r"\(([^)]*)\)", m[1]) or [0, "*"])[1]) + " FROM " + re.split(r"[\s(]", m[1])[0]
            return self.lines(self.sql(src), "csv" in m[2].lower())
        if word == "explain":
            body = re.sub(r"^explain\s*(\([^)]*\)|analyze|verbose)*\s*", "", text, flags=re.I)
            plan = self._run(body)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(x,) for x in plan.splitlines()], "plan string")
        if kind.kind == classify.SESSION:
            return self.spark.createDataFrame([(word.upper(),)], "status string")
        self._views()
        parts = dialect.recursive_parts(text)
        if parts:
            return self._recursive(*parts)
        return self._run(text, {f"p{i}": v for i, v in enumerate(args, 1)} or None)

    def _recursive(self, name: str, cols: list[str], base: str, step: str, rest: str) -> DataFrame:
        """WITH RECURSIVE ... UNION: rounds over the rows that are new, until there are none. Each round is written to
        the shared folder, so that plans stay small."""
        view = f"{name}_{uuid.uuid4().hex[:8]}"
        df = self.spark.sql(base).distinct()
        df = materialize(df.toDF(*[c.strip("`") for c in cols]) if cols else df)
        seen, new, round_ = df, df, 0
        while not new.isEmpty():
            round_ += 1
            new.createOrReplaceTempView(view)
            got = self.spark.sql(re.sub(rf"\b{name}\b", view, step)).distinct().toDF(*df.columns)
            l, r = got.alias("l"), seen.alias("r")
            cond = reduce(and_, [l[c].eqNullSafe(r[c]) for c in df.columns])
            new = materialize(l.join(r, cond, "left_anti"))
            seen = seen.unionByName(new)
            if round_ % 16 == 0:  # the union of the rounds so far becomes one table
                seen = materialize(seen)
        seen.createOrReplaceTempView(view)
        out = self.spark.sql(re.sub(rf"\b{name}\b", view, rest))
        return out

    @staticmethod
    def lines(df: DataFrame, csv: bool = False) -> DataFrame:
        """Rows as COPY writes them: text with tabs and \\N, or CSV."""
        if csv:
            return df.select(F.to_csv(F.struct("*"), {"quoteEscape": '"', "escapeQuotes": "true"}).alias("line"))
        clean = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\\", r"\\\\"), "\t", r"\\t"), F.lit("\\N"))
        return df.select(F.concat_ws("\t", *[clean(c) for c in df.columns]).alias("line"))

    def cursor(self, name: str, text: str) -> None:
        """DECLARE: rows come to the driver one partition at a time."""
        self.cursors[name] = self.sql(text).toLocalIterator()

    def fetch(self, name: str, n: int = 1) -> list[Row]:
        it: Iterator[Row] = self.cursors[name]
        return [r for _, r in zip(range(n), it)]

    def close(self, name: str) -> None:
        self.cursors.pop(name, None)
