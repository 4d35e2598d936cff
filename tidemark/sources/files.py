"""File and JDBC sources of full copies, and what of a database is copied."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, kind: str, path: str, schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """One table from parquet, orc, json, csv or text files. CSV has a header unless said otherwise; a schema saves the
    pass that would infer it."""
    r = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (r.schema(schema) if schema is not None else r).format(kind).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """One table of a database, read by `parts` tasks over ranges of a numeric column if one is given. The driver's jar
    must be on the class path."""
    split = {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)} if column and bounds else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()


def scope(tables: Iterable[tuple[str, str]], schemas: Sequence[str] = ("*",), only: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """The (schema, table) names to copy: all of the schemas ("*" for every one), or only those listed."""
    want = set(only)
    return [t for t in tables if (t in want if want else "*" in schemas or t[0] in schemas)]
