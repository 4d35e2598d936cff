"""Session set-up and the shared folder in which jobs cut their lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def get_spark(app: str = "tidemark", cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where the session sets none (tests in
    local mode) a temporary folder is made, and removed at exit."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if said:
        return said
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back: the lineage is cut, each stage runs once, and a
    lost executor costs nothing that was written. The files go with release(), at the latest when the driver's process
    ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tidemark-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _LEFT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


_LEFT: dict[str, SparkSession] = {}


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing will read again: their successors are written."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path in _LEFT:
            _remove(_LEFT.pop(path), path)


@atexit.register
def _release_all() -> None:
    for path, spark in _LEFT.items():
        _remove(spark, path)
