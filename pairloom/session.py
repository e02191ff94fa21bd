"""Session, table loading and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; settings given on submit win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/pairloom-{os.getpid()}-{uuid.uuid4().hex[:12]}-{label}"


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._pairloom_path = path
    return out


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets several consumers share one computation. The rows of each
    value of ``by``, the last column, get a folder of their own, so a filter on it reads no others.
    """
    path = _path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return _read(df.sparkSession, df.schema, path)


def materialize_in_turn(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """The union of ``parts``, of one schema, written like :func:`materialize` but one part after the other, so that what
    a part broadcasts is not held together with that of the others."""
    path = ""
    for part in parts:
        path = path or _path(part.sparkSession, label)
        part.write.mode("append").parquet(path)
    return _read(part.sparkSession, part.schema, path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_pairloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
