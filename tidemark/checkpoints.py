"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir. A temporary folder serves only where none is set
    and all tasks run in the driver's own process, as in tests; on a cluster it would be lost with its machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Runs the plan so far and cuts its lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """As checkpoint(), but as a compressed table, for what is wide or large; it is read by columns. ``options`` are the
    writer's."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        path = df.__dict__.get("written_at")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
