"""Sessions, tables, and the folder that a query may write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", **more: str) -> SparkSession:
    """A session on this machine. On a cluster use its own session; nothing here needs these settings."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("tessera").config(map=conf | more).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see, under spark.checkpoint.dir; it goes when the application ends. Only a session on one machine may have no such setting: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{(base or tempfile.gettempdir()).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    fs, path = file_system(spark, own)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/scratch-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system for a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)
