"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "docmetrics", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one it gives you."""
    builder = SparkSession.builder.master(master).appName(name)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session, whose one machine is all there is, gets a temporary folder where
    none is set; on a cluster that would be a folder of each machine's own, so it fails.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="docmetrics-")


def settled(df: DataFrame) -> DataFrame:
    """Write a small result that a plan uses several times to the shared folder, and read it.

    For reduced results only (classes shown, modules of a project). The files outlive the
    executors that wrote them, and the plans built on top stay short.
    """
    path = f"{scratch_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
