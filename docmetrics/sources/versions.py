"""Tables that grow by batches and keep the newest rows of each project.

A table is a folder: `data/batch=<name>/project=<p>/` holds what one batch or one compaction wrote, and
`versions/version=<n>/` one row per (batch, project) with its number of rows and whether it is live.
A version is one file, which Spark's commit puts in place as a whole: readers see the version
before or the one after. A batch that a version names is complete and is not appended again; files
of a batch that failed before its version are overwritten when it runs again.

Where a project holds more than `keep` rows and some slack, its newest `keep` are written anew, as a
batch of their own, and its other partitions are no longer live; partitions of other projects are
neither read nor written. Readers cut each project to its newest `keep`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.operators.history import retain

ENTRIES = "batch string, project string, rows long, live boolean, schema string, keep int, version long"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version; none if there is no version yet."""
    try:
        rows = spark.read.schema(ENTRIES).parquet(f"{path}/versions")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ENTRIES)
        raise
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(last))


def _data(spark: SparkSession, path: str, entries: DataFrame, schema: str) -> DataFrame:
    """The rows of the partitions that entries name."""
    full = T.StructType([*T.StructType.fromJson(json.loads(schema)).fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(full).parquet(f"{path}/data")
    live = entries.select(F.col("batch").alias("_batch"), F.col("project").alias("_project"))
    return rows.join(live, (F.col("batch") == F.col("_batch")) & F.col("project").eqNullSafe(F.col("_project")), "left_semi")


def _written(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Write a batch; its entries."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("project").parquet(f"{path}/data/batch={batch}")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "project"] + [T.StructField("project", T.StringType())])
    back = spark.read.schema(schema).parquet(f"{path}/data/batch={batch}")
    return back.groupBy("project").agg(F.count("*").alias("rows")).select(
        F.lit(batch).alias("batch"), "project", "rows", F.lit(True).alias("live"), F.lit(schema.json()).alias("schema"))


def append(rows: DataFrame, path: str, batch: str, keep: int, ties: Sequence[str] = (), slack: float = 0.5) -> bool:
    """Append a batch (project, ts and other columns) under a name of its own; False if it is there already.

    ties order rows of one time. Rows must be the same whenever the batch runs again.
    """
    spark = rows.sparkSession
    before = _entries(spark, path)
    if before.where(F.col("batch") == F.lit(batch)).head(1):
        return False
    version = (before.agg(F.max("version")).first()[0] or 0) + 1
    columns = ["batch", "project", "rows", "live", "schema"]
    now = before.select(*columns).unionByName(_written(rows, path, batch))
    over = now.where("live").groupBy(F.col("project").alias("_over")).agg(F.sum("rows").alias("n")).where(F.col("n") > keep * (1 + slack))
    if over.head(1):
        schema = T.StructType([f for f in rows.schema.fields if f.name != "project"] + [T.StructField("project", T.StringType())]).json()
        of_over = F.col("project").eqNullSafe(F.col("_over"))
        live = _data(spark, path, now.where("live").join(over, of_over, "left_semi"), schema)
        packed = _written(retain(live.drop("batch"), keep, ties=ties), path, f"compact-{version}")
        marked = now.join(over.select("_over", F.lit(True).alias("_hit")), of_over, "left")
        now = marked.withColumn("live", F.col("live") & F.col("_hit").isNull()).select(*columns).unionByName(packed)
    now.withColumn("keep", F.lit(keep)).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/versions/version={version}")
    return True


def read(spark: SparkSession, path: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest `keep` rows of each project."""
    entries = _entries(spark, path)
    some = entries.select("schema", "keep").head(1)
    if not some:
        raise FileNotFoundError(f"{path} holds no version")
    return retain(_data(spark, path, entries.where("live"), some[0]["schema"]).drop("batch"), some[0]["keep"], ties=ties)


def dead_files(spark: SparkSession, path: str) -> DataFrame:
    """file: what no reader of the newest version opens, to be deleted once no older reader runs."""
    entries = _entries(spark, path)
    some = entries.select("schema").head(1)
    if not some:
        return spark.createDataFrame([], "file string")
    return _data(spark, path, entries.where(~F.col("live")), some[0]["schema"]).select(F.col("_metadata.file_path").alias("file")).distinct()
