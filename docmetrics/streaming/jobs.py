"""Jobs over rows that arrive over time. Each has a batch twin with the same totals."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmetrics.functions.times import event_time
from docmetrics.operators.coverage import coverage_snapshot, snapshot_record
from docmetrics.session import scratch_dir
from docmetrics.sources.extract import extract_items


def stream_usage_totals(requests: DataFrame, delay: str = "2 days") -> DataFrame:
    """Cost and request count per project and day; requests later than `delay` are dropped.

    Months are sums of these days: a calendar month is not a fixed window length.
    """
    return (
        requests.withColumn("_event_time", event_time(F.col("ts")))
        .withWatermark("_event_time", delay)
        .groupBy("project", F.window("_event_time", "1 day"), F.to_date("ts").alias("day"))
        .agg(F.sum(F.col("cost").cast("decimal(20,6)")).alias("cost"), F.count("*").alias("requests"))
        .select("project", "day", "cost", "requests")
    )


def stream_latest_items(items: DataFrame) -> DataFrame:
    """The newest state of each item as running aggregate state, keyed by item.

    `items` needs `edited_at`; use update output mode.
    """
    keys = ["project", "file_path", "qualname", "method"]
    rest = [c for c in items.columns if c not in keys]
    return (
        items.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "edited_at").alias("s"))
        .select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def stream_items(sources: DataFrame) -> DataFrame:
    """Items of files as they land; stateless, so append mode."""
    return extract_items(sources)


def stream_history(
    items: DataFrame, snapshots_path: str, groups_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append a coverage snapshot per micro-batch of items.

    The batch number is part of the output path, so a batch run again after a failure
    replaces its own rows and counts once.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        snap = coverage_snapshot(batch)
        snap.write.mode("overwrite").parquet(f"{groups_path}/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{groups_path}/batch={batch_id}")
        snapshot_record(stored, F.localtimestamp()).write.mode("overwrite").parquet(
            f"{snapshots_path}/batch={batch_id}"
        )

    return (
        items.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def landed(stream: DataFrame, checkpoint: str, path: str) -> int:
    """Take what has landed since the last run and append it to the table at path; the number of batches.

    The file sink's log names what each batch wrote, so a batch that runs again adds nothing.
    """
    spark = stream.sparkSession
    # Each batch lists its files anew, by default in a task per file, and reads 32 in a task:
    # small files need a few tasks a core. The listing takes the settings of the session while it runs.
    few = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(2 * spark.sparkContext.defaultParallelism),
        "spark.sql.files.openCostInBytes": str(1 << 16),
        "spark.sql.streaming.fileSource.cleaner.numThreads": "8",
    }
    before = {key: spark.conf.get(key) for key in few}
    try:
        for key, value in few.items():
            spark.conf.set(key, value)
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return len(query.recentProgress)


def stream_scans(rows: DataFrame, base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Record the coverage of each scan once all its items have come, whatever the batches they come in.

    rows: items (project, snapshot_id, method, module, docstring; expected_items null) and one
    marker per scan (project, snapshot_id, expected_items: how many items it has). A scan is closed
    in the batch that brings its last item or its marker, whichever is later. Under base: groups and
    snapshots (read them with read_scans), and what is still open. A batch that runs again
    replaces its own rows and decides from those of the batches before it.
    """
    scan = ["project", "snapshot_id"]
    marked_type = "project string, snapshot_id string, expected_items long, batch long"
    closed_type = "project string, snapshot_id string, batch long"
    item_type = "method string, module string, docstring string, batch long, project string, snapshot_id string"

    def close(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.where("expected_items is null").select("method", "module", "docstring", *scan).write.mode("overwrite").partitionBy(
            *scan).parquet(f"{base}/items/batch={batch_id}")
        batch.where("expected_items is not null").select(*scan, F.col("expected_items").cast("long").alias("expected_items")).write.mode(
            "overwrite").parquet(f"{base}/markers/batch={batch_id}")

        def so_far(name: str, schema: str, before: int) -> DataFrame:
            kept = F.col("batch") < before
            try:
                return spark.read.schema(schema).parquet(f"{base}/{name}").where(kept)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" in str(e):
                    return spark.createDataFrame([], schema)
                raise

        open_ = so_far("markers", marked_type, batch_id + 1).groupBy(*scan).agg(F.max("expected_items").alias("expected_items")).join(
            so_far("closed", closed_type, batch_id), scan, "left_anti")
        items = so_far("items", item_type, batch_id + 1)
        have = items.groupBy(*scan).agg(F.count("*").alias("n"))
        done = open_.join(have, scan, "left").where(F.coalesce("n", F.lit(0)) >= F.col("expected_items")).select(*scan)
        done.write.mode("overwrite").parquet(f"{base}/closed/batch={batch_id}")
        done = so_far("closed", closed_type, batch_id + 1).where(F.col("batch") == batch_id).select(*scan)
        key = F.to_json(F.struct(*scan))
        snap = coverage_snapshot(items.join(done, scan, "left_semi").withColumn("project", key).drop("snapshot_id"))
        both = F.from_json("project", "project string, snapshot_id string")
        snap = snap.withColumn("_scan", both).withColumns({c: F.col(f"_scan.{c}") for c in scan}).drop("_scan")
        snap.write.mode("overwrite").parquet(f"{base}/groups/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(close)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_scans(spark: SparkSession, base: str) -> DataFrame:
    """project, snapshot_id, level, name, total, documented, coverage of every closed scan."""
    return spark.read.parquet(f"{base}/groups").drop("batch")


def drain(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over what is there and return the last row per key.

    Every micro-batch is written to the shared folder; the result reads those files back,
    so nothing passes through the driver.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # A stream without rows writes no batch.
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")
    rows = spark.read.parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("s"))
        .select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    )
