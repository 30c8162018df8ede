"""Stored reports, history, usage ledgers and pages: import, tables, export.

Tables are Parquet partitioned by project (and snapshot), so a project filter prunes
files. The JSON forms are for exchange with single-project tools.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmetrics.functions import text as tx
from docmetrics.schema import (
    DOC_ITEMS,
    HISTORY_JSON,
    LEDGER_JSON,
    NAMED_TYPE,
    OVERVIEW_JSON,
    REPORT_JSON,
    type_map,
    with_columns_of,
)

PAGE_ORDER = ["section", "k1", "k2", "line_no"]


def _json_with_errors(spark: SparkSession, path: str, schema: T.StructType, rows_are_lines: bool) -> DataFrame:
    """JSON records against a schema, and the text of those that don't fit it in _corrupt_record.

    A field of the wrong type is null and the record's other fields are kept. A missing path
    reads as no rows.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if not rows_are_lines:
        reader = reader.option("multiLine", True)
    try:
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], full)
        raise


def _json(spark: SparkSession, path: str, schema: T.StructType, rows_are_lines: bool) -> DataFrame:
    """The records of which at least one field fits; see bad_records() for the rest."""
    fits = F.coalesce(*[F.col(c).isNotNull() for c in schema.fieldNames()])
    for c in schema.fieldNames():
        fits = fits | F.col(c).isNotNull()
    rows = _json_with_errors(spark, path, schema, rows_are_lines)
    if "_place" in rows.columns or not rows.inputFiles():
        placed = rows.withColumn("_place", F.lit(0).cast("long"))
    else:
        placed = with_position(rows, "_place")
    return placed.where(fits | F.col("_corrupt_record").isNull()).select(*schema.fieldNames(), "_place")


def bad_records(spark: SparkSession, path: str, schema: T.StructType, rows_are_lines: bool = True) -> DataFrame:
    """record: the text of every record that doesn't fit the schema, whole or in a field."""
    rows = _json_with_errors(spark, path, schema, rows_are_lines)
    # All columns are asked for, since a scan of the error column alone is not allowed.
    return rows.select(F.struct(*schema.fieldNames()).alias("fields"), F.col("_corrupt_record").alias("record")).where(
        "record is not null").select("record", "fields")


def with_position(rows: DataFrame, name: str) -> DataFrame:
    """Add each row's place among all rows as read: by file name, then by place in the file.

    rows come straight from a file scan. Splits are counted, and the counts added up in order, so the
    places do not depend on how files are cut or dealt out. Only one row per split is sorted.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_id"))
    splits = at.groupBy("_file", "_block").agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("_file", "_block", "_from", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = at.join(starts, ["_file", "_block"])
    return joined.withColumn(name, F.col("_before") + F.col("_id") - F.col("_from")).drop("_file", "_block", "_id", "_from", "_before")


def _timestamp(col: Column) -> Column:
    """The time as written. A time with an offset (or Z) is moved to UTC, as ledgers of several
    zones are added up by day; one without has no zone."""
    local = F.replace(col, F.lit("T"), F.lit(" "))
    offset = F.regexp_extract(local, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    plain = F.regexp_replace(local, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(F.lit(0))
    signed = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    return plain - F.make_dt_interval(mins=signed)


# ---- items ----------------------------------------------------------------------------


def read_items(
    spark: SparkSession,
    path: str,
    project: str = "default",
    snapshot_id: str = "latest",
    rows_are_lines: bool = False,
) -> DataFrame:
    """A report: one JSON array of items, or JSON lines. Unreadable or not a list: no rows."""
    raw = _json(spark, path, REPORT_JSON, rows_are_lines)
    known = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in ("qualname", "module", "method")])

    def pairs(name):
        entries = F.transform(
            F.map_entries(name), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("type"))
        )
        return F.coalesce(entries, F.expr(f"cast(array() as {NAMED_TYPE})"))

    items = raw.withColumnRenamed("_place", "item_ordinal").filter(
        known.isNotNull()
    )
    return items.withColumns(
        {
            "project": F.lit(project),
            "snapshot_id": F.lit(snapshot_id),
            "param_types": pairs("param_types"),
            "dependency_docs": pairs("dependency_docs"),
        }
    ).select(*DOC_ITEMS.fieldNames())


def write_items(items: DataFrame, path: str) -> None:
    """Replace exactly the project snapshots present in `items`."""
    (
        items.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project", "snapshot_id")
        .parquet(path)
    )


def export_items_json(items: DataFrame, path: str) -> None:
    """JSON lines with the report's own field layout."""
    out = with_columns_of(items, DOC_ITEMS).withColumns(
        {"param_types": type_map(F.col("param_types")), "dependency_docs": type_map(F.col("dependency_docs"))}
    )
    out.select(*REPORT_JSON.fieldNames()).write.mode("overwrite").json(path)


def report_status(items: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Item count per stored report; with `asked` (project, snapshot_id), whether each of these exists."""
    found = items.groupBy("project", "snapshot_id").agg(F.count("*").alias("items"))
    if asked is None:
        return found
    both = asked.select("project", "snapshot_id").distinct().join(found, ["project", "snapshot_id"], "left")
    return both.select("project", "snapshot_id", F.col("items").isNotNull().alias("exists"), F.coalesce("items", F.lit(0)).alias("items"))


# ---- history --------------------------------------------------------------------------


def read_history(
    spark: SparkSession, path: str, rows_are_lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """History JSON as two long tables: snapshots, and their statistics per group."""
    raw = _json(spark, path, HISTORY_JSON, rows_are_lines).filter(F.col("timestamp").isNotNull())
    base = raw.select(
        F.col("project_path").alias("project"),
        _timestamp(F.col("timestamp")).alias("ts"),
        F.col("_place").alias("seq"),
        "*",
    )
    snapshots = base.select(
        "project", "ts", "seq", "total_items", "documented_items", "coverage_percent",
        "metadata.scan_type", "metadata.total_files", "metadata.scan_time",
    )
    levels = F.array(
        F.struct(F.lit("method").alias("level"), F.map_entries("coverage_by_type").alias("groups")),
        F.struct(F.lit("module").alias("level"), F.map_entries("coverage_by_module").alias("groups")),
    )
    groups = (
        base.select("project", "ts", F.explode(levels).alias("l"))
        .select("project", "ts", "l.level", F.posexplode("l.groups").alias("first_seen", "g"))
        .select(
            "project", "ts", "level", F.col("g.key").alias("name"), "g.value.total",
            "g.value.documented", "g.value.coverage", F.col("first_seen").cast("bigint"),
        )
    )
    return snapshots, groups


def append_history(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("project").parquet(path)


# ---- usage ----------------------------------------------------------------------------


def read_usage(
    spark: SparkSession, path: str, rows_are_lines: bool = False, flat_project: str = "default"
) -> DataFrame:
    """A usage ledger in either layout: one flat request list, or requests per project."""
    raw = _json(spark, path, LEDGER_JSON, rows_are_lines)
    flat = raw.select(F.lit(flat_project).alias("project"), F.explode("requests").alias("r"))
    nested = raw.select(F.explode("projects").alias("project", "p")).select(
        "project", F.explode("p.requests").alias("r")
    )
    rows = flat.unionByName(nested).select("project", "r.*")
    return rows.withColumn("ts", _timestamp(F.col("timestamp"))).drop("timestamp")


def append_usage(requests: DataFrame, path: str) -> None:
    requests.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy(
        "project", "month"
    ).parquet(path)


# ---- overview -------------------------------------------------------------------------


def read_overview(
    spark: SparkSession, path: str, project: str = "default", rows_are_lines: bool = False
) -> DataFrame:
    raw = _json(spark, path, OVERVIEW_JSON, rows_are_lines)
    return overview_of(raw.withColumn("project", F.lit(project)))


def overview_of(raw: DataFrame) -> DataFrame:
    """The three overview texts with '' for a missing one, and whether any holds text."""
    names = ["project_purpose", "business_context", "key_business_value"]
    filled = raw.select("project", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])
    any_text = tx.has_text(F.col(names[0])) | tx.has_text(F.col(names[1])) | tx.has_text(F.col(names[2]))
    return filled.withColumn("has_overview", any_text)


# ---- pages, diagrams, sources ---------------------------------------------------------


def write_pages(pages: DataFrame, path: str) -> None:
    """Page lines to text files per project and page kind, in page order. Only the pages given
    are replaced; those of other projects and kinds under the path stay.

    Lines are range-partitioned by page and position, so a page of any length spreads
    over several part files whose name order is the page order.
    """
    keys = ["project", "page_kind", "page_key", *PAGE_ORDER]
    (
        pages.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("project", "page_kind", "page_key", F.col("text").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project", "page_kind", "page_key")
        .text(path)
    )


def write_diagrams(pages: DataFrame, path: str) -> None:
    write_pages(pages.filter(F.col("page_kind") == "diagram"), path)


def write_sources(sources: DataFrame, path: str) -> None:
    """A new snapshot of the source table; the previous one stays as the backup."""
    (
        sources.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project", "snapshot_id")
        .parquet(path)
    )


def unwritten(pages: DataFrame, written_keys: DataFrame) -> DataFrame:
    """Rows whose content key has not been written yet."""
    return pages.join(written_keys.select("content_key"), "content_key", "left_anti")
