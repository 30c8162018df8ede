"""Docstring edits applied to source text in bulk: one source table in, one out.

Edits of a file are gathered next to its text, at most one per line of the file, so a
gathered row is never larger than the file it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docmetrics.operators.spans import patch_text
from docmetrics.operators.touched import split_by_keys
from docmetrics.schema import FLAG, INT, PATCHABLE_KINDS, TEXT, layout

def edit_target_path(file_path: Column, module: Column) -> Column:
    """The item's file, else its module name as a path."""
    from_module = F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.coalesce(
        F.nullif(file_path, F.lit("")), F.when(module != "", from_module)
    )


def latest_edits(edits: DataFrame) -> DataFrame:
    """Latest edit per (project, file, line) of the kinds that hold a docstring.

    `edits`: project, file_path, module, method, lineno, new_docstring, edited_at.
    """
    kind = F.upper("method")
    keyed = edits.filter(kind.isin([*PATCHABLE_KINDS, "MODULE"])).select(
        "project",
        edit_target_path(F.col("file_path"), F.col("module")).alias("file_path"),
        (kind == "MODULE").alias("is_module"), F.col("lineno").cast("int").alias("lineno"),
        "new_docstring", "edited_at",
    )
    return keyed.groupBy("project", "file_path", "is_module", "lineno").agg(
        F.max_by("new_docstring", "edited_at").alias("new_docstring")
    )


def _line_counts(sources: DataFrame) -> DataFrame:
    text = F.coalesce("source", F.lit(""))
    return sources.select("project", "file_path", F.size(F.split(text, "\n", -1)).alias("_lines"))


def rejected_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that reach no file: unsupported kind, unknown file, line out of range."""
    columns = ["project", "file_path", "lineno", "message"]
    kind = F.upper("method")
    unsupported = edits.filter(~kind.isin([*PATCHABLE_KINDS, "MODULE"]) | kind.isNull()).select(
        "project", "file_path", F.col("lineno").cast("int").alias("lineno"),
        F.concat(F.lit("Unsupported kind for patching: "), F.coalesce(kind, F.lit(""))).alias("message"),
    )
    placed = latest_edits(edits).join(_line_counts(sources), ["project", "file_path"], "left")
    message = F.when(F.col("_lines").isNull(), F.lit("File not found")).when(
        ~F.col("is_module") & ~F.col("lineno").between(1, F.col("_lines")),
        F.format_string("Line number %d out of range (1-%d)", F.col("lineno"), F.col("_lines")),
    )
    lost = placed.withColumn("message", message).filter(F.col("message").isNotNull())
    return lost.select(*columns).unionByName(unsupported.select(*columns))


def gather_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits of each file as one array: one per line that the file has, so bounded by it."""
    latest = latest_edits(edits).join(_line_counts(sources), ["project", "file_path"])
    inside = latest.filter(F.col("is_module") | F.col("lineno").between(1, F.col("_lines")))
    one_module_edit = F.when(F.col("is_module"), F.lit(0)).otherwise(F.col("lineno"))
    return (
        inside.groupBy("project", "file_path", "is_module", one_module_edit.alias("lineno"))
        .agg(F.max_by("new_docstring", "lineno").alias("new_docstring"))
        .groupBy("project", "file_path")
        .agg(F.sort_array(F.collect_list(F.struct("is_module", "lineno", "new_docstring"))).alias("edits"))
    )


def patch_docstrings(sources: DataFrame, edits: DataFrame, snapshot_id: str) -> DataFrame:
    """The next snapshot of the source table, with the outcome of every edit.

    Files that no edit names are neither moved nor read by Python: the files of the edits are
    marked in a bitmap of fixed size, and only files it may hold are joined with their edits.
    Adds `patch_status`, an array of (is_module, lineno, status); `rejected_edits` lists the edits
    that reach no file.
    """
    columns = ["project", "snapshot_id", "file_path", "rel_path", "module", "source"]
    near, far = split_by_keys(sources.select(*columns), latest_edits(edits), ["project", "file_path"])
    # The join's own shuffle, with its partition count kept: merging small partitions would
    # leave the parsing to few tasks.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = near.repartition(parts, "project", "file_path").join(gather_edits(near, edits), ["project", "file_path"], "left")
    status_type = "array<struct<is_module:boolean,lineno:int,status:string>>"
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in columns]
        + [T.StructField("patch_status", T.ArrayType(layout(is_module=FLAG, lineno=INT, status=TEXT)))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["patch_status"] = []
                if todo := row.pop("edits"):
                    row["source"], status = patch_text(row["source"] or "", todo)
                    row["patch_status"] = [
                        {"is_module": e["is_module"], "lineno": e["lineno"], "status": s}
                        for e, s in zip(todo, status)
                    ]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    edited = joined.select(*columns, "edits").mapInArrow(run, schema)
    kept = far.select(*columns, F.expr(f"cast(array() as {status_type})").alias("patch_status"))
    return edited.unionByName(kept).withColumn("snapshot_id", F.lit(snapshot_id))
