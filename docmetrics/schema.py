"""Table layouts shared by the jobs, and the fixed kind lists of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of documentation items.
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE"]
SOCKET_KINDS = ["WEBSOCKET"]
CALLABLE_KINDS = ["FUNCTION", "ASYNC_FUNCTION", "PROPERTY", "STATICMETHOD", "CLASSMETHOD"]
CLASS_KINDS = ["CLASS", "PYDANTIC_MODEL"]
ENDPOINT_KINDS = HTTP_VERBS + SOCKET_KINDS
FUNCTION_LIKE = CALLABLE_KINDS + ENDPOINT_KINDS
PATCHABLE_KINDS = FUNCTION_LIKE + CLASS_KINDS + ["MIDDLEWARE"]

# Rows of one project are listed in this order wherever order matters.
ITEM_ORDER = ("file_path", "item_ordinal")

TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
REAL, FLAG = T.DoubleType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)
NAMED_TYPE = "array<struct<name:string,type:string>>"


def layout(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


NAMED_TYPES = T.ArrayType(layout(name=TEXT, type=TEXT))

SOURCE_FILES = layout(
    project=TEXT, snapshot_id=TEXT, file_path=TEXT, rel_path=TEXT, module=TEXT, source=TEXT
)

DOC_ITEMS = layout(
    project=TEXT, snapshot_id=TEXT, item_ordinal=LONG,
    module=TEXT, qualname=TEXT, path=TEXT, method=TEXT, signature=TEXT,
    docstring=TEXT, description=TEXT, first_lines=TEXT, lineno=INT,
    file_path=TEXT, full_source=TEXT,
    documented_params=TEXTS, actual_params=TEXTS, missing_params=TEXTS, extra_params=TEXTS,
    has_return_doc=FLAG, param_types=NAMED_TYPES, return_type=TEXT, has_type_hints=FLAG,
    coverage_score=REAL, quality_score=REAL, completeness_issues=TEXTS,
    docstring_style=TEXT, style_issues=TEXTS,
    documented_exceptions=TEXTS, raised_exceptions=TEXTS, has_exception_doc=FLAG,
    response_model=TEXT, status_codes=TEXTS, response_description=TEXT,
    dependencies=TEXTS, dependency_docs=NAMED_TYPES, tags=TEXTS, operation_id=TEXT,
    summary_from_decorator=TEXT, docstring_length=INT,
    complexity_score=REAL, maintainability_score=REAL, api_completeness_score=REAL,
)

# A report file holds parameter types and dependency docs as JSON objects.
REPORT_JSON = T.StructType(
    [
        T.StructField(f.name, T.MapType(TEXT, TEXT))
        if f.name in ("param_types", "dependency_docs")
        else f
        for f in DOC_ITEMS.fields
        if f.name not in ("project", "snapshot_id", "item_ordinal")
    ]
)

_GROUP_STATS = T.MapType(TEXT, layout(total=LONG, documented=LONG, coverage=REAL))
HISTORY_JSON = layout(
    timestamp=TEXT, project_path=TEXT, total_items=LONG, documented_items=LONG,
    coverage_percent=REAL, coverage_by_type=_GROUP_STATS, coverage_by_module=_GROUP_STATS,
    metadata=layout(scan_type=TEXT, total_files=LONG, scan_time=REAL),
)

_REQUESTS = T.ArrayType(
    layout(
        timestamp=TEXT, model=TEXT, prompt_tokens=LONG, completion_tokens=LONG,
        total_tokens=LONG, cost=REAL, context=TEXT,
    )
)
LEDGER_JSON = layout(
    requests=_REQUESTS,
    projects=T.MapType(TEXT, layout(created_at=TEXT, requests=_REQUESTS)),
    current_project=TEXT,
)

OVERVIEW_JSON = layout(
    project_purpose=TEXT, business_context=TEXT, key_business_value=TEXT, updated_at=TEXT
)


def type_map(col: Column) -> Column:
    """The map form of an ordered name/type list; on a repeated name the last one counts."""
    return F.aggregate(
        col,
        F.expr("cast(map() as map<string,string>)"),
        lambda acc, x: F.map_concat(
            F.map_filter(acc, lambda k, _: k != x["name"]), F.create_map(x["name"], x["type"])
        ),
    )


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of `schema` that `df` lacks, as typed nulls."""
    have = set(df.columns)
    return df.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
    )
