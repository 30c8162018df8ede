"""Documentation coverage: predicates, totals, groups, lists, snapshot differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions import text as tx
from docmetrics.functions.numbers import exact_round, percent
from docmetrics.operators.ordered import top_k
from docmetrics.operators.touched import split_by_keys
from docmetrics.schema import (
    CLASS_KINDS,
    ENDPOINT_KINDS,
    ITEM_ORDER,
    PATCHABLE_KINDS,
)


def is_documented(rule: str = "A", doc: str = "docstring", source: str = "full_source") -> Column:
    """Five tests: A and E not empty, B holds text, C or opens with quotes, D or has quotes."""
    text = F.col(doc)
    if rule in ("A", "E"):
        return tx.is_given(text)
    if rule == "B":
        return tx.has_text(text)
    if rule == "C":
        return tx.has_text(text) | tx.source_has_docstring(F.col(source))
    if rule == "D":
        return tx.has_text(text) | tx.source_has_triple_quote(F.col(source))
    raise ValueError(f"unknown rule {rule!r}")


def kind() -> Column:
    return F.coalesce(F.col("method"), F.lit("UNKNOWN"))


def module() -> Column:
    return F.coalesce(F.col("module"), F.lit("unknown"))


def listed_module() -> Column:
    return F.coalesce(F.nullif(F.col("module"), F.lit("")), F.lit("Unknown"))


def _stats(documented: Column) -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.coalesce(F.sum(documented.cast("bigint")), F.lit(0)).alias("documented"),
    ]


def _with_percent(df: DataFrame) -> DataFrame:
    return df.withColumn("coverage", percent(F.col("documented"), F.col("total")))


def coverage_total(
    items: DataFrame, keys: Sequence[str] = ("project",), rule: str = "A", digits: int = 2
) -> DataFrame:
    """Total, documented, missing and the rounded percentage; one zero row for no items
    when there are no keys."""
    out = _with_percent(items.groupBy(*keys).agg(*_stats(is_documented(rule))))
    return out.withColumns(
        {
            "missing": F.col("total") - F.col("documented"),
            "coverage_percent": exact_round(F.col("coverage"), digits),
        }
    )


def coverage_by(items: DataFrame, by: str, keys: Sequence[str] = ("project",), rule: str = "A"):
    """Statistics per kind or per module; the percentage is not rounded."""
    group = {"method": kind, "module": module}[by]()
    return _with_percent(
        items.groupBy(*keys, group.alias(by)).agg(*_stats(is_documented(rule)))
    )


_LEVELS = (("project",), ("project", "method"), ("project", "module"))


def _levels(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregate by project, by kind and by module at once; names the level of each row."""
    sets = [[F.col(c) for c in keys] for keys in _LEVELS]
    grouped = df.groupingSets(sets, "project", "method", "module").agg(
        F.grouping_id().alias("gid"), *aggs
    )
    # grouping_id bits: project, method, module; a set bit means not grouped by it.
    level = F.when(F.col("gid") == 3, "project").when(F.col("gid") == 1, "method").otherwise("module")
    return grouped.withColumns(
        {"level": level, "name": F.coalesce("method", "module", F.lit(""))}
    ).drop("gid", "method", "module")


def coverage_snapshot(items: DataFrame, rule: str = "A") -> DataFrame:
    """Totals, kinds and modules of every project in one pass over the items.

    Long form: project, level (project, method, module), name, total, documented,
    coverage. A nested record would hold all modules of a project in one row.
    """
    slim = items.select(
        "project", kind().alias("method"), module().alias("module"),
        is_documented(rule).cast("bigint").alias("d"),
    )
    counted = _levels(slim, F.count("*").alias("total"), F.sum("d").alias("documented"))
    return _with_percent(counted).select(
        "project", "level", "name", "total", "documented", "coverage"
    )


def ordered_snapshot(
    items: DataFrame, rule: str = "A", order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """`coverage_snapshot` with `first_seen`, the place of each group's first item.

    Rankings need it to keep equal groups in order. Items are first counted per file, by
    hash, so that the comparison of places sorts files and not items.
    """
    *head, last = order
    per_file = items.groupBy(
        "project", kind().alias("method"), module().alias("module"), *head
    ).agg(*_stats(is_documented(rule)), F.min(last).alias(last))
    out = _levels(
        per_file,
        F.sum("total").alias("total"), F.sum("documented").alias("documented"),
        F.min(F.struct(*order)).alias("first_seen"),
    )
    return _with_percent(out).select(
        "project", "level", "name", "total", "documented", "coverage", "first_seen"
    )


def snapshot_record(snapshot: DataFrame, ts: Column) -> DataFrame:
    """The history row of each project in a coverage snapshot."""
    return snapshot.filter(F.col("level") == "project").select(
        "project", ts.alias("ts"),
        F.col("total").alias("total_items"), F.col("documented").alias("documented_items"),
        exact_round(F.col("coverage"), 2).alias("coverage_percent"),
    )


def missing_by_type(by_method: DataFrame) -> DataFrame:
    gap = F.col("total") - F.col("documented")
    return by_method.withColumn("missing", gap).filter(F.col("missing") > 0)


def stats_by_kind(items: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    def n(*kinds):
        return F.count_if(F.col("method").isin(*kinds))

    return items.groupBy(*keys).agg(
        n("MODULE").alias("modules"), n("CLASS").alias("classes"),
        n("FUNCTION").alias("functions"), n(*ENDPOINT_KINDS).alias("endpoints"),
    )


def method_counts(items: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return items.groupBy(*keys, kind().alias("method")).agg(F.count("*").alias("items"))


def items_by_type(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Items labelled with their kind group and place; long form, since a kind has no bound."""
    return items.select(
        "project",
        F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("UNKNOWN")).alias("item_type"),
        F.struct(*order).alias("at"), "qualname", "module",
    )


def distinct_modules(items: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return items.filter(tx.is_given(F.col("module"))).select(*keys, "module").distinct()


def module_counts(items: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count_distinct(F.nullif(F.col("module"), F.lit(""))).alias("modules")
    )


def scan_metadata(files: DataFrame, scan_type: str, scan_time: float | None = None) -> DataFrame:
    """Scan type, file count and the caller's duration per snapshot."""
    return files.groupBy("project", "snapshot_id").agg(
        F.lit(scan_type).alias("scan_type"),
        F.count("*").alias("total_files"),
        F.lit(scan_time).cast("double").alias("scan_time"),
    )


# ---- item lists -----------------------------------------------------------------------


def endpoints(items: DataFrame, path_contains: str | None = None) -> DataFrame:
    verbs = ["GET", "POST", "PUT", "DELETE", "PATCH"]
    found = items.filter(F.col("method").isin(verbs))
    return found.filter(F.contains(F.col("path"), F.lit(path_contains))) if path_contains else found


def dedupe_endpoints(items: DataFrame) -> DataFrame:
    """Drop the function row of a function that also has endpoint rows.

    Both rows share project, file, line and name, and only that narrow key is shuffled.
    """
    keys = ["project", "file_path", "lineno", "qualname"]
    marked = items.filter(F.col("method").isin(ENDPOINT_KINDS)).select(*keys).distinct()
    functions = F.col("method").isin("FUNCTION", "ASYNC_FUNCTION")
    plain = items.filter(functions).join(marked, keys, "left_anti")
    return items.filter(~functions | F.col("method").isNull()).unionByName(plain.select(*items.columns))


def missing(items: DataFrame, rule: str = "B") -> DataFrame:
    return items.filter(~is_documented(rule)).withColumn("listed_module", listed_module())


def well_documented(items: DataFrame, longer_than: int = 100) -> DataFrame:
    return items.filter(F.length("docstring") > longer_than)


def item_table(items: DataFrame, rule: str = "B") -> DataFrame:
    done = is_documented(rule)
    return items.select(
        "project", "module", "qualname", kind().alias("method"), done.alias("documented"),
        F.when(done, 100).otherwise(0).alias("coverage"),
        F.when(done, "Good").otherwise("Missing").alias("status"),
    )


def item_by_ordinal(items: DataFrame, project: str, ordinal: int) -> DataFrame:
    return items.filter((F.col("project") == project) & (F.col("item_ordinal") == ordinal))


def patchable(items: DataFrame) -> DataFrame:
    return items.filter(F.upper("method").isin([*PATCHABLE_KINDS, "MODULE"]))


def longest_docstrings(
    items: DataFrame, k: int = 10, keys: Sequence[str] = ("project",), order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    slim = well_documented(items).select(
        *keys, "qualname", "module", F.length("docstring").alias("length"), *order
    )
    by = [F.desc("length"), *[F.asc(o) for o in order]]
    return top_k(slim, keys, by, k, rank="place", salt_on=list(order))


def missing_sample(
    items: DataFrame,
    k: int = 10,
    rule: str = "B",
    keys: Sequence[str] = ("project",),
    order: Sequence[str] = ITEM_ORDER,
) -> DataFrame:
    """First k undocumented items per group, with how many more there are."""
    slim = missing(items, rule).select(*keys, "qualname", "module", "method", "lineno", *dict.fromkeys(["file_path", *order]))
    counts = slim.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = top_k(slim, keys, [F.asc(o) for o in order], k, rank="place", salt_on=list(order))
    return (
        first.join(counts, list(keys))
        .withColumn("more", F.greatest(F.col("_n") - k, F.lit(0).cast("bigint")))
        .drop("_n")
    )


def modules_sorted(items: DataFrame) -> DataFrame:
    """Modules in alphabetical order over all projects."""
    return distinct_modules(items).orderBy("project", "module")


# ---- quality summaries ----------------------------------------------------------------

SCORES = [
    "coverage_score", "quality_score", "complexity_score", "maintainability_score",
    "api_completeness_score",
]


def score_summary(items: DataFrame, by: Sequence[str] = ("project", "method")) -> DataFrame:
    """Mean and middle of the five scores.

    Scores have at most one decimal, so they are summed as decimals: the mean does not
    depend on the order rows arrive in.
    """
    aggs = [F.count("*").alias("items")]
    for s in SCORES:
        total = F.sum(F.col(s).cast("decimal(6,1)")).cast("double")
        aggs += [
            (total / F.count(s)).alias(f"mean_{s}"),
            F.percentile_approx(s, 0.5, 10000).alias(f"median_{s}"),
        ]
    return items.groupBy(*by).agg(*aggs)


def issue_frequency(items: DataFrame) -> DataFrame:
    return (
        items.select("project", F.explode("completeness_issues").alias("issue"))
        .withColumn("issue", F.regexp_replace("issue", r"(?s): \[.*$", ""))
        .groupBy("project", "issue")
        .agg(F.count("*").alias("items"))
    )


def style_frequency(items: DataFrame) -> DataFrame:
    style = F.coalesce(F.col("docstring_style"), F.lit("none"))
    return items.groupBy("project", style.alias("docstring_style")).agg(F.count("*").alias("items"))


# ---- gaps, edits, differences ---------------------------------------------------------


def param_gap(items: DataFrame) -> DataFrame:
    """One row per item and parameter name: ok, missing or extra. No shuffle."""
    both = F.array_distinct(F.concat("actual_params", "documented_params"))
    names = items.select("project", *ITEM_ORDER, "qualname", "actual_params", "documented_params",
                         F.explode(both).alias("param"))
    actual = F.array_contains("actual_params", F.col("param"))
    told = F.array_contains("documented_params", F.col("param"))
    status = (
        F.when(actual & (told | F.col("param").startswith("*")), "ok")
        .when(actual, "missing")
        .otherwise("extra")
    )
    return names.select("project", *ITEM_ORDER, "qualname", "param", status.alias("status"))


def exception_gap(items: DataFrame) -> DataFrame:
    """Raised exceptions the docstring does not name, and named ones never raised."""
    gaps = F.concat(
        F.transform(
            F.array_except("raised_exceptions", "documented_exceptions"),
            lambda x: F.struct(x.alias("exception"), F.lit("undocumented").alias("status")),
        ),
        F.transform(
            F.array_except("documented_exceptions", "raised_exceptions"),
            lambda x: F.struct(x.alias("exception"), F.lit("not_raised").alias("status")),
        ),
    )
    return items.select("project", *ITEM_ORDER, "qualname", F.explode(gaps).alias("g")).select(
        "project", *ITEM_ORDER, "qualname", "g.*"
    )


def apply_docstring_edits(
    items: DataFrame, edits: DataFrame, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """Set new docstrings on the first item matching (project, module, qualname, lineno).

    `edits` holds those keys, `new_docstring` and `edited_at`; the latest edit of a key
    counts. Items whose keys no edit names are not moved: the keys of the edits are marked in
    a bitmap of fixed size, and only items it may hold are searched and joined.
    """
    keys = ["project", "module", "qualname", "lineno"]
    latest = edits.select(*[F.col(k).cast(items.schema[k].dataType).alias(k) for k in keys], "new_docstring", "edited_at").groupBy(
        *keys).agg(F.max_by("new_docstring", "edited_at").alias("new_docstring"))
    near, far = split_by_keys(items, latest, keys)
    # A null key (a module or line that is not known) matches a null key.
    latest = latest.select(*[F.col(k).alias(f"_{k}") for k in keys], "new_docstring")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    hit = near.select(*keys, F.struct(*order).alias("_at")).join(latest, same)
    first = hit.groupBy(*[f"_{k}" for k in keys]).agg(
        F.min("_at").alias("_first"), F.first("new_docstring").alias("_new")
    ).withColumn("_edited", F.lit(True))
    out = near.withColumn("_at", F.struct(*order)).join(first, same & (F.col("_at") == F.col("_first")), "left")
    doc = F.when(F.col("_edited"), F.col("_new")).otherwise(F.col("docstring"))
    both = out.withColumn("docstring", doc).select(*items.columns).union(far.select(*items.columns))
    return both.withColumn("has_docstring", tx.has_text(F.col("docstring"))).select(*items.columns, "has_docstring")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items added, removed or changed between two snapshots.

    Both sides are aggregated together by key, so a key held by many copies combines
    before the shuffle. Copies of a key are compared as a whole by count and content sum.
    """
    keys = ["project", "file_path", "qualname", "method", "path"]
    content = F.xxhash64(
        F.coalesce("docstring", F.lit("\0")), F.coalesce("signature", F.lit("\0")),
        F.coalesce("full_source", F.lit("\0")),
    ).cast("decimal(20,0)")

    def side(df, is_before):
        zero = F.lit(0).cast("decimal(20,0)")
        one = F.lit(1).cast("bigint")
        none = F.lit(0).cast("bigint")
        return df.select(
            *keys,
            (one if is_before else none).alias("b"), (none if is_before else one).alias("a"),
            (content if is_before else zero).alias("bh"), (zero if is_before else content).alias("ah"),
        )

    both = side(before, True).unionByName(side(after, False)).groupBy(*keys).agg(
        F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("bh").alias("bh"), F.sum("ah").alias("ah")
    )
    change = (
        F.when(F.col("b") == 0, "added")
        .when(F.col("a") == 0, "removed")
        .when((F.col("a") != F.col("b")) | (F.col("ah") != F.col("bh")), "changed")
    )
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def classes(items: DataFrame) -> DataFrame:
    return items.filter(F.col("method").isin(CLASS_KINDS))
