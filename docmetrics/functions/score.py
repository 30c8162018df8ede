"""Coverage, quality and upkeep scores of documentation items as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions import text as tx
from docmetrics.functions.numbers import exact_round
from docmetrics.schema import CALLABLE_KINDS, ENDPOINT_KINDS, FUNCTION_LIKE

INFRA_KINDS = ["MIDDLEWARE", "ROUTER_INCLUSION", "ROUTER_METADATA"]


def c(name: str) -> Column:
    return F.col(name)


def _points(condition: Column, yes, no=0) -> Column:
    return F.when(condition, yes).otherwise(no)


# Facts the scores share, added once by `with_scores`: parameter count, missing count,
# docstring length, docstring present, return value to describe.
N, M, SIZE, HAS, RETURNS = "_n", "_m", "_size", "_has", "_returns"


def _shared() -> dict[str, Column]:
    count = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    return {
        N: count("actual_params"),
        M: count("missing_params"),
        SIZE: tx.docstring_length(c("docstring")),
        HAS: tx.is_given(c("docstring")),
        RETURNS: tx.is_given(c("return_type")) & (c("return_type") != "None"),
    }


def coverage_score() -> Column:
    n, m = c(N), c(M)
    ratio = F.when(n > 0, (n - m) / n).otherwise(F.lit(1.0))
    function = (
        _points(c(HAS), 30)
        + (F.lit(40) * ratio).cast("int")
        + F.when(c(RETURNS), _points(c("has_return_doc"), 20)).otherwise(20)
        + _points(c("has_type_hints"), 10)
    )
    score = (
        F.when(c("method").isin(FUNCTION_LIKE), function)
        .when(c("method").isin("PYDANTIC_MODEL", "CLASS", "MODULE"), _points(c(HAS), 100))
        .when(c("method").isin(INFRA_KINDS), _points(c(HAS), 100, 80))
        .when(c("method") == "PYDANTIC_CONFIG", _points(c(HAS), 100, 90))
        .otherwise(0)
    )
    return F.least(score, F.lit(100)).cast("double")


def quality_score() -> Column:
    n, m = c(N), c(M)
    size = c(SIZE)
    function = F.when(
        c(HAS),
        F.when(size > 100, 50).when(size > 50, 30).when(size > 20, 15).otherwise(0)
        + F.when((m == 0) & (n > 0), 30).when(m < n / 2, 15).otherwise(0)
        + _points(c("has_return_doc"), 20),
    ).otherwise(0)
    model = _points(c(HAS), F.when(size > 50, 100).when(size > 20, 70).otherwise(30))
    klass = _points(c(HAS), F.when(size > 50, 100).when(size > 20, 60).otherwise(30))
    score = (
        F.when(c("method").isin(FUNCTION_LIKE), function)
        .when(c("method") == "PYDANTIC_MODEL", model)
        .when(c("method") == "CLASS", klass)
        .when(c("method") == "MODULE", _points(c(HAS), 100))
        .when(c("method").isin(INFRA_KINDS), _points(c(HAS), 100, 70))
        .when(c("method") == "PYDANTIC_CONFIG", _points(c(HAS), 100, 80))
        .otherwise(0)
    )
    return F.least(score, F.lit(100)).cast("double")


def completeness_issues() -> Column:
    """What is missing, in a fixed order."""
    n, m = c(N), c(M)
    is_function = c("method").isin(FUNCTION_LIKE)
    bare = ~c(HAS)
    named = F.concat(F.lit("Missing parameter docs: "), tx.list_text(c("missing_params")))
    return F.array_compact(
        F.array(
            F.when(is_function & bare, F.lit("Missing docstring")),
            F.when(is_function & (n > 0) & (m > 0), named),
            F.when(
                is_function & c(RETURNS) & ~F.coalesce(c("has_return_doc"), F.lit(False)),
                F.lit("Missing return documentation"),
            ),
            F.when(
                is_function & ~F.coalesce(c("has_type_hints"), F.lit(False)),
                F.lit("Missing type hints"),
            ),
            F.when((c("method") == "PYDANTIC_MODEL") & bare, F.lit("Missing model docstring")),
            F.when((c("method") == "CLASS") & bare, F.lit("Missing class docstring")),
            F.when((c("method") == "MODULE") & bare, F.lit("Missing module docstring")),
        )
    )


def complexity_score() -> Column:
    n = c(N)
    hints = _points(c("has_type_hints"), F.lit(0.8), F.lit(1.2))
    mean = F.when(
        n > 0, (F.least(n / F.lit(10.0), F.lit(1.0)) + hints) / F.lit(2.0)
    ).otherwise(hints)
    return exact_round(F.least(mean * 100, F.lit(100.0)), 1)


def maintainability_score() -> Column:
    n, m = c(N), c(M)
    size = c(SIZE)
    text_part = F.when(size > 50, F.lit(0.9)).when(size > 20, F.lit(0.7)).otherwise(F.lit(0.3))
    param_part = F.when(n > 0, (n - m) / n).otherwise(F.lit(1.0))
    hint_part = _points(c("has_type_hints"), F.lit(0.9), F.lit(0.6))
    return_part = F.when(
        c(RETURNS), _points(c("has_return_doc"), F.lit(0.9), F.lit(0.5))
    ).otherwise(F.lit(0.8))
    return exact_round((text_part + param_part + hint_part + return_part) / F.lit(4.0) * 100, 1)


def api_completeness_score() -> Column:
    """Mean of five endpoint facts; 0 for everything that is not an endpoint."""
    status = F.coalesce(c("status_codes"), tx.no_strings())
    deps = F.coalesce(c("dependencies"), tx.no_strings())
    dep_params = F.array_distinct(F.transform(c("dependency_docs"), lambda d: d["name"]))
    described = F.size(F.array_intersect(dep_params, c("documented_params")))
    model_part = _points(tx.is_given(c("response_model")), F.lit(0.9), F.lit(0.5))
    status_part = _points(
        (F.size(status) > 0) & ~((F.size(status) == 1) & (F.get(status, F.lit(0)) == "Default")),
        F.lit(0.8), F.lit(0.6),
    )
    tag_part = _points(F.size(F.coalesce(c("tags"), tx.no_strings())) > 0, F.lit(0.8), F.lit(0.4))
    id_part = _points(tx.is_given(c("operation_id")), F.lit(0.7), F.lit(0.5))
    dep_part = F.when(F.size(deps) > 0, described / F.size(deps)).otherwise(F.lit(0.8))
    mean = (model_part + status_part + tag_part + id_part + dep_part) / F.lit(5.0)
    return F.when(c("method").isin(ENDPOINT_KINDS), exact_round(mean * 100, 1)).otherwise(0.0)


def with_docstring_facts(
    items: DataFrame, params_mode: str = "first_line", exceptions_mode: str = "reference"
) -> DataFrame:
    """Everything read from the docstring text, for function and endpoint rows."""
    doc, marks = c("_doc"), c("_marks")
    return (
        items.withColumn("_doc", F.when(c("method").isin(FUNCTION_LIKE), c("docstring")))
        .withColumn("_marks", tx.section_marks(doc))
        .withColumns(
            {
                "documented_params": tx.documented_params(doc, marks, params_mode),
                "has_return_doc": tx.has_return_doc(doc),
                "_hits": tx.style_hits(marks),
                "_empty": tx.empty_google_headers(doc, marks),
                "documented_exceptions": tx.documented_exceptions(doc, marks, exceptions_mode),
            }
        )
        .withColumns(
            {
                "missing_params": tx.missing_params(c("actual_params"), c("documented_params")),
                "extra_params": tx.extra_params(c("actual_params"), c("documented_params")),
                "docstring_style": tx.docstring_style(doc, c("_hits")),
                "style_issues": tx.style_issues(doc, c("_hits"), c("_empty")),
                "has_exception_doc": F.size(c("documented_exceptions")) > 0,
            }
        )
        .drop("_doc", "_marks", "_hits", "_empty")
    )


def with_scores(items: DataFrame, all_kinds: bool = False) -> DataFrame:
    """Scores and issues.

    Kinds that a scan stores unscored (application and router settings, model config)
    keep 0 and no issues unless `all_kinds` asks to rescore them too. Length and upkeep
    scores exist for functions and endpoints only.
    """
    unscored = c("method").isin("METADATA", "ROUTER_METADATA", "PYDANTIC_CONFIG") & ~F.lit(all_kinds)
    function_like = c("method").isin(CALLABLE_KINDS + ENDPOINT_KINDS)
    scores = items.withColumns(_shared()).withColumns(
        {
            "coverage_score": F.when(unscored, 0.0).otherwise(coverage_score()),
            "quality_score": F.when(unscored, 0.0).otherwise(quality_score()),
            "completeness_issues": F.when(unscored, tx.no_strings()).otherwise(completeness_issues()),
            "docstring_length": F.when(function_like, c(SIZE)).otherwise(0),
            "complexity_score": F.when(function_like, complexity_score()).otherwise(0.0),
            "maintainability_score": F.when(function_like, maintainability_score()).otherwise(0.0),
            "api_completeness_score": api_completeness_score(),
        }
    )
    return scores.drop(N, M, SIZE, HAS, RETURNS)
