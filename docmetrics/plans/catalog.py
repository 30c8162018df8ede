"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.functions import prices as pr
from docmetrics.functions import text as tx
from docmetrics.functions.numbers import exact_round, percent
from docmetrics.functions.times import moment
from docmetrics.functions.score import with_docstring_facts, with_scores
from docmetrics.operators import coverage as cov
from docmetrics.operators import graph, history, patch, usage
from docmetrics.plans import bindings as b
from docmetrics.plans import pages, stored
from docmetrics.session import scratch_dir
from docmetrics.sources import extract, files, store
from docmetrics.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = b.NOW
GENERATED = "2024-01-31 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(name: str):
    return F.array_join(name, "|").alias(name)


def facts(spark: SparkSession, sf: str, **modes) -> DataFrame:
    return with_docstring_facts(b.items(spark, sf), **modes)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_scores(facts(spark, sf))


def numbered(df: DataFrame, *cols) -> DataFrame:
    return df.select("item_ordinal", *cols)


# ---- sources and extraction -----------------------------------------------------------


@query
def list_files(spark, sf):
    return files.list_files(b.sources(spark, sf))


@query
def documentable_files(spark, sf):
    paths = b.bound(spark, sf, b.FILE_PATHS)
    path = F.col("file_path")
    return paths.filter(files.is_documentable(path)).select(
        "c_custkey", "file_path", files.module_of(path).alias("module")
    )


@query
def scan_errors(spark, sf):
    facts = extract.scan_facts(b.sources(spark, sf))
    return extract.scan_errors(facts).select("project", "file_path")


@query
def extract_items(spark, sf):
    items = extract.extract_items(b.sources(spark, sf))
    return items.select(
        "project", "file_path", "module", "qualname", "path", "method", "signature", "docstring",
        "lineno", "first_lines", "full_source", joined("actual_params"),
        F.array_join(F.transform("param_types", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|").alias("types"),
        "return_type", "has_type_hints", joined("raised_exceptions"), joined("dependencies"),
        joined("tags"), "response_model",
    )


@query
def extract_scores(spark, sf):
    items = extract.extract_items(b.sources(spark, sf))
    return items.select(
        "file_path", "qualname", "method", "signature", joined("documented_params"),
        joined("missing_params"), "coverage_score", "quality_score", joined("completeness_issues"),
        "docstring_style", "docstring_length", "complexity_score", "maintainability_score",
        "api_completeness_score",
    )


@query
def extract_coverage(spark, sf):
    return cov.coverage_by(extract.extract_items(b.sources(spark, sf)), "method")


@query
def extract_endpoints(spark, sf):
    found = cov.endpoints(extract.extract_items(b.sources(spark, sf)), "/parts/")
    return found.select("project", "path", "method", "qualname", joined("tags"))


@query
def extract_deduped(spark, sf):
    """Kinds counted with an endpoint's function row left out."""
    facts = extract.scan_facts(b.sources(spark, sf))
    return cov.method_counts(extract.items_from_facts(facts, endpoint_functions=False))


@query
def deduped_items(spark, sf):
    """The same on stored items, where functions and endpoints are rows apart."""
    return cov.method_counts(cov.dedupe_endpoints(b.bound(spark, sf, b.PART_ROWS)))


@query
def scan_metadata(spark, sf):
    return cov.scan_metadata(b.sources(spark, sf), "local").select(
        "project", "scan_type", "total_files"
    )


@query
def report_status(spark, sf):
    return store.report_status(b.items(spark, sf))


@query
def rescan_changed(spark, sf):
    """Items of the files whose text changed after an edit of some method docstrings."""
    before = b.sources(spark, sf)
    after = b.changed_sources(spark, sf)
    changed = files.changed_sources(after, before)
    return extract.extract_items(changed).filter(F.col("method") == "FUNCTION").select(
        "file_path", "qualname", "docstring"
    )


# ---- docstring text -------------------------------------------------------------------


@query
def documented_params(spark, sf):
    return numbered(facts(spark, sf), joined("documented_params"), joined("missing_params"),
                    joined("extra_params"))


@query
def documented_params_section(spark, sf):
    found = facts(spark, sf, params_mode="section")
    return numbered(found, joined("documented_params"), joined("missing_params"), joined("extra_params"))


@query
def return_docs(spark, sf):
    return numbered(facts(spark, sf), "has_return_doc")


@query
def docstring_style(spark, sf):
    return numbered(facts(spark, sf), "docstring_style", joined("style_issues"))


@query
def documented_exceptions(spark, sf):
    return numbered(facts(spark, sf), joined("documented_exceptions"), "has_exception_doc")


@query
def documented_exceptions_section(spark, sf):
    return numbered(facts(spark, sf, exceptions_mode="section"), joined("documented_exceptions"))


@query
def docstring_sections(spark, sf):
    items = b.items(spark, sf).select("item_ordinal", "docstring")
    rows = tx.with_docstring_sections(items, "docstring", "s")
    pair = lambda name, first: F.array_join(
        F.transform(F.col(f"s.{name}"), lambda x: F.concat(x[first], F.lit("="), x["description"])), "|"
    )
    return rows.filter(F.col("s").isNotNull()).select(
        "item_ordinal", F.col("s.description").alias("description"), pair("args", "name").alias("args"),
        F.col("s.returns").alias("returns"), pair("raises", "type").alias("raises"),
    )


@query
def first_lines(spark, sf):
    return numbered(b.items(spark, sf).filter(F.col("docstring").isNotNull()),
                    tx.first_line(F.col("docstring")).alias("first_line"),
                    tx.docstring_length(F.col("docstring")).alias("docstring_length"))


@query
def template_docstrings(spark, sf):
    text = tx.template_docstring(F.col("method"), F.col("qualname"), F.col("sig"))
    items = b.items(spark, sf).withColumn(
        "sig", F.when(F.col("signature").startswith("self"), F.concat(F.lit("("), "signature", F.lit(")"))).otherwise(F.col("signature"))
    )
    return numbered(items.filter(F.col("method").isNotNull()), text.alias("template"))


@query
def prompt_texts(spark, sf):
    text = tx.prompt_text(
        F.coalesce("method", F.lit("FUNCTION")), F.col("qualname"), F.col("signature"),
        F.col("file_path"), F.coalesce("docstring", F.col("full_source")),
    )
    return numbered(b.items(spark, sf), text.alias("prompt"))


@query
def latex_texts(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.escape_latex(F.col("text"))).alias("latex_md5")
    )


@query
def wiki_texts(spark, sf):
    """Whole texts with headings, bullets, code and links put around them, as wiki markup."""
    rows = tx.with_storage_markup(b.bound(spark, sf, b.MARKDOWN), "md", "storage")
    return rows.select("doc_id", F.md5("storage").alias("storage_md5"))


@query
def safe_names(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query
def name_parts(spark, sf):
    q = F.col("qualname")
    return numbered(b.items(spark, sf), tx.method_name(q).alias("method_name"),
                    F.coalesce(tx.containing_class(q), F.lit("-")).alias("owner"))


@query
def custom_types(spark, sf):
    return b.items(spark, sf).groupBy("return_type").agg(
        F.count("*").alias("items"),
        F.bool_or(tx.is_custom_type(F.col("return_type"))).alias("is_custom"),
    ).filter(F.col("return_type").isNotNull())


@query
def docstring_checks(spark, sf):
    """Whether whole texts would stand inside triple quotes."""
    docs = b.table(spark, sf, "documents").select(
        F.col("lang").alias("project"), F.col("doc_id").cast("string").alias("qualname"),
        F.col("text").alias("docstring"),
    )
    return extract.docstring_checks(docs).select("qualname", "valid")


@query
def content_keys(spark, sf):
    docs = b.table(spark, sf, "documents")
    keyed = docs.select("doc_id", tx.content_key(F.col("lang"), F.col("text")).alias("content_key"))
    written = docs.join(b.table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select(
        tx.content_key(F.col("lang"), F.col("text")).alias("content_key")
    )
    return store.unwritten(keyed, written)


# ---- predicates and lists -------------------------------------------------------------


@query
def documented_rules(spark, sf):
    items = b.items(spark, sf)
    return items.groupBy("project").agg(
        *[F.count_if(cov.is_documented(r)).alias(f"rule_{r.lower()}") for r in "ABCDE"]
    )


@query
def endpoint_list(spark, sf):
    return cov.endpoints(b.items(spark, sf), "/src1").select("item_ordinal", "method", "path")


@query
def missing_items(spark, sf):
    return cov.missing(b.items(spark, sf)).select("item_ordinal", "project", "listed_module", "qualname")


@query
def well_documented(spark, sf):
    return cov.well_documented(b.items(spark, sf)).select(
        "item_ordinal", F.length("docstring").alias("length")
    )


@query
def item_table(spark, sf):
    return cov.item_table(b.items(spark, sf))


@query
def item_by_ordinal(spark, sf):
    items = b.items(spark, sf)
    found = pages.union([cov.item_by_ordinal(items, p, 1) for p in ("p0", "p1", "p2")])
    return found.select("item_ordinal", "qualname", "docstring")


@query
def patchable_items(spark, sf):
    return cov.method_counts(cov.patchable(b.items(spark, sf)))


@query
def history_of_project(spark, sf):
    return history.history_for(b.snapshots(spark, sf), "click")


@query
def snapshots_in_period(spark, sf):
    return b.snapshots(spark, sf).filter(history.in_period(7, NOW))


# ---- scores ---------------------------------------------------------------------------


@query
def item_scores(spark, sf):
    return numbered(
        scored(spark, sf), "coverage_score", "quality_score", "docstring_length", "complexity_score",
        "maintainability_score", "api_completeness_score",
    )


@query
def rescored_items(spark, sf):
    """Scores of every kind, also the kinds a scan leaves at 0."""
    rows = with_scores(facts(spark, sf), all_kinds=True)
    return numbered(rows, "coverage_score", "quality_score")


@query
def completeness_issues(spark, sf):
    return numbered(scored(spark, sf), joined("completeness_issues"))


@query
def score_summary(spark, sf):
    return cov.score_summary(scored(spark, sf)).select(
        "project", "method", "items", *[f"mean_{s}" for s in cov.SCORES]
    )


@query
def score_medians(spark, sf):
    return cov.score_summary(scored(spark, sf), ("project",)).select(
        "project", *[f"median_{s}" for s in cov.SCORES]
    )


@query
def issue_frequency(spark, sf):
    return cov.issue_frequency(scored(spark, sf))


@query
def style_frequency(spark, sf):
    return cov.style_frequency(facts(spark, sf))


# ---- coverage -------------------------------------------------------------------------


@query
def coverage_total(spark, sf):
    return cov.coverage_total(b.items(spark, sf))


@query
def coverage_total_text(spark, sf):
    return cov.coverage_total(b.items(spark, sf), rule="B", digits=1)


@query
def coverage_by_method(spark, sf):
    return cov.coverage_by(b.items(spark, sf), "method")


@query
def coverage_by_module(spark, sf):
    return cov.coverage_by(b.items(spark, sf), "module")


@query
def coverage_snapshot(spark, sf):
    return cov.coverage_snapshot(b.items(spark, sf))


@query
def ordered_snapshot(spark, sf):
    snap = cov.ordered_snapshot(b.items(spark, sf))
    return snap.select("project", "level", "name", "total", "documented", "coverage",
                       F.col("first_seen.file_path").alias("first_file"),
                       F.col("first_seen.item_ordinal").alias("first_item"))


@query
def snapshot_record(spark, sf):
    snap = cov.coverage_snapshot(b.items(spark, sf))
    return cov.snapshot_record(snap, moment(NOW))


@query
def missing_by_type(spark, sf):
    return cov.missing_by_type(cov.coverage_by(b.items(spark, sf), "method"))


@query
def stats_by_kind(spark, sf):
    return cov.stats_by_kind(b.items(spark, sf))


@query
def method_counts(spark, sf):
    return cov.method_counts(b.items(spark, sf))


@query
def items_by_type(spark, sf):
    rows = cov.items_by_type(b.items(spark, sf))
    return rows.select("project", "item_type", F.col("at.item_ordinal").alias("item_ordinal"), "qualname")


@query
def distinct_modules(spark, sf):
    return cov.distinct_modules(b.items(spark, sf))


@query
def modules_sorted(spark, sf):
    return cov.modules_sorted(b.items(spark, sf))


@query
def module_counts(spark, sf):
    return cov.module_counts(b.items(spark, sf))


@query
def longest_docstrings(spark, sf):
    return cov.longest_docstrings(b.items(spark, sf), 10)


@query
def missing_sample(spark, sf):
    return cov.missing_sample(b.items(spark, sf), 10).drop("lineno")


@query
def param_gap(spark, sf):
    return cov.param_gap(facts(spark, sf)).drop("file_path")


@query
def exception_gap(spark, sf):
    return cov.exception_gap(facts(spark, sf)).drop("file_path")


@query
def docstring_edits(spark, sf):
    edits = b.bound(spark, sf, b.EDITS)
    return cov.apply_docstring_edits(b.items(spark, sf), edits).select(
        "item_ordinal", F.md5(F.coalesce("docstring", F.lit(""))).alias("docstring_md5"), "has_docstring"
    )


@query
def snapshot_diff(spark, sf):
    items = b.items(spark, sf)
    renamed = F.when(F.col("file_path").startswith("/fr/"), F.concat("qualname", F.lit("_new"))).otherwise(F.col("qualname"))
    before = b.bound(spark, sf, b.UNLABELLED_ITEMS)
    return cov.snapshot_diff(before, items.withColumn("qualname", renamed)).select(
        "project", "file_path", "qualname", F.coalesce("method", F.lit("-")).alias("method"), "path", "change"
    )


# ---- history --------------------------------------------------------------------------


@query
def history_newest(spark, sf):
    return history.newest(b.snapshots(spark, sf), 20)


@query
def latest_snapshot(spark, sf):
    return history.latest_snapshot(b.snapshots(spark, sf))


@query
def retain_history(spark, sf):
    return history.retain(b.snapshots(spark, sf), 10)


@query
def retain_history_global(spark, sf):
    return history.retain(b.snapshots(spark, sf), 100, (), ("project",))


@query
def coverage_trend(spark, sf):
    return history.coverage_trend(b.snapshots(spark, sf), NOW, (7, 30))


@query
def trend_series(spark, sf):
    return history.trend_series(b.snapshots(spark, sf), NOW, 10)


@query
def coverage_deltas(spark, sf):
    deltas = history.coverage_deltas(b.snapshots(spark, sf))
    return deltas.filter(F.col("coverage_change").isNotNull())


@query
def best_worst_modules(spark, sf):
    return history.best_worst_modules(b.groups(spark, sf)).drop("first_seen")


@query
def recommendations(spark, sf):
    snaps = b.snapshots(spark, sf)
    trends = history.coverage_trend(snaps, NOW, (30,))
    return history.recommendations(history.latest_snapshot(snaps), b.groups(spark, sf), trends)


@query
def progress_report(spark, sf):
    return history.progress_report(b.snapshots(spark, sf), b.groups(spark, sf), NOW)


# ---- usage ----------------------------------------------------------------------------


def priced(spark, sf, match="first"):
    return usage.price_requests(b.usage(spark, sf), match=match)


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.col("cost").cast("double"))


@query
def price_requests(spark, sf):
    keyed = priced(spark, sf).withColumn("price_key", pr.price_key(F.col("model")))
    return as_double(keyed).select("event_id", "price_key", "cost")


@query
def price_requests_longest(spark, sf):
    return as_double(priced(spark, sf, "longest")).groupBy("model").agg(
        F.sum(F.col("cost").cast("decimal(20,6)")).cast("double").alias("cost")
    )


@query
def estimated_costs(spark, sf):
    rows = b.usage(spark, sf)
    cost = pr.estimate_cost(F.col("model"), F.col("total_tokens"))
    return rows.select("event_id", cost.cast("double").alias("estimate"), pr.price_label(F.col("model")).alias("label"))


@query
def cost_texts(spark, sf):
    return usage.usage_totals(priced(spark, sf)).select(
        "project", "total_requests", pr.format_cost(F.col("total_cost")).alias("cost_text")
    )


@query
def usage_totals(spark, sf):
    return usage.usage_totals(priced(spark, sf))


@query
def usage_daily(spark, sf):
    return usage.usage_daily(priced(spark, sf))


@query
def usage_monthly(spark, sf):
    return usage.usage_monthly(priced(spark, sf))


@query
def usage_calendar(spark, sf):
    out = usage.usage_calendar(priced(spark, sf))
    return out.fillna("-", ["month", "day"])


@query
def usage_stats(spark, sf):
    return usage.usage_stats(priced(spark, sf), NOW - b.dt.timedelta(days=2))


@query
def usage_month(spark, sf):
    return usage.usage_month(priced(spark, sf), 2024, 1)


@query
def retain_usage(spark, sf):
    return usage.retain_usage(b.usage(spark, sf), 1000, ("event_id",)).select("project", "event_id", "ts")


@query
def recent_requests(spark, sf):
    return usage.recent_requests(b.usage(spark, sf), 50, ties=("event_id",)).select(
        "project", "event_id", "place"
    )


@query
def recent_requests_overall(spark, sf):
    return usage.recent_requests(b.usage(spark, sf), 50, (), ("event_id",)).select("event_id", "ts")


@query
def reprice_audit(spark, sf):
    """Costs stored a thousand times too high for one model, found again."""
    wrong = F.when(F.col("model") == "o3", F.col("cost").cast("double") * 1000).otherwise(F.col("cost").cast("double"))
    stored = priced(spark, sf).withColumn("cost", wrong)
    return usage.reprice_audit(stored).select("event_id", "cost", "due_cost")


@query
def usage_since_reset(spark, sf):
    """Every sign-up of a project's users starts its ledger anew."""
    rows = priced(spark, sf)
    resets = rows.filter(F.col("model") == "gpt-4o-mini").select("project", F.col("ts").alias("reset_at"))
    return usage.usage_totals(usage.since_reset(rows, resets))


# ---- graph ----------------------------------------------------------------------------


@query
def latest_class(spark, sf):
    return graph.latest_class(b.items(spark, sf)).select(
        "project", "qualname", F.coalesce("module", F.lit("-")).alias("module"), "file_path",
        F.col("at.item_ordinal").alias("item_ordinal"),
    )


@query
def uml_classes(spark, sf):
    rows = graph.uml_classes(b.items(spark, sf))
    return rows.select("project", "qualname", "package", F.coalesce("stereotype", F.lit("-")).alias("stereotype"),
                       "is_abstract", "methods", "attributes")


@query
def attach_methods(spark, sf):
    return graph.attach_methods(b.items(spark, sf)).select(
        "project", "item_ordinal", "owner", "is_attribute", "is_private", "text", "brief"
    )


@query
def class_carry(spark, sf):
    rows = graph.legacy_class_carry(b.items(spark, sf))
    return rows.select("item_ordinal", F.coalesce("carried_class", F.lit("-")).alias("carried_class"))


@query
def attach_methods_legacy(spark, sf):
    return graph.attach_methods_legacy(b.items(spark, sf)).groupBy("project", "owner").agg(
        F.count("*").alias("members")
    )


def flat(edges: DataFrame) -> DataFrame:
    dash = lambda n: F.coalesce(n, F.lit("-")).alias(n)
    return edges.select("project", "item_ordinal", "source", "target", "relationship_type", dash("label"), dash("stereotype"))


@query
def edges(spark, sf):
    return flat(graph.edges(b.items(spark, sf)))


@query
def inheritance_edges(spark, sf):
    return flat(graph.edges_of(b.items(spark, sf), "INHERITANCE")).drop("label", "stereotype")


@query
def composition_edges(spark, sf):
    return flat(graph.edges_of(b.items(spark, sf), "COMPOSITION"))


@query
def association_edges(spark, sf):
    return flat(graph.edges_of(b.items(spark, sf), "ASSOCIATION")).drop("stereotype")


@query
def dependency_edges(spark, sf):
    return flat(graph.edges_of(b.items(spark, sf), "DEPENDENCY")).drop("label")


@query
def distinct_edges(spark, sf):
    dash = lambda n: F.coalesce(n, F.lit("-")).alias(n)
    rows = graph.edges(b.items(spark, sf), distinct=True)
    return rows.select("project", "source", "target", "relationship_type", dash("label"), dash("stereotype"))


@query
def edge_texts(spark, sf):
    rows = graph.edges(b.items(spark, sf))
    return rows.groupBy("project", graph.edge_text().alias("text")).agg(F.count("*").alias("times"))


@query
def edges_within(spark, sf):
    items = b.items(spark, sf)
    shown = graph.select_classes(graph.uml_classes(items), graph.DIAGRAMS["overview"])
    return flat(graph.edges_within(graph.edges(items), shown))


@query
def select_classes(spark, sf):
    classes = graph.uml_classes(b.items(spark, sf))
    parts = []
    for name in ("overview", "detailed", "fastapi"):
        chosen = graph.select_classes(classes, graph.DIAGRAMS[name])
        parts.append(chosen.select(F.lit(name).alias("diagram"), "project", "qualname", "place"))
    return pages.union(parts)


@query
def graph_stats(spark, sf):
    return graph.graph_stats(b.items(spark, sf))


@query
def degree_stats(spark, sf):
    return graph.degree_stats(graph.edges(b.items(spark, sf)))


@query
def diagram_lines(spark, sf):
    return graph.diagram_lines(b.items(spark, sf), graph.DIAGRAMS["detailed"])


@query
def endpoint_flow(spark, sf):
    return graph.endpoint_flow(b.items(spark, sf))


# ---- pages ----------------------------------------------------------------------------


def page(df: DataFrame) -> DataFrame:
    return df.drop("page_key")


@query
def module_tree(spark, sf):
    return pages.module_tree(b.items(spark, sf)).select(
        "project", "path", "parent", "name", "depth", "items", "is_last", "branch"
    )


@query
def tree_lines(spark, sf):
    return page(pages.tree_lines(b.items(spark, sf), "tree", 0))


@query
def page_stats(spark, sf):
    return pages.page_stats(b.items(spark, sf))


@query
def page_index(spark, sf):
    return page(pages.page_index(b.items(spark, sf), GENERATED))


@query
def page_structure(spark, sf):
    return page(pages.page_structure(b.items(spark, sf)))


@query
def page_coverage(spark, sf):
    return page(pages.page_coverage(b.items(spark, sf), GENERATED))


@query
def page_reference(spark, sf):
    rows = page(pages.page_reference(b.items(spark, sf)))
    return rows.withColumn("text", F.md5("text"))


@query
def page_history(spark, sf):
    snaps = b.snapshots(spark, sf)
    items = b.bound(spark, sf, b.EVENT_ITEMS)
    return page(pages.page_history(items, snaps, GENERATED))


def overview(spark, sf):
    return store.overview_of(b.bound(spark, sf, b.OVERVIEWS))


@query
def page_overview(spark, sf):
    return page(pages.page_overview(b.items(spark, sf), overview(spark, sf)))


@query
def page_master(spark, sf):
    return page(pages.page_master(b.items(spark, sf), overview(spark, sf), GENERATED))


@query
def endpoint_pages(spark, sf):
    rows = pages.endpoint_pages(scored(spark, sf))
    return rows.select("project", "item_ordinal", "title", "body")


@query
def coverage_page(spark, sf):
    return page(pages.coverage_page(b.items(spark, sf), GENERATED))


@query
def latex_body(spark, sf):
    items = b.items(spark, sf).withColumn("first_lines", F.lit(""))
    return page(pages.latex_body(items)).withColumn("text", F.md5("text"))


@query
def diagram_page(spark, sf):
    return page(pages.diagram_page(b.items(spark, sf), graph.DIAGRAMS["overview"]))


# ---- patches --------------------------------------------------------------------------


@query
def patch_docstrings(spark, sf):
    edits = b.bound(spark, sf, b.PART_EDITS)
    out = patch.patch_docstrings(b.sources(spark, sf), edits, "next")
    status = F.array_join(F.transform("patch_status", lambda s: F.concat(s["lineno"].cast("string"), F.lit("="), s["status"])), "|")
    return out.select("file_path", "snapshot_id", "source", status.alias("status"))


@query
def rejected_edits(spark, sf):
    edits = b.bound(spark, sf, b.PART_EDITS)
    return patch.rejected_edits(b.sources(spark, sf), edits)


@query
def edit_targets(spark, sf):
    path = F.when(F.col("item_ordinal") % 2 == 0, F.col("file_path")).otherwise("")
    target = patch.edit_target_path(path, F.coalesce("module", F.lit("")))
    return numbered(b.items(spark, sf), F.coalesce(target, F.lit("-")).alias("target"))


# ---- streams --------------------------------------------------------------------------


def stream_table(spark, sf, name):
    """A given table as a file stream, whether it is one file or a folder of part files."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


@query
def stream_usage_totals(spark, sf):
    requests = spark.sql(b.spark_text(b.USAGE), events=stream_table(spark, sf, "events"))
    days = jobs.drain(jobs.stream_usage_totals(usage.price_requests(requests)), ["project", "day"])
    return as_double(days).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def stream_latest_items(spark, sf):
    events = stream_table(spark, sf, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"),
        F.lit("/a.py").alias("file_path"), F.col("event_type").alias("qualname"),
        F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("method"),
        F.col("props").alias("docstring"), F.col("event_id").alias("edited_at"),
    )
    latest = jobs.drain(
        jobs.stream_latest_items(events), ["project", "file_path", "qualname", "method"]
    )
    return latest.drop("file_path")


@query
def stream_items(spark, sf):
    """Source files arriving as a stream, scanned as they land."""
    part = b.dealt(stream_table(spark, sf, "part"))
    sources = spark.sql(b.spark_text(b.source_sql()), part=part)
    items = jobs.stream_items(sources).select("project", "file_path", "item_ordinal", "method", "qualname")
    landed = jobs.drain(items, ["file_path", "item_ordinal"])
    return landed.groupBy("project", "method").agg(F.count("*").alias("items"))


@query
def stream_history(spark, sf):
    """Snapshots recorded per micro-batch, read back from the shared folder."""
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    documents = stream_table(spark, sf, "documents")
    items = spark.sql(
        b.spark_text(b.ITEMS), documents=documents, labels=b.table(spark, sf, "labels")
    )
    run = jobs.stream_history(items, f"{base}/snapshots", f"{base}/groups", f"{base}/state")
    run.awaitTermination()
    groups = spark.read.parquet(f"{base}/groups")
    return groups.groupBy("project", "level", "name").agg(
        F.sum("total").alias("total"), F.sum("documented").alias("documented")
    )


QUERIES |= stored.QUERIES
