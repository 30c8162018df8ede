"""Queries that write files or tables to the shared folder and read them back, and jobs on varied sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.functions import prices as pr
from docmetrics.operators import graph, patch, usage
from docmetrics.plans import bindings as b
from docmetrics.plans import pages
from docmetrics.session import scratch_dir
from docmetrics.sources import extract, files, store, versions
from docmetrics.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

GENERATED = "2024-01-31 00:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- source trees ---------------------------------------------------------------------

# Part files in folders by size, some of which hold nothing documentable.
_TREE = """
SELECT p_brand AS project, 'latest' AS snapshot_id, file_path, file_path AS rel_path, module, source FROM (
 SELECT *, CASE WHEN p_partkey % 9 = 0 THEN 's' || p_size || '/_hidden' || p_partkey || '.py' WHEN p_partkey % 7 = 0 THEN 's' || p_size || '/tests/test_' || p_partkey || '.py'
  ELSE 's' || p_size || '/part' || p_partkey || '.py' END AS file_path, 'part' || p_partkey AS module, {source} AS source FROM {{part}}) x
"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return b.bound_parts(spark, sf, _TREE.format(source=b.part_source()))


def digested(sources: DataFrame) -> DataFrame:
    return sources.select("project", "rel_path", "module", F.md5("source").alias("digest"))


@query
def tree_files(spark, sf):
    """Files written by executors and read again as a source tree, without what is not documentable."""
    root = fresh(spark, "tree")
    files.write_tree(tree(spark, sf), root)
    return digested(files.read_sources(spark, root, "all"))


@query
def landed_files(spark, sf):
    """Files that land in two waves, each taken once by a stream that archives what it has read."""
    base = fresh(spark, "landing")
    rows = tree(spark, sf)
    counted = []
    for wave in (0, 1):
        files.write_tree(rows.where(F.crc32(F.col("module").cast("binary")) % 2 == wave), f"{base}/in")
        stream = files.stream_sources(spark, f"{base}/in", "all", archive=f"{base}/done", listed=f"{base}/listed")
        counted.append(jobs.landed(stream, f"{base}/state", f"{base}/out"))
    files.list_landed(spark, f"{base}/in", f"{base}/listed", archive=f"{base}/done", take=False)
    return digested(spark.read.parquet(f"{base}/out"))


# ---- varied sources -------------------------------------------------------------------

NL = b.NL


def _lines(*texts: str) -> str:
    return " || ".join(f"{t} || {NL}" for t in texts)


# A router, an app, a model with nested classes and three sorts of method, an endpoint with responses.
VARIED = f"""
SELECT p_brand AS project, 'latest' AS snapshot_id, '/v/part' || p_partkey || '.py' AS file_path,
 'part' || p_partkey || '.py' AS rel_path, 'part' || p_partkey AS module, {_lines(
    "'router = APIRouter(prefix=\"/p' || p_size || '\", tags=[\"t\"])'", "'app = FastAPI(title=\"' || p_brand || '\")'",
    "'app.include_router(router, prefix=\"/v' || p_size || '\")'", "'app.add_middleware(Gate' || p_size || ', on=True)'",
    "'class Order' || p_partkey || '(BaseModel):'", "'    \"\"\"Order of ' || p_brand || '.\"\"\"'", "'    class Config:'",
    "'        orm_mode = True'", "'        title = \"' || p_type || '\"'", "'    class Inner(BaseModel):'", "'        n: int'",
    "'    @property'", "'    def total(self) -> int:'", "'        return ' || p_size", "'    @staticmethod'",
    "'    def make(a: int, b=\"x\"):'", "'        return a'", "'    @classmethod'", "'    def load(cls, path: str):'", "'        return cls()'",
    "'@router.post(\"/o/' || p_partkey || '\", status_code=' || (200 + p_size) || ', summary=\"Make ' || p_size || '\", operation_id=\"op' || p_partkey || '\", responses=' || chr(123) || '404: None, 409: None' || chr(125) || ')'",
    "'async def create(order: Order):'", "'    return order'")} AS source
FROM {{part}}
"""


def varied(spark: SparkSession, sf: str) -> DataFrame:
    return b.bound_parts(spark, sf, VARIED)


@query
def extract_varied(spark, sf):
    items = extract.extract_items(varied(spark, sf))
    blank = F.lit("")
    return items.select(
        "file_path", "method", "qualname", "path", "signature", F.coalesce("docstring", blank).alias("docstring"), "lineno",
        F.array_join("actual_params", "|").alias("params"), F.array_join("status_codes", "|").alias("status_codes"),
        F.coalesce("summary_from_decorator", blank).alias("summary"), F.coalesce("operation_id", blank).alias("operation_id"),
        F.coalesce("return_type", blank).alias("return_type"))


@query
def extract_wiring(spark, sf):
    """Router inclusions and middleware as rows of their own."""
    items = extract.items_from_facts(extract.scan_facts(varied(spark, sf), wiring=True))
    return items.where(F.col("method").isin("ROUTER_INCLUSION", "MIDDLEWARE")).select("file_path", "method", "qualname", "path", "signature", "lineno")


_EDITED = f"""
SELECT p_brand AS project, 'latest' AS snapshot_id, '/e/part' || p_partkey || '.py' AS file_path, 'part' || p_partkey || '.py' AS rel_path,
 'part' || p_partkey AS module, CASE CAST(p_partkey % 5 AS INT)
 WHEN 0 THEN {_lines("'def price('", "'    qty: int,'", "'    rate=' || p_size || ','", "') -> float:'", "{zero}'    return qty'")}
 WHEN 1 THEN {_lines("'def price(qty):' || {one}'return ' || p_size")}
 WHEN 2 THEN {_lines("'def price(qty):'", "{two}'    return qty'")}
 WHEN 3 THEN {_lines("'@deco(' || p_size || ')'", "'class Price:  # note'", "{three}'    # more'", "'    x = 1'")}
 ELSE {_lines("'def price(qty): ' || {four}'return 1'")} END AS source
FROM {{{{part}}}}
"""
_QUOTES = "\\\"\\\"\\\""
EDITED = {
    "before": _EDITED.format(zero="", one="' ' || ", two=f"'    ''''''Old \"text\".' || {NL} || '    ''''''' || {NL} || ", three="", four="'\"Old.\"; ' || "),
    "after": _EDITED.format(
        zero=f"'    \"\"\"Cost of ' || p_brand || '.\"\"\"' || {NL} || ",
        one=f"{NL} || '    \"\"\"Cost of ' || p_brand || '.\"\"\"' || {NL} || '    ' || ",
        two=f"'    \"\"\"Say {_QUOTES}hi{_QUOTES} to ' || p_brand || '\"\"\"' || {NL} || ",
        three=f"'    \"\"\"Cost of ' || p_brand || '.\"\"\"' || {NL} || ",
        four="").replace("'def price(qty): ' || \n", ""),
}
VARIED_EDITS = """
SELECT p_brand AS project, '/e/part' || p_partkey || '.py' AS file_path, 'part' || p_partkey AS module, 'FUNCTION' AS method,
 CASE WHEN p_partkey % 5 = 3 THEN 2 ELSE 1 END AS lineno, CASE CAST(p_partkey % 5 AS INT) WHEN 2 THEN 'Say \"\"\"hi\"\"\" to ' || p_brand WHEN 4 THEN ''
 ELSE 'Cost of ' || p_brand || '.' END AS new_docstring, p_partkey AS edited_at FROM {part} WHERE p_partkey % 10 < 8
"""


@query
def patch_varied(spark, sf):
    """Signatures over several lines, bodies beside their header, quotes in the text, comments, removals."""
    sources = b.bound(spark, sf, EDITED["before"])
    out = patch.patch_docstrings(sources, b.bound(spark, sf, VARIED_EDITS), "next")
    return out.select("file_path", "source", F.array_join(F.transform("patch_status", lambda s: s["status"]), "|").alias("status"))


@query
def written_sources(spark, sf):
    """A patched snapshot beside the one before it."""
    path = fresh(spark, "sources")
    before = b.bound(spark, sf, EDITED["before"])
    store.write_sources(before, path)
    store.write_sources(patch.patch_docstrings(before, b.bound(spark, sf, VARIED_EDITS), "next").drop("patch_status"), path)
    return spark.read.parquet(path).select("project", "snapshot_id", "file_path", "source")


# ---- reports, history, ledgers --------------------------------------------------------


@query
def report_file(spark, sf):
    """Items written as a report of JSON lines and imported again."""
    path = fresh(spark, "report")
    store.export_items_json(b.items(spark, sf), path)
    items = store.read_items(spark, path, "back", rows_are_lines=True)
    return items.select("project", "module", "qualname", "method", "lineno", F.md5("docstring").alias("digest"), F.array_join("tags", "|").alias("tags"),
                        F.array_join(F.transform("param_types", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|").alias("types"))


@query
def stored_items(spark, sf):
    """All snapshots written, then one project's anew: the others stay."""
    path = fresh(spark, "items")
    items = b.items(spark, sf)
    store.write_items(items, path)
    store.write_items(items.where("project = 'p0' AND method = 'CLASS'"), path)
    return spark.read.parquet(path).groupBy("project", "snapshot_id").agg(F.count("*").alias("items"))


@query
def report_exists(spark, sf):
    """Which of the reports asked for there are."""
    items = b.items(spark, sf)
    asked = items.select("project", F.explode(F.array(F.lit("latest"), F.lit("never"))).alias("snapshot_id")).distinct()
    return store.report_status(items, asked)


@query
def history_file(spark, sf):
    """Snapshots with their kinds written as JSON records and imported again."""
    path = fresh(spark, "history")
    snaps, groups = b.snapshots(spark, sf), b.groups(spark, sf)
    kinds = groups.where("level = 'method'").groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(
        "name", F.struct("total", "documented", "coverage")))).alias("coverage_by_type"))  # a handful of kinds
    snaps.join(kinds, "project", "left").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("project").alias("project_path"), "total_items", "documented_items",
        "coverage_percent", "coverage_by_type", F.struct(F.lit("local").alias("scan_type"), F.lit(3).alias("total_files"), F.lit(0.5).alias("scan_time")).alias("metadata")
    ).write.json(path)
    back, stats = store.read_history(spark, path, rows_are_lines=True)
    one = stats.groupBy("project", "ts").agg(F.count("*").alias("kinds"), F.sum("total").alias("kind_total"))
    return back.join(one, ["project", "ts"], "left").select("project", "ts", "total_items", "documented_items", "coverage_percent", "scan_type", "total_files",
                                                            "scan_time", "kinds", "kind_total")


@query
def ledger_file(spark, sf):
    """Requests written as ledgers of both layouts and imported again."""
    path = fresh(spark, "ledger")
    rows = b.usage(spark, sf)
    request = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "model", "prompt_tokens", "completion_tokens", "total_tokens", "context")
    flat = F.col("event_id") % 2 == 0
    rows.select(F.when(flat, F.array(request)).alias("requests"),
                F.when(~flat, F.create_map("project", F.struct(F.array(request).alias("requests")))).alias("projects")).write.json(path)
    back = store.read_usage(spark, path, rows_are_lines=True, flat_project="flat")
    return back.groupBy("project", "model", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.max("context").alias("last_context"))


@query
def overview_file(spark, sf):
    """Overview texts per project written as JSON and imported again."""
    path = fresh(spark, "overview")
    b.bound(spark, sf, b.OVERVIEWS).write.partitionBy("project").json(path)
    back = [store.read_overview(spark, f"{path}/project={p}", p, rows_are_lines=True) for p in ("p0", "p1", "p2", "p3")]  # p3: a missing file
    return back[0].union(back[1]).union(back[2]).union(back[3])


@query
def history_table(spark, sf):
    """Snapshots appended in batches, one of them twice, with the newest 10 kept per project."""
    path = fresh(spark, "history")
    snaps = b.snapshots(spark, sf)
    for k in (0, 1, 2, 1):
        versions.append(snaps.where(F.day("ts") % 3 == k), path, f"batch-{k}", 10)
    return versions.read(spark, path)


@query
def usage_table(spark, sf):
    """Requests appended in batches with the newest 1,000 kept per project."""
    path = fresh(spark, "usage")
    rows = b.usage(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in (0, 1, 1):
        versions.append(rows.where(F.day("ts") % 2 == k), path, f"batch-{k}", 1000, ("event_id",))
    return versions.read(spark, path, ("event_id",)).select("project", "event_id", "ts")


@query
def price_requests_by_table(spark, sf):
    """The given price list as a table, joined."""
    table = pr.price_table(spark).selectExpr("model", "cast(input_per_million as decimal(10,4)) as input_per_million",
                                             "cast(output_per_million as decimal(10,4)) as output_per_million", "list_rank")
    priced = usage.price_requests_by_table(b.usage(spark, sf), table)
    return priced.select("event_id", "price_key", F.col("cost").cast("double").alias("cost"))


PART_PRICES = """
SELECT 'part-' || p_partkey AS model, CAST(p_size AS DECIMAL(10,4)) AS input_per_million, CAST(2 * p_size AS DECIMAL(10,4)) AS output_per_million,
 CAST(p_partkey AS INT) AS list_rank FROM {part}
UNION ALL SELECT 'default', 1, 3, 100000000
"""
PART_REQUESTS = """
SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'PART-' || user_id WHEN 1 THEN 'my-part-' || user_id || '-2024' WHEN 2 THEN 'rt-' || user_id % 50 ELSE props END AS model,
 CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens FROM {events}
"""


@query
def price_requests_long_list(spark, sf):
    """A price per part: a list as long as the table."""
    priced = usage.price_requests_by_table(b.bound(spark, sf, PART_REQUESTS), b.bound(spark, sf, PART_PRICES))
    return priced.select("event_id", "price_key", F.col("cost").cast("double").alias("cost"))


# ---- pages ----------------------------------------------------------------------------


def _page_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("project", "page_kind", F.col("value").alias("text"))


@query
def written_pages(spark, sf):
    """A page of all projects written to text files and read again."""
    path = fresh(spark, "pages")
    store.write_pages(pages.page_coverage(b.items(spark, sf), GENERATED), path)
    return _page_lines(spark, path)


@query
def written_diagrams(spark, sf):
    """Diagram files of all projects; pages of other kinds are not written."""
    path = fresh(spark, "diagrams")
    items = b.items(spark, sf)
    drawn = graph.diagram_lines(items, graph.DIAGRAMS["detailed"])
    others = pages.page_coverage(items, GENERATED).select(*drawn.columns)
    store.write_diagrams(drawn.union(others), path)
    return _page_lines(spark, path)


# ---- scans in a stream ----------------------------------------------------------------


@query
def stream_scans(spark, sf):
    """Coverage of each scan, recorded when its last item or its marker has come."""
    base = fresh(spark, "scans")
    schema = b.table(spark, sf, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    items = spark.sql(b.spark_text(b.ITEMS), documents=documents, labels=b.table(spark, sf, "labels"))
    sizes = b.items(spark, sf).groupBy("project", "snapshot_id").agg(F.count("*").alias("expected_items"))
    regions = spark.readStream.schema(b.table(spark, sf, "region").schema).parquet(f"{sf}/region.parquet*")
    markers = regions.select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("project")).join(sizes, "project")
    columns = ["project", "snapshot_id", "method", "module", "docstring"]
    rows = items.select(*columns, F.lit(None).cast("long").alias("expected_items")).unionByName(
        markers.select("project", "snapshot_id", *[F.lit(None).cast("string").alias(c) for c in columns[2:]], "expected_items"))
    jobs.stream_scans(rows, f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.read_scans(spark, f"{base}/out").select("project", "snapshot_id", "level", "name", "total", "documented")
