import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docmetrics.operators import coverage as cov
from docmetrics.plans import pages
from docmetrics.sources import files, store
from docmetrics.sources.extract import extract_items
from docmetrics.streaming import jobs


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="docmetrics-store-")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mode = "wb" if isinstance(text, bytes) else "w"
    with open(path, mode) as f:
        f.write(text if isinstance(text, bytes) else text if isinstance(text, str) else json.dumps(text))
    return path


def test_tree(spark, folder):
    kept = {"a.py": "def a(): pass\n", "pkg/b.py": "x = 1\r\ndef b(): pass\r\n", "test_c.py": "#\n", "pkg/tests/d.py": "#\n"}
    dropped = [
        "__init__.py", "_x.py", "setup.py", "conftest.py", "manage.py", "Migrations/m.py", "__pycache__/c.py",
        "tests/test_e.py", "0123456789ab_x.py", "notes.txt",
    ]
    for name, text in kept.items():
        put(f"{folder}/{name}", text)
    for name in dropped:
        put(f"{folder}/{name}", "def no(): pass\n")
    put(f"{folder}/bad.py", b"\xff\xfe\x00")
    put(f"{folder}/empty.py", "")  # Spark's file scan passes over files of no bytes
    df = files.read_sources(spark, folder, "demo")
    rows = {r.rel_path: r for r in df.collect()}
    assert set(rows) == {*kept, "bad.py"}
    assert rows["pkg/b.py"].source == "x = 1\ndef b(): pass\n" and rows["pkg/b.py"].module == "b"
    assert rows["bad.py"].source is None
    assert {r.qualname for r in extract_items(df).collect()} == {"a", "b"}
    # Names with a leading underscore are hidden to the file scan; folders can be asked for.
    every = {r.rel_path for r in files.read_sources(spark, folder, "demo", documentable_only=False).collect()}
    assert every == {*kept, *dropped, "bad.py"} - {"__init__.py", "_x.py", "__pycache__/c.py", "notes.txt"}
    put(f"{folder}/_core/c.py", "def c(): pass\n")
    put(f"{folder}/pkg/_in/d.py", "def d(): pass\n")
    asked = files.read_sources(spark, folder, "demo", also=["_core", "*/_*"])
    assert {r.rel_path for r in asked.collect()} == {*kept, "bad.py", "_core/c.py", "pkg/_in/d.py"}
    assert files.read_sources(spark, folder, "demo", exclude=["pkg"]).count() == 3
    assert files.read_sources(spark, f"{folder}/a.py", "demo").first().rel_path == "a.py"
    listed = {r.path: r for r in files.list_files(files.read_landed(spark, folder, "demo")).collect()}
    assert listed["pkg/b.py"].name == "b.py" and listed["pkg/b.py"].full_path == f"{folder}/pkg/b.py"
    assert files.read_sources(spark, folder, "demo", max_bytes=3).count() == 3


def test_landing_stream(spark, folder):
    put(f"{folder}/in/a.py", "def a(): pass\n")
    put(f"{folder}/in/sub/b.py", "class B:\n    def c(self): pass\n")
    stream = jobs.stream_items(files.stream_sources(spark, f"{folder}/in", "demo"))
    got = jobs.drain(stream.select("file_path", "item_ordinal", "qualname"), ["file_path", "item_ordinal"])
    assert sorted(r.qualname for r in got.collect()) == ["B", "B.c", "a"]


def test_history_stream_keeps_batches_apart(spark, folder):
    put(f"{folder}/in/a.py", "def a(): pass\n")
    put(f"{folder}/in/b.py", 'def b():\n    """B."""\n')
    items = jobs.stream_items(files.stream_sources(spark, f"{folder}/in", "demo", max_files_per_trigger=1))
    run = jobs.stream_history(items, f"{folder}/snaps", f"{folder}/groups", f"{folder}/state")
    run.awaitTermination()
    rows = spark.read.parquet(f"{folder}/snaps").collect()
    assert sorted(r.documented_items for r in rows) == [0, 1]


def test_report_round_trip(spark, folder, make_items):
    item = {"module": "m", "qualname": "f", "method": "FUNCTION", "docstring": "x", "lineno": 3,
            "param_types": {"a": "int", "b": "str"}, "dependency_docs": {}, "tags": ["t"]}
    path = put(f"{folder}/report.json", [item, {**item, "qualname": "g", "docstring": None}])
    items = store.read_items(spark, path, "demo", "s1")
    rows = items.orderBy("item_ordinal").collect()
    assert [(r.qualname, r.docstring) for r in rows] == [("f", "x"), ("g", None)]
    assert sorted((p.name, p.type) for p in rows[0].param_types) == [("a", "int"), ("b", "str")]
    store.export_items_json(items, f"{folder}/out")
    again = store.read_items(spark, f"{folder}/out", "demo", "s1", rows_are_lines=True)
    assert sorted(r.qualname for r in again.collect()) == ["f", "g"]
    assert store.read_items(spark, f"{folder}/none.json").count() == 0
    assert store.read_items(spark, put(f"{folder}/broken.json", "{nope")).count() == 0
    assert store.read_items(spark, put(f"{folder}/dict.json", {"a": 1})).count() == 0


def test_items_table_replaces_only_its_snapshots(spark, folder, make_items):
    path = f"{folder}/items"
    store.write_items(make_items([{"qualname": "a"}, {"qualname": "b", "project": "other"}]), path)
    store.write_items(make_items([{"qualname": "c"}]), path)
    stored = spark.read.parquet(path)
    assert {(r.project, r.qualname) for r in stored.collect()} == {("demo", "c"), ("other", "b")}
    assert {(r.project, r["items"]) for r in store.report_status(stored).collect()} == {("demo", 1), ("other", 1)}


def test_history_json(spark, folder):
    record = {
        "timestamp": "2024-01-01T10:00:00.123456", "project_path": "/p", "total_items": 4, "documented_items": 2,
        "coverage_percent": 50.0, "coverage_by_type": {"GET": {"total": 2, "documented": 1, "coverage": 50.0}},
        "coverage_by_module": {"m": {"total": 4, "documented": 2, "coverage": 50.0}},
        "metadata": {"scan_type": "local", "total_files": 3},
    }
    snaps, groups = store.read_history(spark, put(f"{folder}/h.json", [record, {**record, "coverage_by_type": {}}]))
    row = snaps.orderBy("seq").first()
    assert row.ts == dt.datetime(2024, 1, 1, 10, 0, 0, 123456) and row.scan_type == "local"
    assert sorted((r.level, r.name, r.total) for r in groups.collect()) == [("method", "GET", 2), ("module", "m", 4), ("module", "m", 4)]
    store.append_history(snaps, f"{folder}/history")
    store.append_history(snaps, f"{folder}/history")
    assert spark.read.parquet(f"{folder}/history").count() == 4
    assert store.read_history(spark, f"{folder}/none.json")[0].count() == 0


def test_ledger_layouts(spark, folder):
    request = {"timestamp": "2025-07-30T08:32:37", "model": "o3", "prompt_tokens": 1, "completion_tokens": 2,
               "total_tokens": 3, "cost": 0.1, "context": "c"}
    flat = put(f"{folder}/flat.json", {"total_cost": 0.1, "requests": [request]})
    nested = put(f"{folder}/nested.json", {"projects": {"x": {"requests": [request, request]}, "y": {"requests": []}}, "current_project": "x"})
    assert [r.project for r in store.read_usage(spark, flat).collect()] == ["default"]
    rows = store.read_usage(spark, nested)
    assert [r.project for r in rows.collect()] == ["x", "x"] and rows.first().ts == dt.datetime(2025, 7, 30, 8, 32, 37)
    store.append_usage(rows, f"{folder}/usage")
    assert spark.read.parquet(f"{folder}/usage").filter("month = '2025-07'").count() == 2


def test_overview(spark, folder, make_items):
    path = put(f"{folder}/o.json", {"project_purpose": "To sell.", "business_context": None})
    row = store.read_overview(spark, path, "demo").first()
    assert row.has_overview and row.business_context == "" and row.key_business_value == ""
    blank = store.read_overview(spark, put(f"{folder}/b.json", {"project_purpose": " \n"}), "demo").first()
    assert not blank.has_overview
    lines = pages.page_overview(make_items([{"qualname": "a"}]), store.read_overview(spark, path, "demo"))
    text = [r.text for r in lines.orderBy("section", "line_no").collect()]
    assert "**Project Purpose:** To sell." in text and not any("Context" in t for t in text)


def test_page_files_keep_order(spark, folder, make_items):
    items = make_items([{"qualname": f"q{i:04d}", "method": "FUNCTION", "module": f"m{i % 7}"} for i in range(500)])
    page = pages.page_structure(items)
    store.write_pages(page, f"{folder}/pages")
    base = f"{folder}/pages/project=demo/page_kind=code_structure"
    parts = sorted(os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs if f.startswith("part"))
    written = [x for p in parts for x in open(p).read().split("\n")[:-1]]
    wanted = [r.text for r in page.orderBy(*store.PAGE_ORDER).collect()]
    assert written == wanted


def test_unwritten(spark):
    a = spark.createDataFrame([("k1",), ("k2",)], "content_key string")
    assert [r[0] for r in store.unwritten(a, a.filter(F.col("content_key") == "k1")).collect()] == ["k2"]


def test_scan_metadata(spark, folder):
    put(f"{folder}/a.py", "#\n")
    row = cov.scan_metadata(files.read_sources(spark, folder, "demo"), "local", 1.5).first()
    assert (row.scan_type, row.total_files, row.scan_time) == ("local", 1, 1.5)


def test_bad_fields_cost_one_field(spark, tmp_path):
    from pyspark.sql import types as T

    from docmetrics.sources.store import _json, bad_records

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "x.json").write_text('{"name": "a", "n": 1}\n{"name": "b", "n": "text"}\nnot json\n')
    rows = _json(spark, str(tmp_path), schema, True).collect()
    assert sorted((r.name, r.n) for r in rows) == [("a", 1), ("b", None)]
    bad = bad_records(spark, str(tmp_path), schema).collect()
    assert sorted(r.record for r in bad) == ["not json", '{"name": "b", "n": "text"}']


def test_times_with_an_offset_are_moved(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from docmetrics.sources.store import _timestamp

    given = ["2025-07-29T23:30:00.123456-05:00", "2025-07-29T23:30:00", "2025-07-29T23:30:00Z", "2025-07-29 23:30:00+0230", "junk", None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in given], "x string").select(_timestamp(F.col("x")).alias("t")).collect()]
    at = dt.datetime(2025, 7, 29, 23, 30)
    assert got == [dt.datetime(2025, 7, 30, 4, 30, 0, 123456), at, at, at - dt.timedelta(hours=2, minutes=30), None, None]


def test_pages_of_other_projects_stay(spark, tmp_path):
    from docmetrics.sources.store import write_pages

    def lines(project, text):
        return spark.createDataFrame([(project, "k", "x", 0, "", 0, 0, text)],
                                     "project string, page_kind string, page_key string, section int, k1 string, k2 long, line_no int, text string")

    write_pages(lines("a", "one"), str(tmp_path / "p"))
    write_pages(lines("b", "two"), str(tmp_path / "p"))
    write_pages(lines("b", "three"), str(tmp_path / "p"))
    assert sorted((r.project, r.value) for r in spark.read.text(str(tmp_path / "p")).collect()) == [("a", "one"), ("b", "three")]


def test_streams_read_folders_and_nothing(spark, tmp_path):
    from docmetrics.plans.catalog import stream_table
    from docmetrics.streaming.jobs import drain

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    assert drain(stream_table(spark, str(tmp_path), "t").groupBy("id").count(), ["id"]).count() == 10
    spark.range(0).repartition(1).write.parquet(str(tmp_path / "u.parquet"))
    empty = drain(stream_table(spark, str(tmp_path), "u").groupBy("id").count(), ["id"])
    assert empty.columns == ["id", "count"] and empty.count() == 0


def test_rounding_of_any_magnitude(spark):
    from pyspark.sql import functions as F

    from docmetrics.functions.numbers import exact_round

    given = [0.05, 0.005, 0.15, 2.675, 0.125, 0.375, -0.125, 1e-9, 1e-300, 123456.785, 1e15 + 0.5, 4.5e15, 1e300, 99.995, 1.005, 0.0]
    df = spark.createDataFrame([(x,) for x in given], "x double")
    for digits in (1, 2, 3, 6):
        got = [r.y for r in df.select(exact_round(F.col("x"), digits).alias("y")).collect()]
        assert got == [round(x, digits) for x in given], digits


def test_tree_is_listed_by_executors(spark, folder):
    for i in range(300):
        put(f"{folder}/d{i % 7}/e{i % 3}/f{i}.py", f"x = {i}\n")
    put(f"{folder}/d0/_in/g.py", "x = 0\n")
    put(f"{folder}/d0/empty.py", "")
    df = files.read_sources(spark, folder, "demo")
    assert {r.rel_path: r.source for r in df.collect()} == {f"d{i % 7}/e{i % 3}/f{i}.py": f"x = {i}\n" for i in range(300)}
    assert not [f for f in df.inputFiles() if f.endswith(".py")]  # the driver holds no list of them
    empty = f"{folder}/none"
    os.makedirs(empty)
    assert files.read_sources(spark, empty, "demo").count() == 0


def test_landed_files_take_few_tasks(spark, folder):
    for i in range(400):
        put(f"{folder}/in/d{i % 3}/f{i}.py", f"x = {i}\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    jobs.landed(files.stream_sources(spark, f"{folder}/in", "demo"), f"{folder}/state", f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out")
    assert {r.source for r in rows.collect()} == {f"x = {i}\n" for i in range(400)}
    assert len(rows.inputFiles()) <= spark.sparkContext.defaultParallelism  # not a task for each 32 files
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_landed_files_keep_no_list_on_the_driver(spark, tmp_path):
    """Two waves of part files: each taken once and archived, and no name of theirs in the driver's log of the stream."""
    from docmetrics.plans import stored

    spark.createDataFrame([(i, f"n{i % 17}", f"b{i % 3}", f"t{i % 4}", i % 11 + 1, 1.0) for i in range(300)] * 2,
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = {(r.rel_path, r.module, r.digest) for r in stored.landed_files(spark, str(tmp_path)).collect()}
    want = stored.digested(stored.tree(spark, str(tmp_path)).where("not contains(rel_path, '/tests/') and not contains(rel_path, '/_')"))
    assert got == {(r.rel_path, r.module, r.digest) for r in want.collect()} and len(got) == 300 - 34 - 38
    base = f"{shared}/{next(x for x in os.listdir(shared) if x.startswith('landing-') and x not in before)}"
    log = "".join(open(os.path.join(d, f), errors="replace").read() for d, _, fs in os.walk(f"{base}/state/sources") for f in fs if not f.endswith(".crc"))
    assert ".parquet" in log and ".py" not in log
    taken = {os.path.join(d, f).partition("/in/")[2] for d, _, fs in os.walk(f"{base}/done") for f in fs}
    assert taken >= {r[0] for r in got} and not [f for _, _, fs in os.walk(f"{base}/in") for f in fs if f.startswith("part")]


def test_listed_files_are_taken_once(spark, folder):
    def run():
        stream = files.stream_sources(spark, f"{folder}/in", "demo", max_files_per_trigger=2, archive=f"{folder}/done", listed=f"{folder}/listed")
        jobs.landed(stream, f"{folder}/state", f"{folder}/out")
        return sorted((r.rel_path, r.source) for r in spark.read.parquet(f"{folder}/out").collect())

    for i in range(9):
        put(f"{folder}/in/d{i % 2}/f{i}.py", f"x = {i}\n")
    put(f"{folder}/in/d0/_g.py", "x = 0\n")
    put(f"{folder}/in/d0/empty.py", "")
    first = [(f"d{i % 2}/f{i}.py", f"x = {i}\n") for i in range(9)]
    assert run() == sorted(first)
    # What was listed but not read yet is read where it was moved to.
    put(f"{folder}/in/late.py", "y = 1\n")
    files.list_landed(spark, f"{folder}/in", f"{folder}/listed", archive=f"{folder}/done")
    files.list_landed(spark, f"{folder}/in", f"{folder}/listed", archive=f"{folder}/done", take=False)
    assert not os.path.exists(f"{folder}/in/late.py") and os.path.exists(f"{folder}/done{folder}/in/late.py")
    put(f"{folder}/in/d0/f0.py", "again = 1\n")  # under a path that was taken
    put(f"{folder}/in/new.py", "z = 1\n")
    want = sorted([*first, ("late.py", "y = 1\n"), ("new.py", "z = 1\n")])
    assert run() == want and run() == want
    assert open(f"{folder}/done{folder}/in/d0/f0.py").read() == "x = 0\n" and open(f"{folder}/in/d0/f0.py").read() == "again = 1\n"
    with pytest.raises(ValueError):
        files.list_landed(spark, f"{folder}/in", f"{folder}/listed", archive=f"{folder}/in/done")
