import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmetrics.operators import coverage as cov
from docmetrics.operators import history as hist

FOUR = [
    {"module": "main", "qualname": "root", "method": "GET", "path": "/", "lineno": 5, "docstring": "Root endpoint."},
    {"module": "main", "qualname": "get_user", "method": "GET", "path": "/users/{user_id}", "lineno": 10},
    {"module": "main", "qualname": "UserService.create_user", "method": "function", "lineno": 15,
     "docstring": "Create a new user."},
    {"module": "main", "qualname": "UserService.get_user", "method": "function", "lineno": 19},
]


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_four_items(make_items):
    items = make_items(FOUR)
    total = cov.coverage_total(items).first()
    assert (total.total, total.documented, total.coverage_percent) == (4, 2, 50.0)
    snap = table(cov.coverage_snapshot(items), "level", "name")
    assert {k: (v.total, v.documented, v.coverage) for k, v in snap.items()} == {
        ("project", ""): (4, 2, 50.0), ("method", "GET"): (2, 1, 50.0),
        ("method", "function"): (2, 1, 50.0), ("module", "main"): (4, 2, 50.0),
    }


def test_no_items(make_items):
    empty = make_items([])
    row = cov.coverage_total(empty, keys=()).first()
    assert (row.total, row.documented, row.coverage_percent) == (0, 0, 0.0)
    assert cov.coverage_snapshot(empty).count() == 0


def test_missing_fields(make_items):
    items = make_items([{"qualname": "a"}, {"qualname": "b", "docstring": "doc"}, {"qualname": "c", "method": "GET"}])
    assert set(table(cov.coverage_by(items, "method"), "method")) == {("UNKNOWN",), ("GET",)}
    assert set(table(cov.coverage_by(items, "module"), "module")) == {("unknown",)}
    assert cov.coverage_total(items).first().documented == 1


def test_blank_docstrings(make_items):
    items = make_items([{"docstring": ""}, {"docstring": "   "}, {"docstring": None}])
    row = cov.coverage_total(items).first()
    assert (row.documented, row.coverage_percent) == (1, 33.33)
    assert cov.coverage_total(items, rule="B").first().documented == 0


def test_rules(make_items):
    items = make_items([
        {"docstring": None, "full_source": 'def f():\n    """x"""'},
        {"docstring": None, "full_source": 'def f():\n    return """x"""'},
        {"docstring": " ", "full_source": "def f(): pass"},
        {"docstring": "x", "full_source": ""},
    ])
    counts = {r: items.filter(cov.is_documented(r)).count() for r in "ABCDE"}
    assert counts == {"A": 2, "B": 1, "C": 2, "D": 3, "E": 2}


def test_ordered_lists(make_items):
    items = make_items([{"qualname": f"q{i}", "docstring": "x" * (100 + i % 40), "module": "m"} for i in range(300)])
    longest = cov.longest_docstrings(items, 10).orderBy("place").collect()
    want = sorted(((100 + i % 40, i) for i in range(300)), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r.length, r.item_ordinal) for r in longest] == want
    bare = make_items([{"qualname": f"q{i}"} for i in range(25)])
    sample = cov.missing_sample(bare, 10).orderBy("place").collect()
    assert [r.qualname for r in sample] == [f"q{i}" for i in range(10)] and sample[0].more == 15


def test_edits(make_items, spark):
    same = {"module": "m", "qualname": "f", "lineno": 3}
    items = make_items([{**same, "method": "FUNCTION"}, {**same, "method": "GET", "docstring": "old"}])
    edits = spark.createDataFrame(
        [("demo", "m", "f", 3, "first", 1), ("demo", "m", "f", 3, "second", 2)],
        "project string, module string, qualname string, lineno int, new_docstring string, edited_at int",
    )
    rows = cov.apply_docstring_edits(items, edits).orderBy("item_ordinal").collect()
    assert [(r.docstring, r.has_docstring) for r in rows] == [("second", True), ("old", True)]
    gone = edits.withColumn("new_docstring", F.lit(None).cast("string"))
    assert cov.apply_docstring_edits(items, gone).orderBy("item_ordinal").first().docstring is None


def test_snapshot_diff(make_items):
    base = {"signature": "", "full_source": "", "path": "", "method": "FUNCTION"}
    before = make_items([{**base, "qualname": q, "docstring": d} for q, d in [("a", "1"), ("b", "1"), ("c", "1"), ("e", "1"), ("e", "2")]])
    after = make_items([{**base, "qualname": q, "docstring": d} for q, d in [("a", "1"), ("b", "2"), ("d", "1"), ("e", "2"), ("e", "1")]])
    got = {r.qualname: r.change for r in cov.snapshot_diff(before, after).collect()}
    assert got == {"b": "changed", "c": "removed", "d": "added"}


# ---- history --------------------------------------------------------------------------


def snapshots(spark, rows, project="p"):
    data = [(project, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), t, n, round(n / t * 100, 2)) for d, t, n in rows]
    return spark.createDataFrame(
        data, "project string, ts timestamp_ntz, total_items bigint, documented_items bigint, coverage_percent double"
    )


NOW = dt.datetime(2024, 1, 6)


@pytest.mark.parametrize("counts, trend, change", [
    ([1, 2, 3, 4, 5], "improving", 80.0), ([5, 4, 3, 2, 1], "declining", -80.0), ([3, 3, 3], "stable", 0.0), ([2], "stable", 0.0),
])
def test_trend(spark, counts, trend, change):
    df = snapshots(spark, [(i, 5, n) for i, n in enumerate(counts)])
    row = hist.coverage_trend(df, NOW, (10,)).first()
    assert (row.trend, row.records_found, row.coverage_change) == (trend, len(counts), change)
    assert row.documented_change == counts[-1] - counts[0]
    assert hist.trend_series(df, NOW, 10).count() == len(counts)


def test_trend_without_data(spark):
    old = snapshots(spark, [(-500, 5, 1)])
    row = hist.coverage_trend(old, NOW, (30,)).first()
    assert (row.trend, row.records_found, row.coverage_change) == ("no_data", 0, None)
    assert hist.coverage_trend(old.filter("false"), NOW).count() == 0


def test_retention(spark):
    df = snapshots(spark, [(i, 5, 1) for i in range(102)]).unionByName(snapshots(spark, [(200, 5, 1)], "other"))
    kept = hist.retain(df, 100).filter("project = 'p'")
    assert kept.count() == 100 and kept.agg(F.min("ts")).first()[0] == dt.datetime(2024, 1, 3)
    assert hist.retain(df, 100, ()).filter("project = 'p'").count() == 99


def test_steps_across_blocks(spark):
    days = [0, 3, 40, 41, 100, 101, 102]
    df = snapshots(spark, [(d, 10, i) for i, d in enumerate(days)])
    rows = hist.coverage_deltas(df).orderBy("ts").collect()
    assert [r.documented_change for r in rows] == [None, 1, 1, 1, 1, 1, 1]


def groups(spark, rows):
    data = [("p", level, name, 100, int(c), float(c), i) for i, (level, name, c) in enumerate(rows)]
    return spark.createDataFrame(
        data, "project string, level string, name string, total bigint, documented bigint, coverage double, first_seen bigint"
    )


def test_best_and_worst_overlap(spark):
    df = groups(spark, [("module", f"m{i}", c) for i, c in enumerate([50, 90, 50, 10, 70, 50, 20])])
    rows = hist.best_worst_modules(df).collect()
    ranked = ["m1", "m4", "m0", "m2", "m5", "m6", "m3"]
    best = {r.place: r.name for r in rows if r.end == "best"}
    worst = {r.place: r.name for r in rows if r.end == "worst"}
    assert [best[i] for i in range(1, 6)] == ranked[:5]
    assert [worst[i] for i in range(3, 8)] == ranked[-5:]


def advice(spark, coverage, rows, trend):
    latest = spark.createDataFrame([("p", coverage)], "project string, coverage_percent double")
    trends = spark.createDataFrame([("p", trend)], "project string, trend string")
    out = hist.recommendations(latest, groups(spark, rows), trends)
    return [r.text for r in out.orderBy("section", "place").collect()]


def test_recommendations_low(spark):
    lines = advice(spark, 25.0, [("method", "GET", 20), ("method", "POST", 30), ("method", "FUNCTION", 10), ("module", "api", 15)], "declining")
    assert len(lines) == 5
    assert lines[0] == hist.CRITICAL and lines[1] == hist.DECLINING
    assert "GET endpoints - only 20.0%" in lines[2] and "POST" in lines[3]
    assert "'api' needs attention - only 15.0%" in lines[4]


def test_recommendations_high(spark):
    lines = advice(spark, 85.0, [("method", "GET", 90), ("module", "api", 90)], "improving")
    assert lines == [hist.EXCELLENT, hist.IMPROVING]
    assert advice(spark, 70.0, [("module", "a", 50)], "stable") == [hist.GOOD]
    assert advice(spark, 30.0, [("module", "a", 50)], "no_data") == [hist.WARNING]


def test_progress_report(spark):
    df = snapshots(spark, [(0, 5, 1), (4, 5, 5)])
    parts = {(r.part, r.name) for r in hist.progress_report(df, groups(spark, [("module", "a", 10), ("method", "GET", 10)]), NOW).collect()}
    assert {("latest", "coverage_percent"), ("trend", "improving"), ("best", "a"), ("worst", "a"), ("missing", "GET")} <= parts


def test_period_bound_ignores_session_zone(spark):
    df = snapshots(spark, [(0, 5, 1), (1, 5, 2)])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.filter(hist.in_period(5, NOW)).count() == 2
        assert df.filter(hist.in_period(4, NOW)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
