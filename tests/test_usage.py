import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmetrics.functions import prices as pr
from docmetrics.operators import usage

FIELDS = (
    "project string, ts timestamp_ntz, model string, prompt_tokens bigint, completion_tokens bigint,"
    " total_tokens bigint, cost double, context string"
)
NANO = "gpt-4.1-nano-2025-04-14"
SAMPLE = [
    ("p", dt.datetime(2025, 7, 30, 8, 32, 37), NANO, 293, 71, 364, 1.154, "a"),
    ("p", dt.datetime(2025, 7, 30, 8, 33, 4), NANO, 301, 92, 393, 1.338, "b"),
    ("p", dt.datetime(2025, 7, 30, 8, 37, 55), NANO, 301, 92, 393, 0.000067, "c"),
]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, FIELDS)


def test_sample_is_repriced(sample):
    costs = [float(r.cost) for r in usage.price_requests(sample).orderBy("ts").collect()]
    assert costs == [0.000058, 0.000067, 0.000067]
    wrong = usage.reprice_audit(sample).orderBy("ts").collect()
    assert [r.cost for r in wrong] == [1.154, 1.338]


def test_price_names(spark):
    names = ["gpt-4.1-mini", "GPT-4O", "gpt-4.1-nano-2030-01-01", "my-o3-x", "claimed", "", "o4-mini-high"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    row = lambda match: [r[0] for r in df.select(pr.price_key(F.col("m"), match=match)).collect()]
    assert row("first") == ["gpt-4.1-mini", "gpt-4o", "gpt-4.1", "o3", "default", "gpt-4.1", "o4-mini"]
    assert row("longest")[2] == "gpt-4.1-nano"
    assert row("exact") == ["gpt-4.1-mini", "gpt-4o", "default", "default", "default", "default", "default"]


def test_costs_match_double_arithmetic(spark):
    rows = [(p.model, i * 37 + 1, i * 11) for p in pr.PRICE_LIST for i in range(200)]
    df = spark.createDataFrame(rows, "m string, a bigint, b bigint")
    listed = {p.model: (float(p.input) / 1e6, float(p.output) / 1e6) for p in pr.PRICE_LIST}
    out = df.select("*", pr.request_cost(F.col("m"), F.col("a"), F.col("b")).alias("c"), pr.estimate_cost(F.col("m"), F.col("a")).alias("e"))
    for r in out.collect():
        i, o = listed[r.m]
        assert float(r.c) == pytest.approx(round(r.a * i + r.b * o, 6), abs=1.01e-6)
        assert float(r.e) == pytest.approx(round(int(r.a * 0.7) * i + int(r.a * 0.3) * o, 6), abs=1.01e-6)


def test_labels_and_texts(spark):
    df = spark.createDataFrame([("gpt-4.1", 0.0001234), ("o9", 0.00567), ("o3", 0.5), ("o3", 12.345)], "m string, c double")
    rows = df.select(pr.price_label(F.col("m")).alias("l"), pr.format_cost(F.col("c")).alias("t")).collect()
    assert [r.t for r in rows] == ["$0.000123", "$0.00567", "$0.5000", "$12.35"]
    assert rows[0].l == "$0.00000/$0.00001"


def test_price_list_is_bounded():
    with pytest.raises(ValueError):
        pr.price_key(None, [pr.Price(f"m{i}", "1", "1") for i in range(pr.MAX_PRICES + 1)])
    with pytest.raises(ValueError):
        pr.price_key(None, [pr.Price("a", "1", "1")])


def test_price_table(spark):
    rows = pr.price_table(spark).orderBy("list_rank").collect()
    assert len(rows) == 9 and rows[0].model == "gpt-4.1" and rows[-1].model == "default"


def test_rollups(spark):
    rows = [
        ("p", dt.datetime(2025, 12, 31, 23, 59), "o3", 1, 1, 2, 0.5, ""), ("p", dt.datetime(2026, 1, 1), "o3", 1, 1, 2, 0.25, ""),
        ("p", dt.datetime(2025, 12, 1), "o4-mini", 1, 1, 2, 0.125, ""), ("q", dt.datetime(2025, 12, 1), "o3", 1, 1, 2, 1.0, ""),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    totals = {r.project: (r.total_cost, r.total_requests) for r in usage.usage_totals(df).collect()}
    assert totals == {"p": (0.875, 3), "q": (1.0, 1)}
    month = {(r.project, r.part, r.name): (r.requests, r.cost, r.tokens) for r in usage.usage_month(df, 2025, 12).collect()}
    assert month[("p", "total", "")] == (2, 0.625, 4)
    assert month[("p", "model", "o3")] == (1, 0.5, 2) and month[("p", "day", "2025-12-01")] == (1, 0.125, 2)
    stats = usage.usage_stats(df, dt.datetime(2025, 12, 31, 12)).filter("project = 'p'").first()
    assert (stats.today_cost, stats.month_cost, stats.total_cost) == (0.5, 0.625, 0.875)
    assert (stats.today_requests, stats.month_requests, stats.total_requests) == (1, 2, 3)


def test_reset(spark, sample):
    resets = spark.createDataFrame(
        [("p", dt.datetime(2025, 7, 30, 8, 33)), ("p", dt.datetime(2025, 7, 1))], "project string, reset_at timestamp_ntz"
    )
    assert usage.since_reset(sample, resets).count() == 2
    assert usage.since_reset(sample, resets.filter("false")).count() == 3


def test_recent(sample):
    rows = usage.recent_requests(sample, 2).orderBy("place").collect()
    assert [r.context for r in rows] == ["c", "b"]
    assert [r.context for r in usage.recent_requests(sample, 2, ()).collect()] == ["c", "b"]
    assert usage.retain_usage(sample, 1).first().context == "c"


def test_long_price_list_is_never_sent_whole(spark, tmp_path):
    names = [f"part-{i}" for i in range(300)]
    spark.createDataFrame([(n, i) for i, n in enumerate([*names, "default"])], "model string, list_rank int").write.parquet(f"{tmp_path}/p")
    asked = ["PART-7", "my-part-120-2024", "rt-12", "none", None, "default", "", "long-names-part-299"]
    spark.createDataFrame([(i, n) for i, n in enumerate(asked)], "id int, model string").write.parquet(f"{tmp_path}/r")
    prices = spark.read.parquet(f"{tmp_path}/p").withColumns({
        "input_per_million": F.col("list_rank").cast("decimal(10,4)"), "output_per_million": F.lit(0).cast("decimal(10,4)")})
    requests = spark.read.parquet(f"{tmp_path}/r").withColumns({"prompt_tokens": F.lit(10**6), "completion_tokens": F.lit(0)})
    out = usage.price_requests_by_table(requests, prices)
    got = {r.id: (r.price_key, int(r.cost)) for r in out.collect()}
    want = ["part-7", "part-1", "part-12", "default", "default", "default", "part-0", "part-2"]
    assert got == {i: (k, 300 if k == "default" else int(k[5:])) for i, k in enumerate(want)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    # Without a default row, what matches nothing has no price.
    assert {r.id for r in usage.price_requests_by_table(requests, prices.where("model <> 'default'")).collect()} == {0, 1, 2, 6, 7}
