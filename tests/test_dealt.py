"""Part files that are few bytes on disk are still parsed and written by many tasks."""

import pytest

from docmetrics.plans import bindings as b
from docmetrics.plans import catalog, stored


@pytest.fixture
def sf(spark, tmp_path):
    rows = [(i, f"n{i}", "Brand#1", "LARGE", i, 1.0) for i in range(40)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def tasks(df):
    return df.rdd.getNumPartitions()


def test_varied_sources_are_dealt_out(spark, sf):
    assert tasks(stored.varied(spark, sf)) >= spark.sparkContext.defaultParallelism
    assert stored.QUERIES["extract_wiring"](spark, sf).count() == 80
    assert {r.n for r in stored.QUERIES["extract_varied"](spark, sf).groupBy("file_path").count().withColumnRenamed("count", "n").collect()} == {11}


def test_streamed_sources_are_dealt_out(spark, sf, monkeypatch):
    seen = []
    real = catalog.jobs.stream_items
    monkeypatch.setattr(catalog.jobs, "stream_items", lambda sources: (seen.append(sources), real(sources))[1])
    assert sum(r["items"] for r in catalog.QUERIES["stream_items"](spark, sf).collect()) > 40
    assert "Repartition" in seen[0]._jdf.queryExecution().analyzed().toString()


def test_changed_sources_are_dealt_out_and_not_broadcast(spark, sf):
    after = b.changed_sources(spark, sf)
    assert tasks(after) >= spark.sparkContext.defaultParallelism
    changed = catalog.files.changed_sources(after, b.sources(spark, sf))
    assert "Broadcast" not in changed._jdf.queryExecution().executedPlan().toString()
    assert changed.count() == 18  # even sizes; 0 and 34 hold no docstring to edit
