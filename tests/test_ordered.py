"""Split windows against plain ones, with one group holding most rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmetrics.operators.ordered import top_k, with_previous


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select(
        "id", key.alias("k"), (F.hash("id") % 50).alias("v"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("mark")
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_top_k(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.asc("id")]
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(*order))).filter("r <= 7")
    assert rows(top_k(df, ["k"], order, 7, "r")) == rows(plain)


def test_top_k_keeps_small_groups_whole(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert rows(top_k(df, ["k"], [F.desc("v")], 100)) == rows(df)


def test_with_previous(spark):
    df = skewed(spark)
    for current, end in ((False, -1), (True, 0)):
        frame = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, end)
        plain = df.withColumn("p", F.last("mark", ignorenulls=True).over(frame))
        by = lambda n: F.floor(F.col("id") / n)
        for blocks in ([], [by(37)], [by(500), by(20)], [by(1000), by(100), by(10)]):
            got = with_previous(df, ["k"], blocks, ["id"], F.col("mark"), "p", current)
            assert rows(got.select(*plain.columns)) == rows(plain)


def test_previous_spans_empty_blocks(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 500, None), ("a", 900, None), (None, 7, 3)], "k string, id int, mark int")
    got = with_previous(df, ["k"], [F.floor(F.col("id") / 10)], ["id"], F.col("mark"), "p")
    assert {(r.k, r.id): r.p for r in got.collect()} == {("a", 1): None, ("a", 500): 5, ("a", 900): 5, (None, 7): None}
