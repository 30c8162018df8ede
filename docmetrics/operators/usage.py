"""Usage ledger: pricing, rollups, audits, resets. Rollups are derived, never stored.

Requests: project, ts, model, prompt_tokens, completion_tokens, total_tokens, cost, context.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions.prices import DEFAULT, PRICE_LIST, Price, in_dollars, request_cost
from docmetrics.functions.times import moment
from docmetrics.operators.history import retain
from docmetrics.operators.ordered import top_k


def price_requests(
    requests: DataFrame, prices: Sequence[Price] = PRICE_LIST, match: str = "first"
) -> DataFrame:
    """Add `cost` as an exact decimal from the price list; no join, no shuffle."""
    return requests.withColumn(
        "cost",
        request_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), prices, match),
    )


#: Letters of the parts by which names are looked up.
PART_LETTERS = 8


def _grams(name, lengths: Sequence[int] | Column):
    """Distinct parts of the given lengths."""
    def of(n):
        last = F.length(name) - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.substring(name, i, n))

    if isinstance(lengths, Column):
        return F.array_distinct(F.flatten(F.transform(lengths, of)))
    return F.array_distinct(F.concat(*[of(F.lit(n)) for n in lengths]))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of names (short, long) where the long one contains the short one, neither being empty.

    Each short name is looked up by its rarest part of eight letters among the long ones (a
    shorter name as a whole), so that a part which all names share brings no pairs together.
    Long names are listed under parts of the lengths asked for only. Neither side of a join is
    sent whole to each machine: a list that is small on disk can be large in memory.
    """
    part = F.least(F.length("short"), F.lit(PART_LETTERS))
    lengths = short.where("short <> ''").agg(F.sort_array(F.collect_set(part)).alias("lengths"))
    listed = long.join(F.broadcast(lengths), F.lit(True)).select("long", F.explode(_grams(F.col("long"), F.col("lengths"))).alias("gram"))
    often = listed.groupBy("gram").agg(F.count("*").alias("n"))
    parts = F.when(F.length("short") >= PART_LETTERS, _grams(F.col("short"), (PART_LETTERS,))).otherwise(F.array("short"))
    asked = short.where("short <> ''").select("short", F.explode(parts).alias("gram")).join(often.hint("merge"), "gram")
    # A name with a part that no long name has is contained in none.
    rarest = asked.groupBy("short").agg(F.min(F.struct("n", "gram")).alias("r"), F.count("*").alias("found"))
    whole = F.when(F.length("short") >= PART_LETTERS, F.size(_grams(F.col("short"), (PART_LETTERS,)))).otherwise(1)
    rarest = rarest.where(F.col("found") == whole)
    return rarest.select("short", F.col("r.gram").alias("gram")).join(listed.hint("merge"), "gram").where(
        F.contains(F.col("long"), F.col("short"))).select("short", "long")


def price_of_models(models: DataFrame, prices: DataFrame, match: str = "first") -> DataFrame:
    """The price row of each distinct lower-case name in models (name): name, price_key, list_rank.

    As prices.price_key, for a price list of any length (model, list_rank): an equal name, else
    the first (or longest) list entry where either name contains the other. Names without
    any have no row.
    """
    listed = prices.groupBy("model").agg(F.min("list_rank").alias("list_rank"))
    equal = models.join(listed.hint("merge"), F.col("name") == F.col("model")).select("name", F.col("model").alias("price_key"), "list_rank")
    if match == "exact":
        return equal
    if match not in ("first", "longest"):
        raise ValueError(f"unknown match {match!r}")
    rest = models.where("name is not null").join(equal.select("name").hint("merge"), "name", "left_anti")
    a = _contained(listed.select(F.col("model").alias("short")), rest.select(F.col("name").alias("long"))).select(
        F.col("long").alias("name"), F.col("short").alias("model"))
    b = _contained(rest.select(F.col("name").alias("short")), listed.select(F.col("model").alias("long"))).select(
        F.col("short").alias("name"), F.col("long").alias("model"))
    size = F.length("model") if match == "longest" else F.lit(0)
    best = F.min(F.struct((-size).alias("size"), "list_rank", "model"))
    similar = a.union(b).join(listed.hint("merge"), "model").groupBy("name").agg(best.alias("p"))
    # An empty name is part of every name.
    all_of_list = listed.agg(best.alias("p")).join(rest.where("name = ''"), F.lit(True)).select("name", "p")
    blank = listed.where("model = ''").select(F.struct((-size).alias("size"), "list_rank", "model").alias("q"))
    found = similar.union(all_of_list.where("p is not null")).groupBy("name").agg(F.min("p").alias("p"))
    found = rest.join(found.hint("merge"), "name", "left").join(blank, F.lit(True), "left").withColumn("p", F.least("p", "q")).where("p is not null")
    return equal.union(found.select("name", F.col("p.model").alias("price_key"), F.col("p.list_rank").alias("list_rank")))


def price_requests_by_table(requests: DataFrame, prices: DataFrame, match: str = "first") -> DataFrame:
    """Add `price_key` and `cost` from a price list of any length.

    prices: model, input_per_million and output_per_million (decimals), list_rank; one row is `default`.
    Names are matched once per distinct model, whatever the number of requests.
    """
    models = requests.select(F.lower("model").alias("name")).where("name is not null").distinct()
    each = prices.groupBy("model").agg(F.min_by(F.struct(*[
        F.col(c).cast("decimal(10,4)").alias(c) for c in ("input_per_million", "output_per_million")]), "list_rank").alias("_p"))
    # Prices go to the names, not to the requests, so no price that many requests share gathers them; both are many rows.
    keys = price_of_models(models, prices, match).select(F.col("name").alias("_name"), "price_key").join(
        each.withColumnRenamed("model", "_model").hint("merge"), F.col("price_key") == F.col("_model"))
    named = requests.join(keys.hint("merge"), F.lower("model") == F.col("_name"), "left").drop("_name")
    rest = each.where(F.col("model") == DEFAULT).select(F.lit(DEFAULT).alias("_default"), F.col("_p").alias("_rest"))
    named = named.join(F.broadcast(rest), F.lit(True), "left").withColumns({
        "_p": F.when(F.col("_model").isNull(), F.col("_rest")).otherwise(F.col("_p")), "price_key": F.coalesce("price_key", "_default")})
    joined = named.where("price_key is not null").drop("_default", "_rest")
    micro = (F.col("prompt_tokens").cast("decimal(15,0)") * F.col("_p.input_per_million")
             + F.col("completion_tokens").cast("decimal(15,0)") * F.col("_p.output_per_million"))
    return joined.withColumn("cost", in_dollars(micro)).drop("_p", "_model")


def _cost():
    # Decimal sums do not depend on row order.
    return F.sum(F.col("cost").cast("decimal(20,6)")).cast("double")


def usage_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("project").agg(_cost().alias("total_cost"), F.count("*").alias("total_requests"))


def usage_daily(requests: DataFrame) -> DataFrame:
    return requests.groupBy("project", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        _cost().alias("cost"), F.count("*").alias("requests")
    )


def usage_monthly(requests: DataFrame) -> DataFrame:
    return requests.groupBy("project", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        _cost().alias("cost"), F.count("*").alias("requests")
    )


def usage_calendar(requests: DataFrame) -> DataFrame:
    """Days, months and the total per project in one pass."""
    slim = requests.select(
        "project", F.date_format("ts", "yyyy-MM").alias("month"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "cost",
    )
    sets = [
        [F.col("project"), F.col("month"), F.col("day")],
        [F.col("project"), F.col("month")],
        [F.col("project")],
    ]
    return slim.groupingSets(sets, "project", "month", "day").agg(
        _cost().alias("cost"), F.count("*").alias("requests")
    )


def usage_stats(requests: DataFrame, now: dt.datetime) -> DataFrame:
    """Today, this month and all time per project in one conditional aggregate."""
    today = F.date_format("ts", "yyyy-MM-dd") == now.strftime("%Y-%m-%d")
    month = F.date_format("ts", "yyyy-MM") == now.strftime("%Y-%m")
    cost = F.col("cost").cast("decimal(20,6)")

    def spent(when):
        return F.coalesce(F.sum(F.when(when, cost)), F.lit(0)).cast("double")

    return requests.groupBy("project").agg(
        spent(today).alias("today_cost"), F.count_if(today).alias("today_requests"),
        spent(month).alias("month_cost"), F.count_if(month).alias("month_requests"),
        spent(F.lit(True)).alias("total_cost"), F.count("*").alias("total_requests"),
    )


def month_bounds(year: int, month: int) -> tuple[dt.datetime, dt.datetime]:
    return dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1)


def in_month(requests: DataFrame, year: int, month: int) -> DataFrame:
    """A timestamp range, so file and row-group statistics prune other months."""
    start, end = (moment(x) for x in month_bounds(year, month))
    return requests.filter((F.col("ts") >= start) & (F.col("ts") < end))


def usage_month(requests: DataFrame, year: int, month: int) -> DataFrame:
    """One month per project: total, per model, per day; `part` names the level."""
    slim = in_month(requests, year, month).select(
        "project", "model", F.date_format("ts", "yyyy-MM-dd").alias("day"), "cost", "total_tokens"
    )
    sets = [
        [F.col("project")], [F.col("project"), F.col("model")], [F.col("project"), F.col("day")]
    ]
    grouped = slim.groupingSets(sets, "project", "model", "day").agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("requests"), _cost().alias("cost"), F.sum("total_tokens").alias("tokens"),
    )
    part = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "model").otherwise("day")
    return grouped.select(
        "project", part.alias("part"), F.coalesce("model", "day", F.lit("")).alias("name"),
        "requests", "cost", "tokens",
    )


def retain_usage(requests: DataFrame, keep: int = 1000, ties: Sequence[str] = ()) -> DataFrame:
    return retain(requests, keep, ("project",), ties)


def recent_requests(
    requests: DataFrame, k: int = 50, keys: Sequence[str] = ("project",), ties: Sequence[str] = ()
) -> DataFrame:
    """The newest k requests, newest first, per project or (no keys) over all."""
    by = [F.desc("ts"), *[F.desc(t) for t in ties]]
    if not keys:
        return requests.orderBy(*by).limit(k)
    return top_k(requests, keys, by, k, "place", ["ts", *ties])


def reprice_audit(
    requests: DataFrame, tolerance: float = 0.0000005, prices: Sequence[Price] = PRICE_LIST
) -> DataFrame:
    """Requests whose stored cost is not the cost of their tokens."""
    due = request_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), prices)
    return (
        requests.withColumn("due_cost", due.cast("double"))
        .withColumn("difference", F.col("cost").cast("double") - F.col("due_cost"))
        .filter(F.abs("difference") > tolerance)
    )


def since_reset(requests: DataFrame, resets: DataFrame) -> DataFrame:
    """Requests at or after the last reset of their project; nothing is deleted.

    `resets` (project, reset_at) is an event list; it is reduced to one row per project.
    """
    last = resets.groupBy("project").agg(F.max("reset_at").alias("_reset_at"))
    return (
        requests.join(last, "project", "left")
        .filter(F.col("_reset_at").isNull() | (F.col("ts") >= F.col("_reset_at")))
        .drop("_reset_at")
    )
