"""Coverage history: retention, trends, steps, rankings, recommendations.

Snapshots: project, ts, total_items, documented_items, coverage_percent (and anything
else). Groups: project, level (method or module), name, total, documented, coverage,
first_seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions.numbers import fixed_text
from docmetrics.functions.times import moment
from docmetrics.operators.ordered import top_k, with_previous


def history_for(snapshots: DataFrame, project: str) -> DataFrame:
    return snapshots.filter(F.col("project") == project)


def in_period(days: int, now: dt.datetime, ts: str = "ts") -> Column:
    """Not older than `days` before `now`; a literal bound, so it reaches the scan."""
    return F.col(ts) >= moment(now - dt.timedelta(days=days))


def newest(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; no limit for 0 or None."""
    ordered = snapshots.orderBy(F.desc("ts"), "project")
    return ordered.limit(limit) if limit else ordered


def retain(
    rows: DataFrame, keep: int, keys: Sequence[str] = ("project",), ties: Sequence[str] = ()
) -> DataFrame:
    """The newest `keep` rows per project; with no keys, of all projects together."""
    by = [F.desc("ts"), *[F.desc(t) for t in ties]]
    if not keys:
        return rows.orderBy(*by).limit(keep)
    return top_k(rows, keys, by, keep, salt_on=["ts", *ties])


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "project"]
    return (
        snapshots.groupBy("project")
        .agg(F.max_by(F.struct(*rest), "ts").alias("s"))
        .select("project", *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def direction(change: Column) -> Column:
    return F.when(change > 1, "improving").when(change < -1, "declining").otherwise("stable")


def coverage_trend(
    snapshots: DataFrame, now: dt.datetime, days: Sequence[int] = (30,)
) -> DataFrame:
    """First against last snapshot per project for each period length, in one pass.

    A project whose snapshots are all older gets `no_data` and no changes.
    """
    state = F.struct("coverage_percent", "total_items", "documented_items")
    aggs = []
    for d in days:
        when = F.when(in_period(d, now), F.col("ts"))
        aggs += [
            F.count(when).alias(f"n{d}"),
            F.min_by(state, when).alias(f"first{d}"),
            F.max_by(state, when).alias(f"last{d}"),
        ]
    grouped = snapshots.groupBy("project").agg(*aggs)
    periods = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(d).alias("period_days"), F.col(f"n{d}").alias("records_found"),
                    F.when(F.col(f"n{d}") > 0, F.col(f"first{d}")).alias("f"),
                    F.when(F.col(f"n{d}") > 0, F.col(f"last{d}")).alias("l"),
                )
                for d in days
            ]
        )
    ).alias("p")
    rows = grouped.select("project", periods).select("project", "p.*")
    change = F.col("l.coverage_percent") - F.col("f.coverage_percent")
    return rows.select(
        "project", "period_days", "records_found",
        F.when(F.col("records_found") == 0, "no_data").otherwise(direction(change)).alias("trend"),
        F.round(change, 2).alias("coverage_change"),
        (F.col("l.total_items") - F.col("f.total_items")).alias("items_change"),
        (F.col("l.documented_items") - F.col("f.documented_items")).alias("documented_change"),
    )


def trend_series(snapshots: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """The snapshots of the period, as rows."""
    return snapshots.filter(in_period(days, now)).select(
        "project", "ts", "coverage_percent", "total_items"
    )


def coverage_deltas(snapshots: DataFrame) -> DataFrame:
    """Change of each snapshot against the one before it; days and months are worked apart."""
    stepped = with_previous(
        snapshots.select("project", "ts", "coverage_percent", "total_items", "documented_items"),
        ["project"], [F.date_trunc("month", "ts"), F.date_trunc("day", "ts")], ["ts"],
        F.struct("coverage_percent", "total_items", "documented_items"), "_prev",
    )
    change = F.col("coverage_percent") - F.col("_prev.coverage_percent")
    return stepped.select(
        "project", "ts", "coverage_percent",
        change.alias("coverage_change"),
        (F.col("total_items") - F.col("_prev.total_items")).alias("items_change"),
        (F.col("documented_items") - F.col("_prev.documented_items")).alias("documented_change"),
    )


def best_worst_modules(groups: DataFrame, k: int = 5) -> DataFrame:
    """Best and worst k modules per project by coverage; equal ones keep their order.

    `place` counts down the same descending list for both ends, so with fewer than 2k
    modules the two lists overlap.
    """
    modules = groups.filter(F.col("level") == "module").select(
        "project", "name", "total", "documented", "coverage", "first_seen"
    )
    sizes = modules.groupBy("project").agg(F.count("*").alias("_n"))
    best = top_k(
        modules, ["project"], [F.desc("coverage"), F.asc("first_seen")], k, "place", ["name"]
    ).withColumn("end", F.lit("best"))
    worst = (
        top_k(
            modules, ["project"], [F.asc("coverage"), F.desc("first_seen")], k, "_up", ["name"]
        )
        .join(sizes, "project")
        .withColumn("place", (F.col("_n") - F.col("_up") + 1).cast("int"))
        .withColumn("end", F.lit("worst"))
        .drop("_n", "_up")
    )
    return best.unionByName(worst)


# Recommendation texts.
CRITICAL = "🚨 Critical: Documentation coverage is very low. Consider making documentation a priority."
WARNING = (
    "⚠️  Warning: Documentation coverage is below recommended levels."
    " Focus on documenting public APIs first."
)
GOOD = "📈 Good progress! Focus on documenting remaining endpoints and complex functions."
EXCELLENT = (
    "✅ Excellent documentation coverage! Focus on quality and keeping docs up-to-date."
)
DECLINING = (
    "📉 Documentation coverage is declining. Review recent changes and ensure new code is documented."
)
IMPROVING = "🎉 Great job! Documentation coverage is improving over time."
RECOMMENDED_VERBS = ["GET", "POST", "PUT", "DELETE"]


def recommendations(latest: DataFrame, groups: DataFrame, trends: DataFrame) -> DataFrame:
    """Ordered advice lines per project: project, section, place, text.

    Sections: 1 level, 2 trend, 3 endpoint kinds below half, 4 the three weakest modules
    below 40 percent.
    """
    level = latest.select(
        "project", F.lit(1).alias("section"), F.lit(1).alias("place"),
        F.when(F.col("coverage_percent") < 30, CRITICAL)
        .when(F.col("coverage_percent") < 60, WARNING)
        .when(F.col("coverage_percent") < 80, GOOD)
        .otherwise(EXCELLENT)
        .alias("text"),
    )
    moving = trends.filter(F.col("trend").isin("declining", "improving")).select(
        "project", F.lit(2).alias("section"), F.lit(1).alias("place"),
        F.when(F.col("trend") == "declining", DECLINING).otherwise(IMPROVING).alias("text"),
    )
    share = fixed_text(F.col("coverage"), 1)
    verbs = groups.filter(
        (F.col("level") == "method")
        & (F.col("coverage") < 50)
        & F.col("name").isin(RECOMMENDED_VERBS)
    )
    # At most four kinds per project pass the filter, so this window is tiny.
    kinds = top_k(verbs, ["project"], [F.asc("first_seen")], len(RECOMMENDED_VERBS), "place").select(
        "project", F.lit(3).alias("section"), "place",
        F.concat(
            F.lit("🔗 Focus on documenting "), "name", F.lit(" endpoints - only "), share,
            F.lit("% are documented."),
        ).alias("text"),
    )
    weakest = top_k(
        groups.filter(F.col("level") == "module"),
        ["project"], [F.asc("coverage"), F.asc("first_seen")], 3, "place", ["name"],
    ).filter(F.col("coverage") < 40)
    modules = weakest.select(
        "project", F.lit(4).alias("section"), "place",
        F.concat(
            F.lit("📁 Module '"), "name", F.lit("' needs attention - only "), share,
            F.lit("% documented."),
        ).alias("text"),
    )
    return level.unionByName(moving).unionByName(kinds).unionByName(modules)


def progress_report(
    snapshots: DataFrame, groups: DataFrame, now: dt.datetime
) -> DataFrame:
    """Everything of the progress report as rows: project, part, place, name, value.

    `groups` are the groups of each project's latest snapshot.
    """
    latest = latest_snapshot(snapshots)
    trends = coverage_trend(snapshots, now, (7, 30))

    def row(part, place, name, value):
        return [F.lit(part).alias("part"), place.cast("int").alias("place"), name.alias("name"),
                value.cast("string").alias("value")]

    one = F.lit(1)
    heads = latest.select(
        "project", *row("latest", one, F.lit("coverage_percent"), F.col("coverage_percent"))
    )
    moves = trends.select(
        "project", *row("trend", F.col("period_days"), F.col("trend"), F.col("records_found"))
    )
    ends = best_worst_modules(groups)
    ranked = ends.select("project", *row("best", F.col("place"), F.col("name"), F.col("coverage")), "end")
    ranked = ranked.withColumn("part", F.col("end")).drop("end")
    gaps = groups.filter((F.col("level") == "method") & (F.col("total") > F.col("documented"))).select(
        "project", *row("missing", one, F.col("name"), F.col("total") - F.col("documented"))
    )
    advice = recommendations(latest, groups, trends.filter(F.col("period_days") == 30)).select(
        "project", *row("advice", F.col("section") * 10 + F.col("place"), F.lit(""), F.col("text"))
    )
    out = heads
    for part in (moves, ranked, gaps, advice):
        out = out.unionByName(part)
    return out

