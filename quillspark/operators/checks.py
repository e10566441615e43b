"""Reconciliation checks in one long form: each check has two sides of terms; a side that misses a value makes the check
incomplete, never a breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import gap_pct

BOUNDARY_HOURS = 6


def judge(sides: DataFrame, tolerances: DataFrame) -> DataFrame:
    """sides (asset, check_id, lhs, rhs) and tolerances (check_id, tolerance_pct, tolerance_abs) to gap_pct and status.
    tolerances are configuration; Spark sees their size and picks the join."""
    rows = sides.join(tolerances, "check_id")
    rows = rows.withColumn("gap_pct", F.when(F.col("lhs").isNotNull() & F.col("rhs").isNotNull(), gap_pct(F.col("lhs"), F.col("rhs"))))
    within = F.coalesce(F.abs(F.col("lhs") - F.col("rhs")) <= F.col("tolerance_abs"), F.lit(False))
    status = F.when(F.col("gap_pct").isNull(), "incomplete").when((F.col("gap_pct") > F.col("tolerance_pct")) & ~within, "breach").otherwise("ok")
    known = F.col("gap_pct").isNotNull()
    return rows.select("asset", "check_id", F.when(known, F.col("lhs")).alias("lhs"), F.when(known, F.col("rhs")).alias("rhs"), "gap_pct", status.alias("status"))


def window_sides(daily: DataFrame, assets: DataFrame, terms: DataFrame, end: str) -> DataFrame:
    """Sides of checks between sums of flows. terms (check_id, side: lhs | rhs, metric, factor, days) are configuration;
    a side is null if any of its metrics misses any day of the window."""
    day = F.lit(end).cast("date")
    wanted = assets.join(F.broadcast(terms), F.lit(True))  # the declared terms, some rows a check, whatever the data's size
    most = terms.agg(F.max("days")).first()[0]  # configuration
    recent = daily.where((F.col("day") <= day) & (F.col("day") > F.date_sub(day, most)))
    met = wanted.join(recent.select("asset", "metric", "day", "value"), ["asset", "metric"], "left")
    inside = F.col("day") > F.date_sub(day, F.col("days"))
    per = met.groupBy("asset", "check_id", "side", "metric", "factor", "days").agg(F.sum(F.when(inside, F.col("value"))).alias("v"), F.count_if(inside).alias("n"))
    full = F.count_if(F.col("n") < F.col("days")) == 0
    side = per.groupBy("asset", "check_id", "side").agg(F.when(full, F.sum(F.col("v") * F.col("factor"))).alias("v"))
    return side.groupBy("asset", "check_id").agg(F.max(F.when(F.col("side") == "lhs", F.col("v"))).alias("lhs"), F.max(F.when(F.col("side") == "rhs", F.col("v"))).alias("rhs"))


def reading_at(levels: DataFrame, metric: Column | str, start: int, hours: int, name: str) -> DataFrame:
    """asset and the value of the metric's first reading in [start, start + hours)."""
    rows = levels.where((F.col("metric") == metric) & (F.col("hour") >= start) & (F.col("hour") < start + hours))
    return rows.groupBy("asset").agg(F.min_by("value", F.struct("hour", "id")).alias(name))


def level_change(levels: DataFrame, assets: DataFrame, metric: str, day_no: int) -> DataFrame:
    """asset and change: between the first readings within BOUNDARY_HOURS of the day's two ends, null without one."""
    start = reading_at(levels, metric, day_no * 24, BOUNDARY_HOURS, "a")
    end = reading_at(levels, metric, day_no * 24 + 24, BOUNDARY_HOURS, "b")
    return assets.join(start, "asset", "left").join(end, "asset", "left").select("asset", (F.col("b") - F.col("a")).alias("change"))


def revisions(rows: DataFrame, days: int, end: str) -> DataFrame:
    """asset, lhs, rhs: of the days up to end, the first row of a day by the origin of the row in force against that
    row, where they differ most; equal sides if none was restated. rows (asset, day, id, origin, value, superseded_by)."""
    day = F.lit(end).cast("date")
    recent = rows.where((F.col("day") <= day) & (F.col("day") > F.date_sub(day, days)))
    force = recent.where("superseded_by is null").groupBy("asset", "day").agg(F.min_by(F.struct("id", "origin", "value"), "id").alias("f")).select("asset", "day", "f.*")
    first = recent.groupBy("asset", "day", "origin").agg(F.min_by(F.struct("id", "value"), "id").alias("o"))
    both = force.join(first, ["asset", "day", "origin"]).select("asset", "day", F.col("value").alias("now"), F.col("o.value").alias("was"), gap_pct(F.col("o.value"), F.col("value")).alias("gap"))
    worst = both.groupBy("asset").agg(F.max_by(F.struct("was", "now", "gap"), F.struct("gap", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("w"), F.max(F.when(F.col("day") == day, F.col("now"))).alias("active"))
    changed = F.col("w.gap") > 0
    return worst.select("asset", F.when(F.col("active").isNotNull(), F.when(changed, F.col("w.was")).otherwise(F.col("active"))).alias("lhs"), F.when(F.col("active").isNotNull(), F.when(changed, F.col("w.now")).otherwise(F.col("active"))).alias("rhs"))


def newly_breached(now: DataFrame, before: DataFrame) -> DataFrame:
    """Breaches of checks whose stored result for the day was none."""
    return now.where("status = 'breach'").join(before.where("status = 'breach'").select("asset", "check_id", "day"), ["asset", "check_id", "day"], "left_anti")
