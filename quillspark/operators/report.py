"""What a report reads and what its summary copies: usable readings, the report day, levels as of a day, the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def narrow(readings: DataFrame, metrics: DataFrame, as_of: int) -> DataFrame:
    """Readings (asset_id, metric_key, hour, id, ...) that are of use at an hour, by what the metric declares (asset_id,
    metric_key, kind, window_days): of a level the newest; of a schedule the step in force and those after it; of an
    event those still ahead; of a flow with a window its days up to the newest, and one day more. Others, and metrics
    that aren't declared, have none. The newest is found by a sum over each series, so no series is gathered."""
    rows = readings.join(metrics, ["asset_id", "metric_key"])
    past = F.col("hour") <= as_of
    key = ["asset_id", "metric_key"]
    newest = rows.where(past).groupBy(*key).agg(F.max(F.struct("hour", "id")).alias("newest"))
    rows = rows.join(newest, key, "left")
    is_newest = past & (F.col("hour") == F.col("newest.hour")) & (F.col("id") == F.col("newest.id"))
    kept = (
        F.when(F.col("kind") == "level", is_newest).when(F.col("kind") == "schedule", is_newest | ~past).when(F.col("kind") == "event", ~past)
        .otherwise(past & F.col("window_days").isNotNull() & (F.col("hour") > F.col("newest.hour") - (F.col("window_days") + 1) * 24))
    )
    return rows.where(kept).select(readings.columns)


def report_day(daily: DataFrame, series: DataFrame) -> DataFrame:
    """asset, day: the last day on which every series (asset, metric) that a report reads has a value; none, no row."""
    size = series.groupBy("asset").agg(F.count_distinct("metric").alias("size"))
    days = daily.join(series.select("asset", "metric").distinct(), ["asset", "metric"], "left_semi").groupBy("asset", "day").agg(F.count_distinct("metric").alias("n"))
    return days.join(size, "asset").where("n = size").groupBy("asset").agg(F.max("day").alias("day"))


def levels_as_of(readings: DataFrame, days: DataFrame) -> DataFrame:
    """asset_id, metric_key, value, hour, n: the newest confirmed reading up to the end of the day after the asset's day
    (asset_id, day, end_hour: the first hour after it), since that day's run reads the levels; n counts the readings."""
    rows = readings.where("status = 'confirmed' and superseded_by is null").join(days, "asset_id").where("hour < end_hour + 24")
    return rows.groupBy("asset_id", "metric_key").agg(F.max_by(F.struct("value", "hour"), F.struct("hour", "id")).alias("r"), F.count("*").alias("n")).select("asset_id", "metric_key", "r.value", "r.hour", "n")


def summary(levels: DataFrame, profit: DataFrame, buckets: DataFrame, yields: DataFrame, multiples: DataFrame, day: str, days: int) -> DataFrame:
    """A row for each asset that copies the statement's numbers; nothing is worked out again."""
    net = buckets.groupBy("asset").agg(*(F.max(F.when(F.col("bucket") == b, F.col("net"))).alias(f"{b}_net") for b in ("burn", "hold", "cash")))
    rows = levels.select("asset", "price", "total_supply").join(profit.select("asset", "revenue", "gross_profit"), "asset", "left")
    for part in (net, yields.select("asset", "cash", "buyback", "shareholder", "dilution", "net_shareholder", "multiple"), multiples.select("asset", "mcap", "mcap_to_revenue", "mcap_to_net")):
        rows = rows.join(part, "asset", "left")
    return rows.withColumns({"day": F.lit(day).cast("date"), "window_days": F.lit(days), "fdv": F.col("price") * F.col("total_supply")}).drop("total_supply")


def window_totals(daily: DataFrame, windows: list[int], *by: str) -> DataFrame:
    """day, window, total of every day and window length (in days) whose days all have a value. Running sums of each series
    are made once; a window is the difference of two of them, at its last and its first day, whatever its length."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = daily.where("value is not null").select(*by, "day", "value", F.sum("value").over(w).alias("sum"), F.count("*").over(w).alias("n"))
    last = sums.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    last = last.select(*by, F.expr("date_sub(day, window - 1)").alias("first"), F.col("day").alias("last"), "window", "sum", "n")
    first = sums.select(*by, F.col("day").alias("first"), F.col("value").alias("_v"), F.col("sum").alias("_sum"), F.col("n").alias("_n"))
    both = last.join(first, [*by, "first"]).where(F.col("n") - F.col("_n") + 1 == F.col("window"))
    return both.select(*by, F.col("last").alias("day"), "window", (F.col("sum") - F.col("_sum") + F.col("_v")).alias("total"))


def sums_at(daily: DataFrame, reports: DataFrame, days: int) -> DataFrame:
    """What statement.window_sums() gives, for many reports at once: asset (the report), metric, total and prior of the windows
    to each report's own day. reports: report, asset, day; daily: asset, metric, day, value."""
    totals = window_totals(daily, [days], "asset", "metric").drop("window")
    rows = reports.join(daily.select("asset", "metric").distinct(), "asset")
    now = totals.select("asset", "metric", "day", "total")
    before = totals.select("asset", "metric", F.date_add("day", days).alias("day"), F.col("total").alias("prior"))
    found = rows.join(now, ["asset", "metric", "day"], "left").join(before, ["asset", "metric", "day"], "left")
    return found.select(F.col("report").alias("asset"), "metric", "total", "prior")


def levels_at(readings: DataFrame, reports: DataFrame) -> DataFrame:
    """What levels_as_of() gives, for many reports at once: report, metric_key, value, hour, n of every metric with a reading by
    then. reports: report, asset_id, end_hour. One sweep over readings and reports of each metric."""
    rows = readings.where("status = 'confirmed' and superseded_by is null").select("asset_id", "metric_key", "hour", "id", "value")
    marks = reports.join(rows.select("asset_id", "metric_key").distinct(), "asset_id").select("asset_id", "metric_key", (F.col("end_hour") + 24).alias("hour"), "report")
    both = rows.withColumn("_side", F.lit(1)).unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("asset_id", "metric_key").orderBy("hour", "_side", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("report", "metric_key", "_side", F.last(F.when(F.col("_side") == 1, F.struct("value", "hour")), ignorenulls=True).over(w).alias("r"), F.count_if(F.col("_side") == 1).over(w).alias("n"))
    return seen.where("_side = 0 and n > 0").select("report", "metric_key", "r.value", "r.hour", "n")
