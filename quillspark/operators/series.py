"""Daily series in long form: complete windows, growth, calendars, spreads. A missing day is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365


def confirmed_daily(observations: DataFrame, *key: str) -> DataFrame:
    """Active confirmed rows of one day, by the day they cover; the newest (observed_hour, id) of a day wins."""
    rows = observations.where("superseded_by is null and status = 'confirmed' and period_days = 1")
    return rows.groupBy(*key, "day").agg(F.max_by("value", F.struct("observed_hour", "id")).alias("value"))


def eligible(observations: DataFrame, *key: str) -> DataFrame:
    """Active rows without the provisional ones whose key a confirmed row shares."""
    rows = observations.where("superseded_by is null and status <> 'rejected'")
    confirmed = F.max(F.col("status") == "confirmed").over(Window.partitionBy(*key))
    return rows.withColumn("_c", confirmed).where("status = 'confirmed' or not _c").drop("_c")


def trailing(days: int, *by: str) -> Window:
    """The calendar days up to the row's, by date and not by row, so that gaps are seen."""
    return Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)


def complete_sum(days: int, *by: str, value: str = "value") -> Column:
    """Sum over the trailing window, null if a day of it is missing."""
    w = trailing(days, *by)
    return F.when(F.count(value).over(w) == days, F.sum(value).over(w))


def burn_momentum(daily: DataFrame, days: int, *by: str) -> DataFrame:
    """Mean a day over each complete window."""
    return daily.withColumn("mean", complete_sum(days, *by) / days).where("mean is not null")


def flow_annualized(daily: DataFrame, days: int, *by: str) -> DataFrame:
    return daily.withColumn("annualized", complete_sum(days, *by) * DAYS_PER_YEAR / days).where("annualized is not null")


def window_sum(daily: DataFrame, end: str, days: int, metrics: list[str]) -> DataFrame:
    """One row: the sum of the metrics over the days to end; null if any metric misses any day."""
    span = daily.where(F.col("metric").isin(metrics) & F.col("day").between(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date")))
    return span.agg(F.when(F.count("value") == days * len(metrics), F.sum("value")).alias("total"))


def growth(daily: DataFrame, days: int, *by: str) -> DataFrame:
    """current, prior, change, annualized for each day with a reading; the rules for incomplete, zero and negative
    windows are the note."""
    w = trailing(days, *by)
    before = Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(1 - 2 * days, -days)
    out = daily.withColumn("current", F.when(F.count("value").over(w) == days, F.sum("value").over(w)))
    out = out.withColumn("prior", F.when(F.count("value").over(before) == days, F.sum("value").over(before)))
    known = F.col("current").isNotNull() & F.col("prior").isNotNull()
    good = known & (F.col("prior") > 0) & (F.col("current") >= 0)
    ratio = F.try_divide("current", "prior")
    return out.withColumns({
        "change": F.when(known & (F.col("prior") > 0), ratio - 1),
        "annualized": F.when(good, F.pow(ratio, F.lit(DAYS_PER_YEAR / days)) - 1),
        "note": F.when(~known, "incomplete").when(~good, "not meaningful"),
    })


def last_two(rows: DataFrame, *by: str) -> DataFrame:
    """Disclosed growth: the last two readings of each series, their gap in days, and flags for a short gap."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day"), F.desc("id")))
    two = rows.withColumn("_r", rank).where("_r <= 2").groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("current"), F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("prior"),
        F.datediff(F.max(F.when(F.col("_r") == 1, F.col("day"))), F.max(F.when(F.col("_r") == 2, F.col("day")))).alias("gap_days"),
    )
    return two.withColumns({"change": F.when(F.col("prior") > 0, F.col("current") / F.col("prior") - 1), "close_together": F.col("gap_days") < 90})


def full_months(daily: DataFrame, *by: str) -> DataFrame:
    """Sums of the months of which every day is there."""
    month = F.date_format("day", "yyyy-MM")
    out = daily.groupBy(*by, month.alias("month")).agg(F.sum("value").alias("total"), F.count_distinct("day").alias("_n"), F.max(F.day(F.last_day("day"))).alias("_days"))
    return out.where("_n = _days").drop("_n", "_days")


def day_align(daily: DataFrame, signs: dict[str, int]) -> DataFrame:
    """Signed sum of several series on the days that all of them have."""
    sign = F.coalesce(*(F.when(F.col("metric") == m, s) for m, s in signs.items()))
    rows = daily.where(F.col("metric").isin(list(signs)))
    return rows.groupBy("day").agg(F.sum(F.col("value") * sign).alias("value"), F.count_distinct("metric").alias("_n")).where(F.col("_n") == len(signs)).drop("_n")


def calendar(spans: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """A row for each day between two columns."""
    return spans.select(*by, F.explode(F.sequence(F.col(first), F.col(last))).alias("day"))


def gap_days(daily: DataFrame, *by: str) -> DataFrame:
    """Days between a series' first and last that have no row."""
    spans = daily.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return calendar(spans, "lo", "hi", *by).join(daily.select(*by, "day"), [*by, "day"], "left_anti")


def burns_by_day(readings: DataFrame, *by: str) -> DataFrame:
    """Falls between successive readings (hour, supply), spread over the time between, by whole day (number of days from
    hour 0). A rise raises an error."""
    w = Window.partitionBy(*by).orderBy("hour", "id")
    steps = readings.withColumns({"h0": F.lag("hour").over(w), "s0": F.lag("supply").over(w)}).where("h0 < hour")
    fall = F.when(F.col("supply") > F.col("s0"), F.raise_error(F.lit("supply rose: not a burn-only token")).cast("double")).otherwise(F.col("s0") - F.col("supply"))
    steps = steps.withColumn("rate", fall / (F.col("hour") - F.col("h0")))
    days = steps.select(*by, "h0", "hour", "rate", F.explode(F.sequence(F.expr("h0 div 24"), F.expr("(hour - 1) div 24"))).alias("day_no"))
    burnt = days.groupBy(*by, "day_no").agg(F.sum(F.col("rate") * F.expr("least(hour, day_no * 24 + 24) - greatest(h0, day_no * 24)")).alias("burned"))
    ends = readings.groupBy(*by).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    return burnt.join(ends, list(by)).where("lo <= day_no * 24 and hi >= day_no * 24 + 24").drop("lo", "hi")


def periodic_spread(payments: DataFrame, through: str, *by: str) -> DataFrame:
    """Payments (day: the last day covered, period_days, value) spread over their days, later payments over earlier
    ones; days after the last up to `through` at its rate, provisional."""
    rate = F.col("value") / F.col("period_days")
    rows = payments.select(*by, "day", "id", rate.alias("rate"), "period_days")
    covered = rows.select(*by, F.col("day").alias("paid"), "id", "rate", F.explode(F.sequence(F.expr("date_sub(day, cast(period_days as int) - 1)"), F.col("day"))).alias("day"))
    covered = covered.groupBy(*by, "day").agg(F.max_by("rate", F.struct("paid", "id")).alias("value")).withColumn("provisional", F.lit(False))
    last = rows.groupBy(*by).agg(F.max("day").alias("end"), F.max_by("rate", F.struct("day", "id")).alias("value"))
    to = F.lit(through).cast("date")
    tail = last.where(F.col("end") < to).select(*by, F.explode(F.sequence(F.date_add("end", 1), to)).alias("day"), "value", F.lit(True).alias("provisional"))
    return covered.unionByName(tail)


def accrual_check(payments: DataFrame, tolerance_pct: float, *by: str) -> DataFrame:
    """Payments that differ from the rate of the one before, over their days, by more than the tolerance."""
    w = Window.partitionBy(*by).orderBy("day", "id")
    accrued = F.lag(F.col("value") / F.col("period_days")).over(w) * F.col("period_days")
    out = payments.withColumn("accrued", accrued).withColumn("diff_pct", F.when(F.col("accrued") > 0, (F.col("value") / F.col("accrued") - 1) * 100))
    return out.where(F.abs("diff_pct") > tolerance_pct)


def last_complete_day(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the last day up to which every metric has come, null if one never has."""
    last = daily.where(F.col("metric").isin(metrics)).groupBy("metric").agg(F.max("day").alias("day"))
    return last.agg(F.when(F.count("*") == len(metrics), F.min("day")).alias("day"))


def young_weight(daily: DataFrame, days: int, *by: str) -> DataFrame:
    """days / n for a series with n < days days so far, else 1."""
    return daily.groupBy(*by).agg(F.count_distinct("day").alias("n_days")).withColumn("weight", F.greatest(F.lit(1.0), F.lit(float(days)) / F.col("n_days")))


def with_start(daily: DataFrame, started: DataFrame, end: str, days: int, *by: str) -> DataFrame:
    """daily with 0 on the days of the two windows to end that lie before a series began (by, started) and have no reading,
    and weight: what its window sum is taken times, days / n for a series that is n < days days old, else 1. Series that
    name no start stay as they are, with weight 1."""
    last = F.lit(end).cast("date")
    ages = started.withColumn("_age", F.datediff(last, "started") + 1)
    weight = F.when((F.col("_age") > 0) & (F.col("_age") < days), F.lit(float(days)) / F.col("_age")).otherwise(1.0)
    window = ages.select(*by, "started", F.explode(F.sequence(F.date_sub(last, 2 * days - 1), last)).alias("day")).where("day < started")
    zeros = window.select(*by, "day", F.lit(0.0).alias("value")).join(daily, [*by, "day"], "left_anti")
    rows = daily.select(*by, "day", "value").unionByName(zeros)
    return rows.join(ages.select(*by, weight.alias("_weight")), list(by), "left").select(*by, "day", "value", F.coalesce("_weight", F.lit(1.0)).alias("weight"))


def flow_total(daily: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Sum of the days in a range, with the number of days missing and the first and last id."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = daily.where(F.col("day").between(lo, hi))
    return rows.groupBy(*by).agg(F.sum("value").alias("total"), (F.datediff(hi, lo) + 1 - F.count_distinct("day")).alias("missing_days"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def covered_days() -> Column:
    """Days that a row of period_days days ending before observed_hour covers, as day numbers."""
    return F.sequence(F.expr("cast((observed_hour - period_days * 24) div 24 as bigint)"), F.expr("(observed_hour - 1) div 24"))


def revisions(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows to write: their key is new or its stored value differs."""
    return fresh.join(stored.select(*key, F.col("value").alias("_old")), key, "left").where(~F.col("value").eqNullSafe(F.col("_old"))).withColumn("replaces", F.col("_old").isNotNull()).drop("_old")
