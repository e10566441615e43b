"""Filling what is missing: hourly prices newest first within a budget, and the token amounts of stored flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Relative difference from which on a recomputed amount is not the stored one's twin.
TWIN_TOLERANCE = 1e-9


def missing_hours(wanted: DataFrame, stored: DataFrame, start: int, end: int) -> DataFrame:
    """token_ref, hour in [start, end) from each ref's first valid hour on (token_ref, valid_from) that have no stored
    price. Hours are dealt out by ref and day, so that one ref's history is not one task's."""
    days = wanted.select("token_ref", F.greatest(F.col("valid_from"), F.lit(start)).alias("lo")).where(F.col("lo") < end)
    days = days.select("token_ref", "lo", F.explode(F.expr(f"sequence(lo div 24, {end - 1} div 24)")).alias("day"))
    hours = days.select("token_ref", F.explode(F.expr(f"sequence(greatest(lo, day * 24), least({end - 1}, day * 24 + 23))")).alias("hour"))
    return hours.join(stored.select("token_ref", "hour").distinct(), ["token_ref", "hour"], "left_anti")


def newest_first(hours: DataFrame, budget: int) -> DataFrame:
    """At most `budget` of the hours, the newest ones: what a run takes on. The others are left to later runs."""
    return hours.orderBy(F.desc("hour"), "token_ref").limit(budget)


def fill_prices(spark: SparkSession, wanted: DataFrame, price: Callable[[DataFrame], DataFrame], path: str, start: int, end: int, budget: int, dry: bool = False) -> DataFrame:
    """One run: prices (token_ref, hour, price) of the newest missing hours, appended to the table at path unless dry. What
    is stored is never read or written again, so a run that was stopped goes on with the next one, and a repeated run adds
    nothing: (token_ref, hour) is written once. Gives the run's rows."""
    schema = "token_ref string, hour bigint, price double"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    rows = price(newest_first(missing_hours(wanted, stored, start, end), budget)).select("token_ref", "hour", "price")
    if not dry:
        rows.write.mode("append").parquet(path)
    return rows


def relative_difference(a: Column, b: Column) -> Column:
    """Of the larger side; 0 if they are equal."""
    return F.when(a == b, 0.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def fill_amounts(rows: DataFrame, scanned: DataFrame, twins: DataFrame) -> DataFrame:
    """id, outcome, amount for rows (id, asset_id, day, series, amount): already filled, no scan, refused (the day's scan
    differs from the stored amount of the row's twin, a series of tokens of the same asset, day and name) or filled with
    what the scan gives. scanned and twins: asset_id, day, series, amount."""
    key = ["asset_id", "day", "series"]
    both = rows.join(scanned.select(*key, F.col("amount").alias("scan")), key, "left").join(twins.select(*key, F.col("amount").alias("twin")), key, "left")
    differs = F.col("twin").isNotNull() & (relative_difference(F.col("scan"), F.col("twin")) > TWIN_TOLERANCE)
    outcome = F.when(F.col("amount").isNotNull(), "already").when(F.col("scan").isNull(), "no scan").when(differs, "refused").otherwise("filled")
    return both.select("id", outcome.alias("outcome"), F.when(outcome == "filled", F.col("scan")).otherwise(F.col("amount")).alias("amount"))


def newest_runs(entries: DataFrame, runs: int, asset: str, run: str) -> DataFrame:
    """Entries of each asset's newest runs."""
    place = F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(run)))
    newest = entries.select(asset, run).distinct().withColumn("_place", place).where(F.col("_place") <= runs).drop("_place")
    return entries.join(newest, [asset, run], "left_semi")
