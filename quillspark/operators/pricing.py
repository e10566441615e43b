"""Pricing of token flows by hourly prices.

A flow row has 24 hourly amounts; hour h of it is priced by the latest price at or before that hour, at most LOOKBACK
hours old. An older price is a gap, never a price; an hour without an amount needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, graphs
from .store import is_active

LOOKBACK = 6
HOURS = 24


def chain_prices(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("source").startswith("chain:") | F.col("source").startswith("first_party:"))


def usd_flows(observations: DataFrame) -> DataFrame:
    return observations.where(is_active() & F.col("period_days").isNotNull() & F.col("metric_key").startswith("flow_usd."))


def _hours(flows: DataFrame) -> DataFrame:
    rows = flows.where("hourly_amounts is not null").select("id", "token_ref", "observed_hour", F.posexplode("hourly_amounts").alias("h", "amount"))
    return rows.select("id", "token_ref", (F.col("observed_hour") - HOURS + F.col("h")).alias("hour"), "amount")


def _hourly(priced: DataFrame) -> DataFrame:
    """Of (id, amount, price): usd_hourly, hours_priced, hours_needed, hours_missing."""
    needed = F.col("amount") != 0
    missing = F.count_if(needed & F.col("price").isNull())
    return priced.groupBy("id").agg(
        F.when(missing == 0, F.coalesce(F.sum(F.when(needed, F.col("amount") * F.col("price"))), F.lit(0.0))).alias("usd_hourly"),
        F.count("price").alias("hours_priced"), F.count_if(needed).alias("hours_needed"), missing.alias("hours_missing"),
    )


def _basis(daily: bool) -> tuple[Column, Column]:
    native = (F.col("token_ref") == "usd") & F.col("amount").isNotNull()
    hourly = F.col("hourly_amounts").isNotNull() & (F.col("hours_missing") == 0)
    usd = F.when(native, F.col("amount")).when(hourly, F.col("usd_hourly"))
    basis = F.when(native, "usd_native").when(hourly, "hourly").when(F.col("hourly_amounts").isNotNull(), "legacy_unpriced")
    if daily:
        whole = F.col("hourly_amounts").isNull() & (F.col("day_hours") == HOURS)
        usd = usd.when(whole, F.col("amount") * F.col("mean_usd"))
        basis = basis.when(F.col("day_hours") == HOURS, "daily_mean")
    return usd.otherwise(F.col("value")), basis.when(F.col("amount").isNotNull(), "legacy_no_hourly").otherwise("legacy_no_tokens")


def flow_usd(observations: DataFrame, prices: DataFrame, market: str = "coingecko") -> DataFrame:
    """Hourly pricing that prefers the market source within the lookback over a newer price of another source."""
    flows = usd_flows(observations)
    of_market = F.col("source") == market
    newest = F.struct((-F.col("fetched_at")).alias("a"), F.col("source").alias("b"))
    both = prices.groupBy("token_ref", "hour").agg(F.min_by("price", F.when(of_market, newest)).alias("first"), F.min_by("price", F.when(~of_market, newest)).alias("other"))
    # every price is valid for the hours behind it; the latest of each kind counts
    spread = both.select("token_ref", F.explode(F.expr(f"sequence(hour, hour + {LOOKBACK})")).alias("at"), "hour", "first", "other")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("hour")))
    known = spread.groupBy("token_ref", F.col("at").alias("hour")).agg(F.coalesce(latest("first"), latest("other")).alias("price"))
    out = flows.join(_hourly(_hours(flows).join(known, ["token_ref", "hour"], "left")), "id", "left")
    usd, basis = _basis(False)
    return out.withColumns({"usd": usd, "usd_basis": basis, "hours_priced": F.coalesce("hours_priced", F.lit(0)), "hours_needed": F.coalesce("hours_needed", F.lit(0))})


def flow_usd_chain(observations: DataFrame, prices: DataFrame) -> DataFrame:
    """Hourly pricing by chain and first-party prices only. A row without hourly amounts is priced by the mean of the
    24 prices of its day if every hour has one of its own."""
    flows = usd_flows(observations)
    by_hour = asof.hour_price_dedupe(chain_prices(prices))
    hours = _hours(flows).join(asof.forward_prices(by_hour, LOOKBACK), ["token_ref", "hour"], "left")
    days = flows.where("hourly_amounts is null and amount is not null and token_ref <> 'usd' and period_days = 1")
    days = days.select("id", "token_ref", F.explode(F.expr(f"sequence(observed_hour - {HOURS}, observed_hour - 1)")).alias("hour"))
    means = days.join(by_hour, ["token_ref", "hour"]).groupBy("id").agg(F.count("*").alias("day_hours"), F.avg("price").alias("mean_usd"))
    means = days.select("id").distinct().join(means, "id", "left").withColumn("day_hours", F.coalesce("day_hours", F.lit(0))).withColumn("day_needed", F.lit(HOURS))
    out = flows.join(_hourly(hours), "id", "left").join(means, "id", "left")
    usd, basis = _basis(True)
    return out.withColumns({
        "usd": usd, "usd_basis": basis,
        "hours_priced": F.coalesce("hours_priced", "day_hours", F.lit(0)), "hours_needed": F.coalesce("hours_needed", "day_needed", F.lit(0)),
    })


def price_basis(label: Column) -> Column:
    """Six labels folded to four."""
    return F.when(label == "usd_native", "native").when(label.isin("hourly", "daily_mean"), label).otherwise("legacy")


def compare_usd(priced: DataFrame, *by: str) -> DataFrame:
    """Legacy against priced USD: sums, gap, and nearest-rank percentiles of the gaps by row; 0 against x is 100."""
    gap = F.when(F.col("value") == 0, F.when(F.col("usd") == 0, 0.0).otherwise(100.0)).otherwise(F.abs(F.col("usd") - F.col("value")) / F.abs("value") * 100)
    rows = priced.withColumn("gap", gap)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("value").alias("legacy"), F.sum("usd").alias("priced"),
        F.expr("percentile_disc(0.5) within group (order by gap)").alias("p50"), F.expr("percentile_disc(0.9) within group (order by gap)").alias("p90"),
    )


def rebuild_levels(levels: DataFrame, prices: DataFrame, lag: int = 1) -> DataFrame:
    """Price levels with the price that was in force `lag` hours before their reading; null where there is none."""
    rows = levels.withColumn("_at", F.col("hour") - lag)
    price = asof.forward_prices(prices, LOOKBACK).select("token_ref", F.col("hour").alias("_at"), "price")
    return rows.join(price, ["token_ref", "_at"], "left").drop("_at")


def breach_runs(prices: DataFrame, tolerance: float, consecutive: int, *by: str) -> DataFrame:
    """The hour at which a run of breaching hours is `consecutive` long, once a run, if a row of the run so far is fresh.
    A null gap neither breaches nor ends a run; an hour without a row or within the tolerance ends it."""
    w = Window.partitionBy(*by).orderBy("hour")
    hole = F.coalesce(F.col("hour") - F.lag("hour").over(w) > 1, F.lit(False))
    bad = F.abs("gap") > tolerance
    rows = prices.withColumns({"_hole": hole.cast("int"), "_ok": (F.col("gap").isNotNull() & ~bad).cast("int")})
    rows = rows.withColumn("_run", F.sum(F.col("_hole") + F.col("_ok")).over(w))
    rows = rows.where(F.col("gap").isNotNull() & bad)
    in_run = Window.partitionBy(*by, "_run").orderBy("hour")
    rows = rows.withColumns({"_k": F.row_number().over(in_run), "_fresh": F.max(F.col("fresh").cast("int")).over(in_run)})
    return rows.where((F.col("_k") == consecutive) & (F.col("_fresh") == 1)).drop("_hole", "_ok", "_run", "_k", "_fresh")


def with_check(price: Column, check: Column) -> Column:
    """Gap of a price to its check in percent, null without one."""
    return F.when(check > 0, (price - check) / check * 100)


def outside(price: Column, low: Column, high: Column) -> Column:
    """How far a price lies outside a band, in percent of the end it passed; 0 inside."""
    return F.when(price < low, (price - low) / low * 100).when(price > high, (price - high) / high * 100).otherwise(0.0)


def reprice_class(source_type: Column, method: Column, basis: Column) -> Column:
    """What a reprice does with a flow row: skip with a reason, refuse, or price."""
    return (
        F.when(basis == "usd_native", "skip: usd_native").when(source_type == "third_party", "skip: third_party").when(method == "disclosed", "skip: disclosed")
        .when(method == "derived", "skip: derived").when(basis == "legacy_unpriced", "refuse: hours without a price").when(basis.isin("hourly", "daily_mean"), "price").otherwise("skip: no tokens")
    )


def hour_prices(readings: DataFrame) -> DataFrame:
    """ref, hour, price, reason of readings (ref, hour, quote_ref, in_quote, reason). A price is in units of the quote's price of
    the same hour, so references are priced in the order of their quotes, a join for each level. Without the quote's
    price there is none (quote_missing), never an older one. Quotes that form a cycle are refused."""
    spark = readings.sparkSession
    order = graphs.levels(spark, readings.select(F.col("ref").alias("node"), F.col("quote_ref").alias("input")).distinct())
    order = {r.node: r.level for r in order.collect()}  # configured references
    if loop := sorted(ref for ref, level in order.items() if level is None):
        raise ValueError(f"quotes form a cycle among {', '.join(map(str, loop))}")
    known = readings.where("quote_ref is null").select("ref", "hour", F.col("in_quote").alias("price"), "reason")
    for level in range(1, max(order.values(), default=0) + 1):
        rows = readings.where(F.col("quote_ref").isNotNull() & F.col("ref").isin([ref for ref, at in order.items() if at == level]))
        met = rows.join(known.select(F.col("ref").alias("quote_ref"), "hour", F.col("price").alias("unit")), ["quote_ref", "hour"], "left")
        reason = F.when(F.col("unit").isNull(), "quote_missing").otherwise(F.col("reason"))
        known = known.unionByName(met.select("ref", "hour", (F.col("in_quote") * F.col("unit")).alias("price"), reason.alias("reason")))
    return known
