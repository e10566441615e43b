"""Repricing of stored flows: what is priced anew, skipped or refused, and which derived rows follow.

Only rows whose dollars came from market prices are priced, from chain and first-party prices. Derived rows over a repriced
day are worked out again, and derived rows over those in turn: a repriced day reaches every window that holds it, so days are
kept as intervals, made longer by each window and merged, a level of derived metrics after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.flows import saved
from . import asof, graphs
from .pricing import HOURS, LOOKBACK, _hourly, _hours, chain_prices
from .series import DAYS_PER_YEAR, complete_sum
from .store import is_active

#: Fixed value: the adapter whose rows are falls of a supply.
SUPPLY_BURN = "solana.supply_burn_daily"
_KEY = ["asset_id", "metric_key"]


def _usd() -> Column:
    return F.col("period_days").isNotNull() & F.col("metric_key").startswith("flow_usd.")


def remapped(rows: DataFrame, remap: DataFrame, column: str = "token_ref") -> DataFrame:
    """rows with ref: the reference that the column's stands for now (remap: from_ref, to_ref)."""
    names = remap.select(F.col("from_ref").alias(column), F.col("to_ref").alias("_to"))
    return rows.join(names, column, "left").withColumn("ref", F.coalesce("_to", column)).drop("_to")


def classes(observations: DataFrame, remap: DataFrame, supply: DataFrame) -> DataFrame:
    """Every flow in dollars (observations: id, asset_id, metric_key, day, observed_hour, period_days, value, status,
    superseded_by, method, source_type, adapter, token_ref, amount, hourly_amounts, marked) with active, class (skip,
    refuse, price), reason, new_ref, new_amount (where a twin gives it), by_hours.

    supply: asset_id, metric_key, first_hour (of the first supply reading that isn't rejected), mint_ref. A row of a supply's
    fall without an amount takes its twin's, the flow_tokens row of the same metric and end."""
    rows = remapped(observations.where(_usd()), remap).withColumn("active", is_active())
    twins = remapped(observations.where(is_active() & F.col("metric_key").startswith("flow_tokens.") & (F.col("period_days") == 1)), remap)
    name = F.concat(F.lit("flow_usd."), F.substring("metric_key", len("flow_tokens.") + 1, 1 << 20))
    twins = twins.groupBy("asset_id", name.alias("metric_key"), "observed_hour").agg(F.max_by(F.struct(F.col("value").alias("twin"), F.col("ref").alias("twin_ref")), "id").alias("t"))
    rows = rows.join(twins.select(*_KEY, "observed_hour", "t.*"), [*_KEY, "observed_hour"], "left").join(supply, _KEY, "left")
    scan, burn = F.col("source_type") == "log_scan", F.coalesce(F.col("adapter") == SUPPLY_BURN, F.lit(False))
    known = F.col("ref").isNotNull() & F.col("amount").isNotNull()
    history = F.col("first_hour").isNull() | (F.col("observed_hour") - HOURS < F.col("first_hour"))
    ref = F.when(scan | known, F.col("ref")).otherwise(F.coalesce("twin_ref", "ref", "mint_ref"))
    skip = (
        F.when(F.col("token_ref") == "usd", "usd_native").when(F.col("source_type") == "third_party", "third_party").when(F.col("method").isin("disclosed", "derived"), F.col("method"))
        .when(F.col("period_days") != 1, "periodic").when(~scan & ~burn, F.concat(F.lit("not_coingecko_priced:"), "source_type")).when(burn & ~scan & ~known & history, "defillama_history")
    )
    refuse = F.when(scan & ~known, "no token amounts").when(~scan & ~known & F.col("twin").isNull(), "no amount and no twin row").when(~scan & ref.isNull(), "no token ref")
    return rows.withColumns({
        "class": F.when(skip.isNotNull(), "skip").when(refuse.isNotNull(), "refuse").otherwise("price"), "reason": F.coalesce(skip, refuse),
        "new_ref": ref, "new_amount": F.when(~scan & ~known, F.col("twin")), "by_hours": scan & F.col("hourly_amounts").isNotNull(),
    })


def _priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """id, usd, basis, gap (why there is no price) of rows to price."""
    by_hour = asof.hour_price_dedupe(chain_prices(prices))
    scans = rows.where("by_hours").select("id", F.col("new_ref").alias("token_ref"), "observed_hour", "hourly_amounts")
    hours = _hourly(_hours(scans).join(asof.forward_prices(by_hour, LOOKBACK), ["token_ref", "hour"], "left"))
    short = F.concat(F.col("hours_needed") - F.col("hours_missing"), F.lit(" of "), "hours_needed", F.lit(" hours with an amount priced"))
    hourly = hours.select("id", F.col("usd_hourly").alias("usd"), F.lit("hourly").alias("basis"), F.when(F.col("hours_missing") > 0, short).alias("gap"))
    whole = rows.where("not by_hours").select("id", F.col("new_ref").alias("token_ref"), F.coalesce("new_amount", "amount").alias("tokens"), F.explode(F.expr(f"sequence(observed_hour - {HOURS}, observed_hour - 1)")).alias("hour"))
    mean = whole.join(by_hour, ["token_ref", "hour"], "left").groupBy("id").agg(F.first("tokens").alias("tokens"), F.count("price").alias("n"), F.avg("price").alias("mean"))
    short = F.concat("n", F.lit(f" of {HOURS} hours priced (daily mean)"))
    daily = mean.select("id", F.when(F.col("n") == HOURS, F.col("tokens") * F.col("mean")).alias("usd"), F.lit("daily_mean").alias("basis"), F.when(F.col("n") < HOURS, short).alias("gap"))
    return hourly.unionByName(daily)


def merged(intervals: DataFrame, *by: str) -> DataFrame:
    """Intervals (first, last: day numbers) of each key without those that overlap or adjoin: the fewest that cover them."""
    before = Window.partitionBy(*by).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int")
    island = F.sum("_b").over(Window.partitionBy(*by).orderBy("first", "last"))
    return intervals.withColumn("_b", begins).withColumn("_i", island).groupBy(*by, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_i")


def covered(rows: DataFrame, intervals: DataFrame, *by: str) -> DataFrame:
    """rows (day) with touched: whether their day lies in one of the key's merged intervals. The interval that began last
    decides, found by one sweep of both."""
    number = F.unix_date("day")
    marks = intervals.select(*by, F.col("first").alias("_at"), F.lit(0).alias("_side"), F.col("last").alias("_last"))
    both = marks.unionByName(rows.select(*by, number.alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row")), allowMissingColumns=True)
    last = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).where("_side = 1").select("_row.*", F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False)).alias("touched"))


def plan(observations: DataFrame, prices: DataFrame, remap: DataFrame, supply: DataFrame, derived: DataFrame, start: str | None = None) -> DataFrame:
    """asset_id, id, metric_key, day, action, reason, basis, old_value, new_value, old_ref, new_ref, new_amount: of each active
    flow in dollars, row under an old reference, and derived row what is done with it.

    action: skip and refuse (the reason tells why; the value stays), price, unchanged (has the new value and the marker
    already), remap (only the reference changes), recompute, incomplete (a derived row whose window has a hole),
    untouched, inactive (a replaced or rejected row that would have been priced or refused: never written).
    derived: asset_id, metric_key, input, sign, days, function (burn_momentum, flow_annualized), a row for each input.
    Derived rows follow every day that is priced here, changed or not, and every day that carries the marker already.
    start: the first day whose rows are written.
    """
    spark = observations.sparkSession
    in_range = F.lit(True) if start is None else F.col("day") >= F.lit(start).cast("date")
    rows = saved(classes(observations, remap, supply), spark, "reprice")
    active = rows.where(F.col("active") & in_range)
    found = _priced(active.where("class = 'price'"), prices)
    moved = ~F.col("new_ref").eqNullSafe(F.col("token_ref")) | F.col("new_amount").isNotNull()
    done = F.col("marked") & (F.col("usd") == F.col("value")) & ~moved
    action = F.when(F.col("class") != "price", F.col("class")).when(F.col("gap").isNotNull(), "refuse").when(done, "unchanged").otherwise("price")
    flows = active.join(found, "id", "left").withColumn("action", action)
    written = F.col("action") == "price"
    out = ["asset_id", "id", "metric_key", "day", "action", "reason", "basis", "old_value", "new_value", "old_ref", "new_ref", "new_amount"]
    no = lambda kind: F.lit(None).cast(kind)
    flows = saved(flows.select(
        *out[:4], "action", F.coalesce("reason", "gap").alias("reason"), F.when(written | (F.col("action") == "unchanged"), F.col("basis")).alias("basis"), F.col("value").alias("old_value"),
        F.when(written, F.col("usd")).otherwise(F.col("value")).alias("new_value"), F.col("token_ref").alias("old_ref"),
        F.when(written, F.col("new_ref")).otherwise(F.col("token_ref")).alias("new_ref"), F.when(written, F.col("new_amount")).alias("new_amount"),
    ), spark, "reprice-flows")
    plain = lambda rows, action: rows.select(
        *out[:4], F.lit(action).alias("action"), no("string").alias("reason"), no("string").alias("basis"), F.col("value").alias("old_value"), F.col("value").alias("new_value"),
        F.col("token_ref").alias("old_ref"), F.coalesce("ref", "token_ref").alias("new_ref"), no("double").alias("new_amount"),
    )
    inactive = plain(rows.where(~F.col("active") & in_range & (F.col("class") != "skip")).withColumn("ref", F.col("token_ref")), "inactive")
    old = remapped(observations, remap).where(~F.col("ref").eqNullSafe(F.col("token_ref")))
    renamed = plain(old.join(flows.where("action = 'price'").select("id"), "id", "left_anti"), "remap")
    marked = rows.where("active and marked").select(*_KEY, "day")
    days = flows.where("action in ('price', 'unchanged')").select(*_KEY, "day").unionByName(marked)
    intervals = merged(days.select(*_KEY, F.unix_date("day").alias("first"), F.unix_date("day").alias("last")), *_KEY)
    return flows.unionByName(inactive).unionByName(renamed).unionByName(_derived(observations, flows, intervals, derived, in_range).select(out))


def _derived(observations: DataFrame, flows: DataFrame, intervals: DataFrame, derived: DataFrame, in_range: Column) -> DataFrame:
    spark = observations.sparkSession
    name = lambda c: F.concat_ws("\n", "asset_id", c)
    order = graphs.levels(spark, derived.select(name("metric_key").alias("node"), name("input").alias("input")))
    metrics = derived.groupBy(*_KEY).agg(F.count("*").alias("inputs"), F.first("days").alias("days"), F.first("function").alias("function"))
    metrics = metrics.join(order.withColumnRenamed("node", "_n"), name("metric_key") == F.col("_n")).drop("_n")
    metrics = saved(metrics, spark, "derived-metrics")
    steps = [(r.level, r.days) for r in metrics.select("level", "days").distinct().orderBy("level", "days").collect()]  # configuration
    if any(level is None for level, _ in steps):
        raise ValueError("derived metrics form a cycle")
    new = flows.where("action = 'price'").select("id", "new_value")
    daily = observations.where(is_active() & (F.col("period_days") == 1)).join(new, "id", "left").select(*_KEY, "day", F.coalesce("new_value", "value").alias("value"), "observed_hour", "id")
    latest = lambda rows: rows.groupBy(*_KEY, "day").agg(F.max_by("value", F.struct("observed_hour", "id")).alias("value"))
    daily = saved(latest(daily), spark, "derived-inputs")
    stored = observations.where(is_active()).join(metrics.select(*_KEY), _KEY, "left_semi")
    given = derived.select("asset_id", F.col("metric_key").alias("_metric"), F.col("input").alias("metric_key"), "sign")
    out = None
    for level in sorted({level for level, _ in steps}):
        of_level = metrics.where(F.col("level") == level)
        wanted = given.join(of_level.select("asset_id", F.col("metric_key").alias("_metric"), "inputs", "days", "function"), ["asset_id", "_metric"])
        reach = intervals.join(wanted, _KEY).select("asset_id", F.col("_metric").alias("metric_key"), "first", (F.col("last") + F.col("days") - 1).alias("last"))
        reach = saved(merged(reach, *_KEY), spark, "derived-reach")
        sums = daily.join(wanted, _KEY).groupBy("asset_id", F.col("_metric").alias("metric_key"), "day", "inputs", "function", "days").agg(F.sum(F.col("value") * F.col("sign")).alias("value"), F.count("*").alias("_n"))
        sums = sums.where(F.col("_n") == F.col("inputs"))
        points = None
        for days in sorted({d for at, d in steps if at == level}):
            total = sums.where(F.col("days") == days).withColumn("_t", complete_sum(days, *_KEY)).where("_t is not null")
            value = F.when(F.col("function") == "flow_annualized", F.col("_t") * DAYS_PER_YEAR / days).otherwise(F.col("_t") / days)
            part = total.select(*_KEY, "day", value.alias("point"))
            points = part if points is None else points.unionByName(part)
        rows = covered(stored.join(of_level.select(*_KEY), _KEY, "left_semi").where(in_range).select(*_KEY, "id", "day", "value", "token_ref", "observed_hour"), reach, *_KEY)
        rows = rows.join(points, [*_KEY, "day"], "left")
        action = F.when(~F.col("touched"), "untouched").when(F.col("point").isNull(), "incomplete").when(F.col("point") == F.col("value"), "unchanged").otherwise("recompute")
        rows = rows.withColumn("action", action).withColumn("new_value", F.when(F.col("action") == "recompute", F.col("point")).otherwise(F.col("value")))
        rows = saved(rows, spark, "derived-rows")
        planned = rows.select(
            "asset_id", "id", "metric_key", "day", "action", F.lit(None).cast("string").alias("reason"), F.when(F.col("action") == "recompute", "derived").alias("basis"), F.col("value").alias("old_value"), "new_value",
            F.col("token_ref").alias("old_ref"), F.col("token_ref").alias("new_ref"), F.lit(None).cast("double").alias("new_amount"),
        )
        out = planned if out is None else out.unionByName(planned)
        # what the next level reads: the new values, and the days that were reached
        fresh = rows.select(*_KEY, "day", F.col("new_value").alias("value"), "observed_hour", "id")
        daily = daily.join(of_level.select(*_KEY), _KEY, "left_anti").unionByName(latest(fresh))
        intervals = intervals.unionByName(reach)
    return out if out is not None else flows.limit(0)


_WRITES = ("price", "remap", "recompute")


def conflicts(observations: DataFrame, planned: DataFrame) -> DataFrame:
    """asset_id, day, id of planned writes whose row has another value or reference by now: their asset's day isn't applied."""
    writes = planned.where(F.col("action").isin(*_WRITES)).select("asset_id", "day", "id", "old_value", "old_ref")
    now = observations.select("id", F.col("value").alias("_value"), F.col("token_ref").alias("_ref"), F.lit(True).alias("_there"))
    return writes.join(now, "id", "left").where("_there is null or _value <> old_value or not _ref <=> old_ref").select("asset_id", "day", "id")


def applied(observations: DataFrame, planned: DataFrame) -> DataFrame:
    """observations with the plan's writes, a whole day of an asset or nothing of it (see conflicts); priced and recomputed
    rows carry the marker."""
    broken = conflicts(observations, planned).select("asset_id", "day").distinct()
    writes = planned.where(F.col("action").isin(*_WRITES)).join(broken, ["asset_id", "day"], "left_anti")
    # a row may change its reference and be recomputed: one write each
    writes = writes.groupBy("id").agg(F.max_by("new_value", F.col("action") != "remap").alias("_value"), F.max_by("new_ref", F.col("action") == "remap").alias("_ref"), F.max("new_amount").alias("_amount"), F.bool_or(F.col("action") != "remap").alias("_mark"), F.lit(True).alias("_write"))
    rows = observations.join(writes, "id", "left")
    return rows.select(*(
        F.when(F.col("_write"), F.col("_value")).otherwise(F.col("value")).alias("value") if c == "value"
        else F.when(F.col("_write"), F.col("_ref")).otherwise(F.col("token_ref")).alias("token_ref") if c == "token_ref"
        else F.coalesce("_amount", "amount").alias("amount") if c == "amount"
        else (F.col("marked") | F.coalesce("_mark", F.lit(False))).alias("marked") if c == "marked"
        else F.col(c) for c in observations.columns
    ))
