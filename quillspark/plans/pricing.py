"""Queries that price flows, and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import asof, graphs, pricing as P
from .base import fx, query


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """fx_flow_rows with the 24 hourly amounts as an array."""
    hours = fx(spark, sf, "fx_flow_hours").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "amount"))).alias("m"))  # 24 at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    return fx(spark, sf, "fx_flow_rows").join(hours, "id", "left").withColumn("hourly_amounts", F.when(F.col("has_hours"), dense)).drop("m")


_FLOWS = """
fl AS (SELECT * FROM fx_flow_rows WHERE superseded_by IS NULL AND status <> 'rejected' AND period_days IS NOT NULL AND starts_with(metric_key, 'flow_usd.')),
hrs AS (SELECT fl.id, fl.token_ref, fl.observed_hour - 24 + i AS hour, coalesce(a.amount, 0) AS amt FROM fl, range(24) t(i) LEFT JOIN fx_flow_hours a ON a.id = fl.id AND a.h = i WHERE fl.has_hours)"""
_AGG = """CASE WHEN count(*) FILTER (WHERE amt <> 0 AND p IS NULL) = 0 THEN coalesce(sum(CASE WHEN amt <> 0 THEN amt * p END), 0) END AS usd_hourly,
  count(p) AS hours_priced, count(*) FILTER (WHERE amt <> 0) AS hours_needed, count(*) FILTER (WHERE amt <> 0 AND p IS NULL) AS hours_missing"""


@query("flow_usd", _FLOWS + f""",
pr AS (SELECT id, amt, (SELECT price FROM fx_prices p WHERE p.token_ref = hrs.token_ref AND p.hour <= hrs.hour AND p.hour >= hrs.hour - 6
  ORDER BY CASE WHEN source = 'coingecko' THEN 0 ELSE 1 END, p.hour DESC, fetched_at DESC, source LIMIT 1) AS p FROM hrs),
h AS (SELECT id, {_AGG} FROM pr GROUP BY id)
---
SELECT fl.id, metric_key, coalesce(hours_priced, 0) AS hours_priced, coalesce(hours_needed, 0) AS hours_needed,
  CASE WHEN token_ref = 'usd' AND amount IS NOT NULL THEN amount WHEN has_hours AND hours_missing = 0 THEN usd_hourly ELSE value END AS usd,
  CASE WHEN token_ref = 'usd' AND amount IS NOT NULL THEN 'usd_native' WHEN has_hours AND hours_missing = 0 THEN 'hourly' WHEN has_hours THEN 'legacy_unpriced' WHEN amount IS NOT NULL THEN 'legacy_no_hourly' ELSE 'legacy_no_tokens' END AS usd_basis
FROM fl LEFT JOIN h USING (id)""")
def flow_usd(spark, sf):
    return P.flow_usd(flows(spark, sf), fx(spark, sf, "fx_prices")).select("id", "metric_key", "hours_priced", "hours_needed", "usd", "usd_basis")


_CHAIN = _FLOWS + f""",
cp AS (SELECT token_ref, hour, price FROM (SELECT *, row_number() OVER (PARTITION BY token_ref, hour ORDER BY fetched_at DESC, source) AS r FROM fx_prices
  WHERE starts_with(source, 'chain:') OR starts_with(source, 'first_party:')) WHERE r = 1),
pr AS (SELECT id, amt, (SELECT price FROM cp p WHERE p.token_ref = hrs.token_ref AND p.hour <= hrs.hour AND p.hour >= hrs.hour - 6 ORDER BY p.hour DESC LIMIT 1) AS p FROM hrs),
h AS (SELECT id, {_AGG} FROM pr GROUP BY id),
d AS (SELECT fl.id, count(cp.price) AS day_hours, avg(cp.price) AS mean_usd FROM fl LEFT JOIN cp ON cp.token_ref = fl.token_ref AND cp.hour >= observed_hour - 24 AND cp.hour < observed_hour
  WHERE NOT has_hours AND amount IS NOT NULL AND fl.token_ref <> 'usd' AND period_days = 1 GROUP BY fl.id),
priced AS (SELECT fl.*, coalesce(hours_priced, day_hours, 0) AS hours_priced, coalesce(hours_needed, CASE WHEN d.id IS NOT NULL THEN 24 END, 0) AS hours_needed,
  CASE WHEN token_ref = 'usd' AND amount IS NOT NULL THEN amount WHEN has_hours AND hours_missing = 0 THEN usd_hourly WHEN NOT has_hours AND day_hours = 24 THEN amount * mean_usd ELSE value END AS usd,
  CASE WHEN token_ref = 'usd' AND amount IS NOT NULL THEN 'usd_native' WHEN has_hours AND hours_missing = 0 THEN 'hourly' WHEN has_hours THEN 'legacy_unpriced' WHEN day_hours = 24 THEN 'daily_mean'
    WHEN amount IS NOT NULL THEN 'legacy_no_hourly' ELSE 'legacy_no_tokens' END AS usd_basis
FROM fl LEFT JOIN h USING (id) LEFT JOIN d USING (id))
---"""


def _chain(spark, sf):
    return P.flow_usd_chain(flows(spark, sf), fx(spark, sf, "fx_prices"))


@query("flow_usd_chain", _CHAIN + "SELECT id, asset_id, metric_key, hours_priced, hours_needed, usd, usd_basis FROM priced")
def flow_usd_chain(spark, sf):
    return _chain(spark, sf).select("id", "asset_id", "metric_key", "hours_priced", "hours_needed", "usd", "usd_basis")


@query("price_basis", _CHAIN + "SELECT CASE usd_basis WHEN 'usd_native' THEN 'native' WHEN 'hourly' THEN 'hourly' WHEN 'daily_mean' THEN 'daily_mean' ELSE 'legacy' END AS basis, count(*) AS n, sum(usd) AS usd FROM priced GROUP BY 1")
def price_basis(spark, sf):
    return _chain(spark, sf).groupBy(P.price_basis(F.col("usd_basis")).alias("basis")).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


@query("compare_usd", _CHAIN + """
SELECT asset_id, count(*) AS n, sum(value) AS legacy, sum(usd) AS priced, quantile_disc(g, 0.5) AS p50, quantile_disc(g, 0.9) AS p90
FROM (SELECT *, CASE WHEN value = 0 THEN CASE WHEN usd = 0 THEN 0 ELSE 100 END ELSE abs(usd - value) / abs(value) * 100 END AS g FROM priced) GROUP BY asset_id""")
def compare_usd(spark, sf):
    return P.compare_usd(_chain(spark, sf), "asset_id")


@query("reprice_plan", _CHAIN + """
SELECT asset_id, plan, count(*) AS n, sum(value) AS old_usd, sum(CASE WHEN plan = 'price' THEN usd ELSE value END) AS new_usd FROM (
  SELECT *, CASE WHEN usd_basis = 'usd_native' THEN 'skip: usd_native' WHEN id % 4 = 2 THEN 'skip: third_party' WHEN id % 6 = 1 THEN 'skip: disclosed' WHEN id % 6 = 3 THEN 'skip: derived'
    WHEN usd_basis = 'legacy_unpriced' THEN 'refuse: hours without a price' WHEN usd_basis IN ('hourly', 'daily_mean') THEN 'price' ELSE 'skip: no tokens' END AS plan FROM priced) GROUP BY asset_id, plan""")
def reprice_plan(spark, sf):
    rows = _chain(spark, sf).withColumns({"source_type": F.expr("if(id % 4 = 2, 'third_party', 'chain')"), "method": F.expr("case id % 6 when 1 then 'disclosed' when 3 then 'derived' else 'measured' end")})
    rows = rows.withColumn("plan", P.reprice_class(F.col("source_type"), F.col("method"), F.col("usd_basis")))
    return rows.groupBy("asset_id", "plan").agg(F.count("*").alias("n"), F.sum("value").alias("old_usd"), F.sum(F.when(F.col("plan") == "price", F.col("usd")).otherwise(F.col("value"))).alias("new_usd"))


@query("hour_price_dedupe", "SELECT token_ref, hour, price FROM (SELECT *, row_number() OVER (PARTITION BY token_ref, hour ORDER BY fetched_at DESC, source) AS r FROM fx_prices) WHERE r = 1")
def hour_price_dedupe(spark, sf):
    return asof.hour_price_dedupe(fx(spark, sf, "fx_prices"))


@query("asof_price_6h", """
d AS (SELECT token_ref, hour, arg_max(price, fetched_at) AS price FROM fx_prices WHERE source = 'chain:a' GROUP BY token_ref, hour)
---
SELECT event_id, (SELECT price FROM d WHERE d.token_ref = e.event_type AND d.hour <= e.hour AND d.hour >= e.hour - 6 ORDER BY d.hour DESC LIMIT 1) AS price FROM fx_events e""")
def asof_price_6h(spark, sf):
    prices = asof.hour_price_dedupe(fx(spark, sf, "fx_prices").where("source = 'chain:a'"))
    rows = fx(spark, sf, "fx_events").select("event_id", F.col("event_type").alias("token_ref"), "hour")
    return asof.asof_value(rows, prices, "token_ref", "hour", "price", P.LOOKBACK).select("event_id", "price")


@query("rebuild_levels", """
d AS (SELECT token_ref, hour, price FROM (SELECT *, row_number() OVER (PARTITION BY token_ref, hour ORDER BY fetched_at DESC, source) AS r FROM fx_prices) WHERE r = 1)
---
SELECT id, (SELECT price FROM d WHERE d.token_ref = l.asset_id AND d.hour <= l.hour - 1 AND d.hour >= l.hour - 7 ORDER BY d.hour DESC LIMIT 1) AS price FROM fx_readings l WHERE metric_key = 'level.2'""")
def rebuild_levels(spark, sf):
    levels = fx(spark, sf, "fx_readings").where("metric_key = 'level.2'").select("id", F.col("asset_id").alias("token_ref"), "hour")
    return P.rebuild_levels(levels, asof.hour_price_dedupe(fx(spark, sf, "fx_prices"))).select("id", "price")


@query("asof_level", "SELECT asset_id, metric_key, arg_max(id, struct_pack(a := hour, b := id)) AS id, arg_max(value, struct_pack(a := hour, b := id)) AS value, max(hour) AS hour FROM fx_readings WHERE hour <= 300 GROUP BY asset_id, metric_key")
def asof_level(spark, sf):
    return asof.asof_level(fx(spark, sf, "fx_readings"), 300, "asset_id", "metric_key")


@query("schedule_in_force", """
n AS (SELECT asset_id, metric_key, arg_max(id, struct_pack(a := hour, b := id)) AS id FROM fx_readings WHERE hour <= 600 GROUP BY asset_id, metric_key)
---
SELECT r.asset_id, r.metric_key, r.hour, r.id, r.value, r.hour <= 600 AS in_force FROM fx_readings r LEFT JOIN n USING (id) WHERE r.hour > 600 OR n.id IS NOT NULL""")
def schedule_in_force(spark, sf):
    return asof.schedule(fx(spark, sf, "fx_readings"), 600, "asset_id", "metric_key")


@query("first_reading", "SELECT asset_id, metric_key, min(hour) AS hour, arg_min(id, struct_pack(a := hour, b := id)) AS id, arg_min(value, struct_pack(a := hour, b := id)) AS value FROM fx_readings WHERE hour >= 240 AND hour < 246 GROUP BY asset_id, metric_key")
def first_reading(spark, sf):
    return asof.first_reading(fx(spark, sf, "fx_readings"), 240, 6, "asset_id", "metric_key")


@query("previous_level", """
SELECT id, (SELECT value FROM fx_readings b WHERE b.asset_id = a.asset_id AND b.metric_key = a.metric_key AND b.hour < a.hour ORDER BY b.hour DESC, b.id DESC LIMIT 1) AS previous FROM fx_readings a""")
def previous_level(spark, sf):
    return asof.previous(fx(spark, sf, "fx_readings"), "asset_id", "metric_key").select("id", "previous")


@query("nearest_within", """
o AS (SELECT asset_id, hour, id, value FROM fx_readings WHERE metric_key = 'level.3' AND value > 97), p AS (SELECT DISTINCT asset_id, hour AS at_hour FROM fx_readings),
n AS (SELECT p.asset_id, p.at_hour, arg_min(struct_pack(h := o.hour, v := o.value), struct_pack(d := abs(o.hour - p.at_hour), h := o.hour, i := o.id)) AS x FROM p JOIN o ON o.asset_id = p.asset_id AND abs(o.hour - p.at_hour) <= 12 GROUP BY 1, 2),
f AS (SELECT asset_id, arg_min(struct_pack(h := hour, v := value), struct_pack(h := hour, i := id)) AS x FROM o GROUP BY asset_id)
---
SELECT p.asset_id, p.at_hour AS "at", coalesce(n.x, f.x).h AS base_hour, coalesce(n.x, f.x).v AS base, CASE WHEN n.x IS NOT NULL THEN 'near' ELSE 'earliest' END AS basis FROM p LEFT JOIN n USING (asset_id, at_hour) LEFT JOIN f USING (asset_id)""")
def nearest_within(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    points = rows.select("asset_id", F.col("hour").alias("at")).distinct()
    return asof.nearest(points, rows.where("metric_key = 'level.3' and value > 97").select("asset_id", "hour", "id", "value"), "asset_id", 12)


@query("interval_overlap", """
p AS (SELECT id, asset_id, hour AS start, hour + 1 + id % 4 AS stop FROM fx_readings WHERE id % 2 = 0), q AS (SELECT id, asset_id, hour AS start, hour + 1 + id % 3 AS stop FROM fx_readings WHERE id % 2 = 1)
---
SELECT p.asset_id, p.id AS a_id, q.id AS b_id, least(p.stop, q.stop) - greatest(p.start, q.start) AS overlap_hours FROM p JOIN q ON p.asset_id = q.asset_id AND least(p.stop, q.stop) > greatest(p.start, q.start)""")
def interval_overlap(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    p = rows.where("id % 2 = 0").select("id", "asset_id", F.col("hour").alias("start"), F.expr("hour + 1 + id % 4").alias("stop"))
    q = rows.where("id % 2 = 1").select("id", "asset_id", F.col("hour").alias("start"), F.expr("hour + 1 + id % 3").alias("stop"))
    return asof.overlaps(p, q, "asset_id", bin_hours=1)


@query("breach_runs", """
g AS (SELECT token_ref, hour, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE max(price) - min(price) END AS gap, hour % 3 = 0 AS fresh FROM fx_prices GROUP BY token_ref, hour),
a AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND NOT abs(gap) > 20 THEN 1 ELSE 0 END + CASE WHEN hour - lg > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY token_ref ORDER BY hour) AS run FROM (SELECT *, lag(hour) OVER (PARTITION BY token_ref ORDER BY hour) AS lg FROM g)),
b AS (SELECT *, row_number() OVER w AS k, max(fresh::INT) OVER w AS fr FROM a WHERE gap IS NOT NULL AND abs(gap) > 20 WINDOW w AS (PARTITION BY token_ref, run ORDER BY hour))
---
SELECT token_ref, hour, gap FROM b WHERE k = 2 AND fr = 1""")
def breach_runs(spark, sf):
    g = fx(spark, sf, "fx_prices").groupBy("token_ref", "hour").agg(F.when(F.count("*") % 5 != 0, F.max("price") - F.min("price")).alias("gap")).withColumn("fresh", F.col("hour") % 3 == 0)
    return P.breach_runs(g, 20.0, 2, "token_ref").select("token_ref", "hour", "gap")


@query("with_check", """
p AS (SELECT token_ref, hour, max(price) FILTER (WHERE source = 'chain:a') AS price, max(price) FILTER (WHERE source = 'coingecko') AS chk FROM fx_prices GROUP BY token_ref, hour)
---
SELECT token_ref, hour, CASE WHEN chk > 0 THEN (price - chk) / chk * 100 END AS gap, CASE WHEN price < 20 THEN (price - 20) / 20 * 100 WHEN price > 80 THEN (price - 80) / 80 * 100 ELSE 0 END AS off FROM p WHERE price IS NOT NULL""")
def with_check(spark, sf):
    p = fx(spark, sf, "fx_prices").groupBy("token_ref", "hour").agg(*(F.max(F.when(F.col("source") == s, F.col("price"))).alias(c) for s, c in (("chain:a", "price"), ("coingecko", "chk"))))
    return p.where("price is not null").select("token_ref", "hour", P.with_check(F.col("price"), F.col("chk")).alias("gap"), P.outside(F.col("price"), F.lit(20.0), F.lit(80.0)).alias("off"))


@query("daily_mean_price", """
d AS (SELECT token_ref, hour, arg_max(price, fetched_at) AS price FROM fx_prices GROUP BY token_ref, hour)
---
SELECT token_ref, hour // 24 AS day_no, avg(price) AS mean FROM d GROUP BY 1, 2 HAVING count(*) >= 20""")
def daily_mean_price(spark, sf):
    d = asof.hour_price_dedupe(fx(spark, sf, "fx_prices"))
    return d.groupBy("token_ref", F.expr("hour div 24").alias("day_no")).agg(F.count("*").alias("n"), F.avg("price").alias("mean")).where("n >= 20").drop("n")


@query("recent_price_hours", """
h AS (SELECT DISTINCT token_ref, hour FROM fx_prices WHERE source = 'chain:a'), s AS (SELECT t.token_ref, i AS hour FROM (SELECT DISTINCT token_ref FROM h) t, range(600, 648) r(i))
---
SELECT token_ref, min(hour) AS hour FROM s ANTI JOIN h USING (token_ref, hour) GROUP BY token_ref""")
def recent_price_hours(spark, sf):
    h = fx(spark, sf, "fx_prices").where("source = 'chain:a'").select("token_ref", "hour").distinct()
    s = h.select("token_ref").distinct().select("token_ref", F.explode(F.sequence(F.lit(600).cast("long"), F.lit(647).cast("long"))).alias("hour"))
    return s.join(h, ["token_ref", "hour"], "left_anti").groupBy("token_ref").agg(F.min("hour").alias("hour"))


@query("quote_order", """
c AS (SELECT n_nationkey AS ref, CASE WHEN n_nationkey > 4 THEN n_nationkey // 2 END AS quote FROM nation),
r AS (SELECT ref, 0 AS depth FROM c WHERE quote IS NULL UNION ALL SELECT c.ref, r.depth + 1 FROM c JOIN r ON c.quote = r.ref)
---
SELECT ref, depth FROM r""")
def quote_order(spark, sf):
    """The order in which quoted references can be priced, by trimming."""
    c = fx(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as node", "if(n_nationkey > 4, cast(n_nationkey div 2 as bigint), null) as input")
    return graphs.levels(spark, c).withColumnsRenamed({"node": "ref", "level": "depth"})


@query("gap_functions", """
SELECT n, CASE WHEN greatest(abs(a), abs(b)) = 0 THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) * 100 END AS gap, CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0 ELSE 100 END ELSE abs(a - b) / abs(a) * 100 END AS level_gap,
  CASE WHEN b > 0 THEN a / b END AS ratio, CAST(n - n % 6 AS BIGINT) AS slot FROM (SELECT event_id AS n, v - 50 AS a, CASE WHEN event_id % 7 = 0 THEN 0 ELSE v / 2 END AS b FROM fx_events)""")
def gap_functions(spark, sf):
    x = fx(spark, sf, "fx_events").select(F.col("event_id").alias("n"), (F.col("v") - 50).alias("a"), F.expr("if(event_id % 7 = 0, 0D, v / 2)").alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("n", V.gap_pct(a, b).alias("gap"), V.compare_level(a, b).alias("level_gap"), V.divided(a, b).alias("ratio"), V.newest_slot(F.col("n"), 6).alias("slot"))
