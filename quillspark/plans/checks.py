"""Queries of the reconciliation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from .base import fx, query

END, DAY_NO = "2024-01-27", 26
#: check_id, side, metric, factor, days
TERMS = [
    ("sum", "lhs", "m0", 1.0, 5), ("sum", "rhs", "m1", 0.5, 5), ("sum", "rhs", "m2", 0.5, 5),
    ("two_path", "lhs", "m1", 1.0, 1), ("two_path", "rhs", "m2", 1.0, 1),
    ("coverage", "lhs", "m3", 1.0, 4), ("coverage", "rhs", "m0", 1.0, 4),
]
#: check_id, tolerance_pct, tolerance_abs
TOLERANCES = [("sum", 5.0, None), ("two_path", 10.0, 200.0), ("coverage", 8.0, None), ("parameter", 0.0, None), ("balance", 50.0, 10.0), ("supply", 50.0, None), ("price", 20.0, None), ("revision", 1.0, None)]
_T = ", ".join(f"('{c}', '{s}', '{m}', CAST({f} AS DOUBLE), {d})" for c, s, m, f, d in TERMS)
_GAP = "CASE WHEN greatest(abs(lhs), abs(rhs)) = 0 THEN 0 ELSE abs(lhs - rhs) / greatest(abs(lhs), abs(rhs)) * 100 END"


def _judge(sides: str) -> str:
    tol = ", ".join(f"('{c}', CAST({p} AS DOUBLE), {'CAST(NULL AS DOUBLE)' if a is None else f'CAST({a} AS DOUBLE)'})" for c, p, a in TOLERANCES)
    return f"""
SELECT asset, check_id, CASE WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN lhs END AS lhs, CASE WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN rhs END AS rhs, CASE WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN {_GAP} END AS gap_pct,
  CASE WHEN lhs IS NULL OR rhs IS NULL THEN 'incomplete' WHEN {_GAP} > pct AND NOT coalesce(abs(lhs - rhs) <= ab, false) THEN 'breach' ELSE 'ok' END AS status
FROM ({sides}) JOIN (VALUES {tol}) t(cid, pct, ab) ON cid = check_id"""


def _tolerances(spark):
    return spark.createDataFrame(TOLERANCES, "check_id string, tolerance_pct double, tolerance_abs double")


def _window(name):
    @query(f"check_{name}", _judge(f"""
SELECT asset, check_id, max(v) FILTER (WHERE side = 'lhs') AS lhs, max(v) FILTER (WHERE side = 'rhs') AS rhs FROM (
  SELECT asset, check_id, side, CASE WHEN bool_and(n = days) THEN sum(s * factor ORDER BY metric) END AS v FROM (
    SELECT a.asset, t.check_id, t.side, t.metric, t.factor, t.days, sum(d.value) AS s, count(d.value) AS n FROM (SELECT DISTINCT asset FROM fx_stmt_daily) a, (VALUES {_T}) t(check_id, side, metric, factor, days)
    LEFT JOIN fx_stmt_daily d ON d.asset = a.asset AND d.metric = t.metric AND d.day <= DATE '{END}' AND d.day > DATE '{END}' - t.days WHERE t.check_id = '{name}' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""))
    def run(spark, sf):
        daily = fx(spark, sf, "fx_stmt_daily")
        terms = spark.createDataFrame([t for t in TERMS if t[0] == name], "check_id string, side string, metric string, factor double, days int")
        return K.judge(K.window_sides(daily, daily.select("asset").distinct(), terms, END), _tolerances(spark))

    return run


check_sum, check_two_path, check_coverage = map(_window, ("sum", "two_path", "coverage"))


def _levels(spark, sf):
    return K_levels(fx(spark, sf, "fx_readings"))


def K_levels(rows):
    rows = rows.where("superseded_by is null and status = 'confirmed'")
    return rows.select(F.col("asset_id").alias("asset"), F.col("metric_key").alias("metric"), "hour", "id", "value")


_LEV = "lev AS (SELECT asset_id AS asset, metric_key AS metric, hour, id, value FROM fx_readings WHERE superseded_by IS NULL AND status = 'confirmed')"
_FIRST = "(SELECT value FROM lev l WHERE l.asset = a.asset AND l.metric = '{0}' AND l.hour >= {1} AND l.hour < {2} ORDER BY l.hour, l.id LIMIT 1)"
_ASSETS = "(SELECT DISTINCT asset FROM lev) a"


@query("check_parameter", _LEV + "\n---\n" + _judge(f"SELECT asset, 'parameter' AS check_id, {_FIRST.format('level.1', DAY_NO * 24 + 24, DAY_NO * 24 + 48)} AS lhs, CAST(50 AS DOUBLE) AS rhs FROM {_ASSETS}"))
def check_parameter(spark, sf):
    lev = _levels(spark, sf)
    sides = lev.select("asset").distinct().join(K.reading_at(lev, "level.1", DAY_NO * 24 + 24, 24, "lhs"), "asset", "left")
    return K.judge(sides.select("asset", F.lit("parameter").alias("check_id"), "lhs", F.lit(50.0).alias("rhs")), _tolerances(spark))


_CHANGE = f"{_FIRST.format('level.2', DAY_NO * 24 + 24, DAY_NO * 24 + 30)} - {_FIRST.format('level.2', DAY_NO * 24, DAY_NO * 24 + 6)}"
_FLOW = f"(SELECT value FROM fx_stmt_daily d WHERE d.asset = a.asset AND d.metric = '{{0}}' AND d.day = DATE '{END}')"


def _flows(spark, sf, a, b):
    day = fx(spark, sf, "fx_stmt_daily").where(f"day = date'{END}'")
    return day.groupBy("asset").agg((F.max(F.when(F.col("metric") == a, F.col("value"))) - F.max(F.when(F.col("metric") == b, F.col("value")))).alias("rhs"))


@query("check_balance", _LEV + "\n---\n" + _judge(f"SELECT asset, 'balance' AS check_id, {_CHANGE} AS lhs, {_FLOW.format('m0')} - {_FLOW.format('m1')} AS rhs FROM {_ASSETS}"))
def check_balance(spark, sf):
    lev = _levels(spark, sf)
    sides = K.level_change(lev, lev.select("asset").distinct(), "level.2", DAY_NO).join(_flows(spark, sf, "m0", "m1"), "asset", "left")
    return K.judge(sides.select("asset", F.lit("balance").alias("check_id"), F.col("change").alias("lhs"), "rhs"), _tolerances(spark))


@query("check_supply", _LEV + "\n---\n" + _judge(f"SELECT asset, 'supply' AS check_id, -({_CHANGE}) AS lhs, {_FLOW.format('m2')} - {_FLOW.format('m3')} AS rhs FROM {_ASSETS}"))
def check_supply(spark, sf):
    lev = _levels(spark, sf)
    sides = K.level_change(lev, lev.select("asset").distinct(), "level.2", DAY_NO).join(_flows(spark, sf, "m2", "m3"), "asset", "left")
    return K.judge(sides.select("asset", F.lit("supply").alias("check_id"), (-F.col("change")).alias("lhs"), "rhs"), _tolerances(spark))


@query("check_price", _LEV + "\n---\n" + _judge(f"SELECT asset, 'price' AS check_id, {_FIRST.format('level.3', DAY_NO * 24 + 24, DAY_NO * 24 + 48)} AS lhs, {_FIRST.format('level.4', DAY_NO * 24 + 24, DAY_NO * 24 + 48)} AS rhs FROM {_ASSETS}"))
def check_price(spark, sf):
    lev = _levels(spark, sf)
    sides = lev.select("asset").distinct()
    for metric, name in (("level.3", "lhs"), ("level.4", "rhs")):
        sides = sides.join(K.reading_at(lev, metric, DAY_NO * 24 + 24, 24, name), "asset", "left")
    return K.judge(sides.withColumn("check_id", F.lit("price")), _tolerances(spark))


_REV = "SELECT event_type AS asset, day, event_id AS id, CAST(event_id % 2 AS VARCHAR(9)) AS origin, v AS value, CASE WHEN event_id % 5 <> 0 THEN event_id + 1 END AS superseded_by FROM fx_events WHERE event_id % 20 < 7"


@query("check_revision", f"""
rv AS ({_REV}), w AS (SELECT * FROM rv WHERE day <= DATE '{END}' AND day > DATE '{END}' - 5),
f AS (SELECT asset, day, arg_min(id, id) AS id, arg_min(origin, id) AS origin, arg_min(value, id) AS value FROM w WHERE superseded_by IS NULL GROUP BY asset, day),
o AS (SELECT asset, day, origin, arg_min(value, id) AS was FROM w GROUP BY ALL),
b AS (SELECT f.asset, f.day, o.was, f.value AS cur, CASE WHEN greatest(abs(was), abs(value)) = 0 THEN 0 ELSE abs(was - value) / greatest(abs(was), abs(value)) * 100 END AS gap FROM f JOIN o USING (asset, day, origin)),
r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY gap DESC, day) AS r FROM b),
s AS (SELECT asset, CASE WHEN max(cur) FILTER (WHERE day = DATE '{END}') IS NOT NULL THEN CASE WHEN max(gap) > 0 THEN max(was) FILTER (WHERE r = 1) ELSE max(cur) FILTER (WHERE day = DATE '{END}') END END AS lhs,
  CASE WHEN max(cur) FILTER (WHERE day = DATE '{END}') IS NOT NULL THEN CASE WHEN max(gap) > 0 THEN max(cur) FILTER (WHERE r = 1) ELSE max(cur) FILTER (WHERE day = DATE '{END}') END END AS rhs FROM r GROUP BY asset)
---
""" + _judge("SELECT asset, 'revision' AS check_id, lhs, rhs FROM s"))
def check_revision(spark, sf):
    rows = spark.sql(_REV.replace("fx_events", "{e}").replace("VARCHAR(9)", "STRING"), e=fx(spark, sf, "fx_events"))
    return K.judge(K.revisions(rows, 5, END).withColumn("check_id", F.lit("revision")), _tolerances(spark))


@query("check_record", "SELECT user_id, event_type, day, count(*) AS n FROM fx_events e WHERE v > 60 AND event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM fx_events b WHERE b.user_id = e.user_id AND b.event_type = e.event_type AND b.day = e.day AND b.v > 60 AND b.event_id % 2 = 0) GROUP BY ALL")
def check_record(spark, sf):
    e = fx(spark, sf, "fx_events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("check_id"), "day", F.expr("if(v > 60, 'breach', 'ok')").alias("status"), "event_id")
    new = K.newly_breached(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"))
    return new.groupBy(F.col("asset").alias("user_id"), F.col("check_id").alias("event_type"), "day").agg(F.count("*").alias("n"))
