"""Queries over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as T
from .base import fx, query

WIN = "PARTITION BY metric ORDER BY day RANGE BETWEEN INTERVAL {0} DAYS PRECEDING AND {1}"
CUR = lambda n: WIN.format(n - 1, "CURRENT ROW")
PRI = lambda n: WIN.format(2 * n - 1, f"INTERVAL {n} DAYS PRECEDING")


@query("confirmed_daily", """
SELECT asset_id, metric_key, day, arg_max(value, struct_pack(a := observed_hour, b := id)) AS value FROM fx_flow_rows
WHERE superseded_by IS NULL AND status = 'confirmed' AND period_days = 1 GROUP BY asset_id, metric_key, day""")
def confirmed_daily(spark, sf):
    return T.confirmed_daily(fx(spark, sf, "fx_flow_rows"), "asset_id", "metric_key")


@query("eligible", """
a AS (SELECT * FROM fx_readings WHERE superseded_by IS NULL AND status <> 'rejected')
---
SELECT id, status FROM a WHERE status = 'confirmed' OR NOT EXISTS (SELECT 1 FROM a b WHERE b.asset_id = a.asset_id AND b.metric_key = a.metric_key AND b.hour = a.hour AND b.status = 'confirmed')""")
def eligible(spark, sf):
    return T.eligible(fx(spark, sf, "fx_readings"), "asset_id", "metric_key", "hour").select("id", "status")


@query("window_sum", """
SELECT CASE WHEN count(*) = 14 THEN sum(value) END AS total FROM fx_daily WHERE metric IN ('1', '2') AND day BETWEEN DATE '1997-06-08' AND DATE '1997-06-14'""")
def window_sum(spark, sf):
    return T.window_sum(fx(spark, sf, "fx_daily"), "1997-06-14", 7, ["1", "2"])


@query("burn_momentum", f"SELECT metric, day, mean FROM (SELECT metric, day, CASE WHEN count(*) OVER ({CUR(7)}) = 7 THEN sum(value) OVER ({CUR(7)}) / 7 END AS mean FROM fx_daily) WHERE mean IS NOT NULL")
def burn_momentum(spark, sf):
    return T.burn_momentum(fx(spark, sf, "fx_daily"), 7, "metric").select("metric", "day", "mean")


@query("flow_annualized", f"SELECT metric, day, annualized FROM (SELECT metric, day, CASE WHEN count(*) OVER ({CUR(5)}) = 5 THEN sum(value) OVER ({CUR(5)}) * 365 / 5 END AS annualized FROM fx_daily) WHERE annualized IS NOT NULL")
def flow_annualized(spark, sf):
    return T.flow_annualized(fx(spark, sf, "fx_daily"), 5, "metric").select("metric", "day", "annualized")


@query("growth", f"""
w AS (SELECT metric, day, CASE WHEN count(*) OVER ({CUR(3)}) = 3 THEN sum(value) OVER ({CUR(3)}) END AS cur, CASE WHEN count(*) OVER ({PRI(3)}) = 3 THEN sum(value) OVER ({PRI(3)}) END AS pri FROM fx_daily)
---
SELECT metric, day, cur AS "current", pri AS prior, CASE WHEN cur IS NOT NULL AND pri > 0 THEN cur / pri - 1 END AS change,
  CASE WHEN cur >= 0 AND pri > 0 AND pow(cur / pri, CAST(365 AS DOUBLE) / 3) < 1e12 THEN round(pow(cur / pri, CAST(365 AS DOUBLE) / 3) - 1, 3) END AS annualized,
  CASE WHEN cur IS NULL OR pri IS NULL THEN 'incomplete' WHEN NOT (pri > 0) OR cur < 0 THEN 'not meaningful' END AS note
FROM w""")
def growth(spark, sf):
    g = T.growth(fx(spark, sf, "fx_daily"), 3, "metric")
    return g.select("metric", "day", "current", "prior", "change", F.when(F.col("annualized") + 1 < 1e12, F.round("annualized", 3)).alias("annualized"), "note")


@query("disclosed_growth", """
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC, id DESC) AS r FROM fx_daily),
t AS (SELECT metric, max(value) FILTER (WHERE r = 1) AS cur, max(value) FILTER (WHERE r = 2) AS pri, datediff('day', max(day) FILTER (WHERE r = 2), max(day) FILTER (WHERE r = 1))::INTEGER AS gap_days FROM r GROUP BY metric)
---
SELECT metric, cur AS "current", pri AS prior, gap_days, CASE WHEN pri > 0 THEN cur / pri - 1 END AS change, gap_days < 90 AS close_together FROM t""")
def disclosed_growth(spark, sf):
    return T.last_two(fx(spark, sf, "fx_daily"), "metric")


@query("full_month_sums", """
SELECT metric, strftime(day, '%Y-%m') AS month, sum(value) AS total FROM fx_daily GROUP BY 1, 2 HAVING count(DISTINCT day) = max(extract(day FROM last_day(day)))""")
def full_month_sums(spark, sf):
    return T.full_months(fx(spark, sf, "fx_daily"), "metric")


@query("month_compare", """
m AS (SELECT metric, strftime(day, '%Y-%m') AS month, sum(value) AS total FROM fx_daily GROUP BY 1, 2 HAVING count(DISTINCT day) = max(extract(day FROM last_day(day))))
---
SELECT month, a.total AS lhs, b.total AS rhs, abs(a.total - b.total) / abs(a.total) * 100 AS diff_pct FROM m a JOIN m b USING (month) WHERE a.metric = 'all' AND b.metric = 'low'""")
def month_compare(spark, sf):
    m = T.full_months(fx(spark, sf, "fx_daily"), "metric")
    both = m.where("metric = 'all'").select("month", F.col("total").alias("lhs")).join(m.where("metric = 'low'").select("month", F.col("total").alias("rhs")), "month")
    return both.withColumn("diff_pct", F.abs(F.col("lhs") - F.col("rhs")) / F.abs("lhs") * 100)


@query("day_align", "SELECT day, sum(CASE WHEN metric = '3' THEN -value ELSE value END) AS value FROM fx_daily WHERE metric IN ('1', '2', '3') GROUP BY day HAVING count(DISTINCT metric) = 3")
def day_align(spark, sf):
    return T.day_align(fx(spark, sf, "fx_daily"), {"1": 1, "2": 1, "3": -1})


@query("gap_days", """
s AS (SELECT metric, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM fx_daily GROUP BY metric)
---
SELECT metric, day FROM s ANTI JOIN fx_daily USING (metric, day)""")
def gap_days(spark, sf):
    return T.gap_days(fx(spark, sf, "fx_daily"), "metric")


@query("burns_by_day", """
e AS (SELECT event_type AS asset, hour, min(event_id) AS id FROM fx_events GROUP BY 1, 2),
r AS (SELECT asset, hour, id, 1000000 - sum(hour % 5) OVER (PARTITION BY asset ORDER BY hour) AS supply FROM e),
s AS (SELECT *, lag(hour) OVER w AS h0, lag(supply) OVER w AS s0 FROM r WINDOW w AS (PARTITION BY asset ORDER BY hour, id)),
d AS (SELECT asset, h0, hour, (s0 - supply)::DOUBLE / (hour - h0) AS rate, unnest(range(h0 // 24, (hour - 1) // 24 + 1)) AS day_no FROM s WHERE h0 < hour)
---
SELECT asset, day_no, round(sum(rate * (least(hour, day_no * 24 + 24) - greatest(h0, day_no * 24))), 6) AS burned FROM d JOIN (SELECT asset, min(hour) AS lo, max(hour) AS hi FROM r GROUP BY asset) USING (asset)
WHERE lo <= day_no * 24 AND hi >= day_no * 24 + 24 GROUP BY asset, day_no""")
def burns_by_day(spark, sf):
    from pyspark.sql import Window

    e = fx(spark, sf, "fx_events").groupBy(F.col("event_type").alias("asset"), "hour").agg(F.min("event_id").alias("id"))
    r = e.withColumn("supply", 1000000 - F.sum(F.col("hour") % 5).over(Window.partitionBy("asset").orderBy("hour")))
    return T.burns_by_day(r, "asset").withColumn("burned", F.round("burned", 6))


_PAY = """
pay AS (SELECT metric, day, 1 + n % 5 AS period_days, value, id FROM fx_daily)"""


def _payments(spark, sf):
    return fx(spark, sf, "fx_daily").select("metric", "day", (1 + F.col("n") % 5).alias("period_days"), "value", "id")


@query("periodic_spread", _PAY + """,
c AS (SELECT metric, unnest(generate_series(day - (period_days::INTEGER - 1), day, INTERVAL 1 DAY))::DATE AS d, value / period_days AS rate, day AS paid, id FROM pay),
x AS (SELECT metric, d AS day, arg_max(rate, struct_pack(a := paid, b := id)) AS value, false AS provisional FROM c GROUP BY metric, d),
l AS (SELECT metric, max(day) AS hi, arg_max(value / period_days, struct_pack(a := day, b := id)) AS rate FROM pay GROUP BY metric)
---
SELECT * FROM x UNION ALL SELECT metric, unnest(generate_series(hi + 1, DATE '2001-09-10', INTERVAL 1 DAY))::DATE, rate, true FROM l""")
def periodic_spread(spark, sf):
    return T.periodic_spread(_payments(spark, sf), "2001-09-10", "metric")


@query("accrual_check", _PAY + """,
a AS (SELECT *, lag(value / period_days) OVER (PARTITION BY metric ORDER BY day, id) * period_days AS accrued FROM pay)
---
SELECT metric, day, value, accrued, round((value / accrued - 1) * 100, 6) AS diff_pct FROM a WHERE accrued > 0 AND abs((value / accrued - 1) * 100) > 2""")
def accrual_check(spark, sf):
    return T.accrual_check(_payments(spark, sf), 2.0, "metric").select("metric", "day", "value", "accrued", F.round("diff_pct", 6).alias("diff_pct"))


@query("last_complete_day", "SELECT CASE WHEN count(*) = 3 THEN min(d) END AS day FROM (SELECT metric, max(day) AS d FROM fx_daily WHERE metric IN ('1', '2', '5') GROUP BY metric)")
def last_complete_day(spark, sf):
    return T.last_complete_day(fx(spark, sf, "fx_daily"), ["1", "2", "5"])


@query("report_lag", "SELECT metric, least(max(day), DATE '2001-07-01') AS used, datediff('day', least(max(day), DATE '2001-07-01'), DATE '2001-07-01')::INTEGER AS lag_days FROM fx_daily GROUP BY metric")
def report_lag(spark, sf):
    wanted = F.lit("2001-07-01").cast("date")
    used = fx(spark, sf, "fx_daily").groupBy("metric").agg(F.least(F.max("day"), wanted).alias("used"))
    return used.withColumn("lag_days", F.datediff(wanted, "used"))


@query("young_weight", "SELECT metric, count(DISTINCT day) AS n_days, greatest(1.0::DOUBLE, 3000::DOUBLE / count(DISTINCT day)) AS weight FROM fx_daily GROUP BY metric")
def young_weight(spark, sf):
    return T.young_weight(fx(spark, sf, "fx_daily"), 3000, "metric")


@query("young_streams", """
s(metric, started) AS (VALUES ('1', DATE '2000-03-20'), ('2', DATE '2000-04-10'), ('5', DATE '2001-01-01'), ('low', DATE '1999-01-01')),
d AS (SELECT metric, day::DATE AS day FROM s, unnest(generate_series(DATE '2000-04-15' - 59, DATE '2000-04-15', INTERVAL 1 DAY)) t(day) WHERE day < started),
a AS (SELECT metric, day, value FROM fx_daily UNION ALL SELECT metric, day, 0 FROM d WHERE NOT EXISTS (SELECT 1 FROM fx_daily f WHERE f.metric = d.metric AND f.day = d.day))
---
SELECT metric, count(*) AS n, sum(value) AS total, round(max(CASE metric WHEN '1' THEN 30 / 27.0::DOUBLE WHEN '2' THEN 30 / 6.0::DOUBLE ELSE 1 END), 9) AS weight FROM a GROUP BY metric""")
def young_streams(spark, sf):
    """Series that began within the window, or after it: zeros before their start, and the weight of their age."""
    rows = [("1", "2000-03-20"), ("2", "2000-04-10"), ("5", "2001-01-01"), ("low", "1999-01-01")]
    started = spark.createDataFrame(rows, "metric string, started string").withColumn("started", F.col("started").cast("date"))
    filled = T.with_start(fx(spark, sf, "fx_daily"), started, "2000-04-15", 30, "metric")
    return filled.groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.round(F.max("weight"), 9).alias("weight"))


@query("report_stale", "SELECT metric, max(day) AS day, datediff('day', max(day), DATE '2001-08-03')::INTEGER AS days_behind FROM fx_daily GROUP BY metric HAVING datediff('day', max(day), DATE '2001-08-03') > 3")
def report_stale(spark, sf):
    last = fx(spark, sf, "fx_daily").groupBy("metric").agg(F.max("day").alias("day"))
    return last.withColumn("days_behind", F.datediff(F.lit("2001-08-03").cast("date"), "day")).where("days_behind > 3")


@query("flow_total", """
SELECT metric, sum(value) AS total, 90 - count(DISTINCT day) AS missing_days, min(id) AS first_id, max(id) AS last_id FROM fx_daily WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' GROUP BY metric""")
def flow_total(spark, sf):
    return T.flow_total(fx(spark, sf, "fx_daily"), "1998-01-01", "1998-03-31", "metric")


@query("revision_window", """
f AS (SELECT metric, day, CASE WHEN id % 3 = 0 THEN value + 1 ELSE value END AS value FROM fx_daily WHERE day >= DATE '2000-01-01'), s AS (SELECT metric, day, value AS old FROM fx_daily WHERE id % 5 <> 0)
---
SELECT metric, day, f.value, s.old IS NOT NULL AS replaces FROM f LEFT JOIN s USING (metric, day) WHERE f.value IS DISTINCT FROM s.old""")
def revision_window(spark, sf):
    d = fx(spark, sf, "fx_daily")
    fresh = d.where("day >= date'2000-01-01'").select("metric", "day", F.expr("if(id % 3 = 0, value + 1, value)").alias("value"))
    return T.revisions(d.where("id % 5 <> 0"), fresh, ["metric", "day"])


@query("validate_reading", """
SELECT id, CASE WHEN metric_key = 'level.0' AND NOT (value BETWEEN 0 AND 1) THEN 'a ratio lies between 0 and 1' WHEN metric_key = 'level.1' AND NOT value > 50 THEN 'a level is positive' END AS reason FROM fx_readings""")
def validate_reading(spark, sf):
    from ..functions.values import reading_fault

    rows = fx(spark, sf, "fx_readings").withColumn("x", F.when(F.col("metric_key") == "level.1", F.col("value") - 50).otherwise(F.col("value")))
    kind = F.when(F.col("metric_key") == "level.0", "ratio").when(F.col("metric_key") == "level.1", "level").otherwise("flow")
    return rows.select("id", reading_fault(kind, F.col("x")).alias("reason"))
