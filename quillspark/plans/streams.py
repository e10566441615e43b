"""Queries that run a stream to its end; their SQL is the batch computation of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import flows as W
from ..streaming import stateful as S
from .base import fx, query


@query("stream_daily", """
SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(round(value * 100)) AS BIGINT) AS cents, count(*) AS n FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_daily(spark, sf):
    events = W.landed(spark, f"{sf}/events.parquet").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    days = W.run(W.closed_days(events, "1 day", "event_type"), spark, W.shared_folder(spark, "stream-daily"))
    return days.select("day", "event_type", F.col("value").alias("cents"), "n")


_HOUR = "CAST((extract(doy FROM ts) - 1) * 24 + extract(hour FROM ts) AS BIGINT)"
#: Hours from 1970 to the first hour of the derived tables.
_EPOCH = 473_352
#: Landed parts, each taken by a run of its own.
_PARTS = 3


def _runs(spark, rows, part, name, step):
    """The result of the last of _PARTS runs, each after a further part of rows (by the column that numbers them) landed."""
    folder = W.shared_folder(spark, name)
    rows = W.saved(rows.withColumn("_part", part), spark, f"{name}-rows")
    for k in range(_PARTS):
        W.land(rows.where(F.col("_part") == k).drop("_part"), folder, k)
        out = step(W.landed_parts(spark, folder, rows.drop("_part").schema), folder)
    return out


@query("stream_watch", f"""
r AS (SELECT event_id AS id, event_type AS asset_id, user_id % 5 AS part, {_HOUR} AS hour, value FROM events),
f AS (SELECT *, CASE WHEN hour < 400 THEN 'over 70' ELSE 'over 60' END AS rule, CASE WHEN hour < 400 THEN value > 70 ELSE value > 60 END AS firing FROM r),
w AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY asset_id, part, rule ORDER BY hour, id), false) AS was FROM f)
---
SELECT asset_id, part, id, rule, CASE WHEN firing THEN 'fired' ELSE 'cleared' END AS change FROM w WHERE firing <> was""")
def stream_watch(spark, sf):
    """Three runs; the rule changes within the second one's readings."""
    hours = _HOUR.replace("extract(doy FROM ts)", "dayofyear(ts)").replace("extract(hour FROM ts)", "hour(ts)")
    rows = fx(spark, sf, "events").selectExpr("event_id AS id", "event_type AS asset_id", "user_id % 5 AS part", f"{hours} AS hour", "value")
    rows = rows.selectExpr("*", "if(hour < 400, 'over 70', 'over 60') as rule", "if(hour < 400, value > 70, value > 60) as firing")
    take = lambda stream, folder: S.numbered(S.watch_changes(stream, "asset_id", "part"), spark, folder)
    return _runs(spark, rows, F.expr("case when hour < 240 then 0 when hour < 480 then 1 else 2 end"), "stream-watch", take).select("asset_id", "part", "id", "rule", "change")


_RESPONSES = """
SELECT event_type AS series, datediff(day, DATE '2024-01-01') + event_id % 9 AS response, datediff(day, DATE '2024-01-01') + event_id % 9 + 1 AS today,
  datediff(day, DATE '2024-01-01') AS day, sum(v) AS value
FROM {fx_events} WHERE event_id % 23 <> 0 GROUP BY event_type, datediff(day, DATE '2024-01-01') + event_id % 9, datediff(day, DATE '2024-01-01')"""


@query("stream_series", f"""
r AS ({_RESPONSES.replace("{fx_events}", "fx_events").replace("datediff(day, DATE '2024-01-01')", "(day - DATE '2024-01-01')")}),
c AS (SELECT series, response, max(max(day)) OVER (PARTITION BY series ORDER BY response ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cursor FROM r GROUP BY series, response),
a AS (SELECT r.*, cursor, row_number() OVER (PARTITION BY series, day ORDER BY response) AS k FROM r JOIN c USING (series, response))
---
SELECT series, day::BIGINT AS day, arg_max(value, response) AS value FROM a WHERE k = 1 OR day >= cursor + 1 - 4 GROUP BY series, day""")
def stream_series(spark, sf):
    """Responses revise days up to eight days back; revisions over four days behind the cursor aren't taken, gaps are."""
    rows = spark.sql(_RESPONSES, fx_events=fx(spark, sf, "fx_events")).selectExpr("series", *(f"cast({c} as bigint) as {c}" for c in ("response", "today", "day")), "value")
    take = lambda stream, folder: S.numbered(S.series_changes(stream, "series", revision=4, backfill=400), spark, folder)
    return S.series_now(_runs(spark, rows, F.expr("case when response < 10 then 0 when response < 20 then 1 else 2 end"), "stream-series", take), "series")


@query("stream_breaches", """
g AS (SELECT token_ref, hour, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE max(price) - min(price) END AS gap, hour % 3 = 0 AS fresh FROM fx_prices GROUP BY token_ref, hour),
a AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND NOT abs(gap) > 20 THEN 1 ELSE 0 END + CASE WHEN hour - lg > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY token_ref ORDER BY hour) AS run FROM (SELECT *, lag(hour) OVER (PARTITION BY token_ref ORDER BY hour) AS lg FROM g)),
b AS (SELECT *, row_number() OVER w AS k, max(fresh::INT) OVER w AS fr FROM a WHERE gap IS NOT NULL AND abs(gap) > 20 WINDOW w AS (PARTITION BY token_ref, run ORDER BY hour))
---
SELECT token_ref, hour FROM b WHERE k = 2 AND fr = 1""")
def stream_breaches(spark, sf):
    """Every seventh hour comes with the next part only, so that runs are joined and cut afterwards."""
    g = fx(spark, sf, "fx_prices").groupBy("token_ref", "hour").agg(F.when(F.count("*") % 5 != 0, F.max("price") - F.min("price")).alias("gap")).withColumn("fresh", F.col("hour") % 3 == 0)
    part = F.expr(f"least(2, (hour - {_EPOCH}) div 250 + if((hour - {_EPOCH}) % 7 = 3, 1, 0))")
    g = g.withColumn("hour", F.col("hour") + _EPOCH)
    take = lambda stream, folder: S.numbered(S.breach_changes(stream, 20.0, 2, "token_ref", late="700 hours"), spark, folder)
    return S.open_breaches(_runs(spark, g, part, "stream-breaches", take), "token_ref").select("token_ref", (F.col("hour") - _EPOCH).alias("hour"))


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_latest(spark, sf):
    rows = fx(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    take = lambda stream, folder: W.latest_table(stream, spark, folder, ["user_id"], "event_id")
    return _runs(spark, rows, F.expr("cast(event_id % 3 as int)"), "stream-latest", take)


@query("stream_unique", "SELECT DISTINCT user_id, event_type FROM events")
def stream_unique(spark, sf):
    """One row for each key, whatever is sent again."""
    events = W.landed(spark, f"{sf}/events.parquet").select("user_id", "event_type", "ts")
    return W.run(W.first_of_each(events, "400 days", "user_id", "event_type"), spark, W.shared_folder(spark, "stream-unique"))
