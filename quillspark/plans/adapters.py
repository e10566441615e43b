"""Queries of further source adapters, of report differences and purge refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, store
from ..operators import scan as S
from ..sources import adapters as A
from ..streaming.flows import shared_folder
from .base import fx, query

_FEES = "SELECT event_type AS market, user_id % 3 AS kind, day, sum(v) AS value FROM fx_events WHERE NOT (event_type = 'click' AND user_id % 3 = 1 AND day = DATE '2024-01-09') AND NOT (event_type = 'view' AND user_id % 3 = 0 AND day >= DATE '2024-01-20') GROUP BY event_type, user_id % 3, day"


@query("exchange_fees", f"""
r AS ({_FEES}), s AS (SELECT market, kind, min(day) AS first, max(day) FILTER (WHERE day < DATE '2024-01-20') AS newest, bool_or(day = DATE '2024-01-20') AS today FROM r GROUP BY 1, 2),
k AS (SELECT market FROM s WHERE newest IS NOT NULL GROUP BY market HAVING count(*) = 3)
---
SELECT market, day, CASE WHEN count(*) = (SELECT count(*) FROM s WHERE s.market = r.market AND s.first <= r.day) THEN sum(value) END AS value FROM r WHERE day < DATE '2024-01-20' AND market IN (SELECT market FROM k)
AND NOT EXISTS (SELECT 1 FROM s WHERE s.market = r.market AND s.newest = r.day AND NOT s.today) GROUP BY market, day""")
def exchange_fees(spark, sf):
    """Fees of three kinds by day: one market misses a day of one kind, another has a kind without today's row."""
    rows = spark.sql(_FEES.replace("fx_events", "{e}"), e=fx(spark, sf, "fx_events"))
    return S.complete_days(rows, 3, "2024-01-20", "market")


@query("app_share", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 0.5 END AS share FROM customer")
def app_share(spark, sf):
    """A share that a landed script declares: none where the set is another, and none where two are declared."""
    code = """case c_custkey % 4 when 0 then 'var a=new Set(["x","fee"]),q=new Set(["fee","burn"]);function f(e){return q.has(e)?0.25:1}function g(e){return a.has(e)?0.75:1}'
      when 1 then 'q=new Set(["fee","mint"]);return q.has(e)?0.25:1' when 2 then 'q=new Set(["fee","burn"]);return q.has(e)?0.25:1;return q.has(u)?0.5:1' else 'Q$=new Set([`burn`, `fee`]);return Q$.has(t)?0.5:1' end"""
    return fx(spark, sf, "customer").select("c_custkey", S.declared_share(F.expr(code), ["fee", "burn"]).alias("share"))


@query("block_emission", "SELECT chain, CASE WHEN hi > lo THEN 0.25::DOUBLE * (365 * 86400) / ((hi - lo) * 3600 / n) END AS rate FROM (SELECT event_type AS chain, min(hour) AS lo, max(hour) AS hi, count(*) AS n FROM fx_events GROUP BY event_type)")
def block_emission(spark, sf):
    sample = fx(spark, sf, "fx_events").groupBy(F.col("event_type").alias("chain")).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.count("*").alias("n"))
    return sample.select("chain", S.yearly_emission(F.lit(0.25), (F.col("hi") - F.col("lo")) * 3600, F.col("n")).alias("rate"))


_DOC = "SELECT asset_id, metric_key, sum(value) AS v, count(*) AS n FROM fx_readings"


@query("json_report_diff", f"""
a AS ({_DOC} GROUP BY 1, 2), b AS ({_DOC} WHERE id % 50 <> 0 AND metric_key <> 'level.4' GROUP BY 1, 2),
d AS (SELECT asset_id, concat('lines[', metric_key, '].sum') AS path, a.v AS o, b.v AS n FROM a LEFT JOIN b USING (asset_id, metric_key) UNION ALL SELECT asset_id, concat('lines[', metric_key, '].n'), a.n, b.n FROM a LEFT JOIN b USING (asset_id, metric_key) UNION ALL SELECT asset_id, concat('lines[', metric_key, '].id'), 0, CASE WHEN metric_key <> 'level.4' THEN 0 END FROM a)
---
SELECT asset_id, path, CASE WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS kind, n IS NOT NULL AND path LIKE '%.sum' AND abs(n - o) <= 0.03 * abs(o) OR n IS NULL AND path LIKE '%level.4].id' AS allowed FROM d WHERE n IS NULL OR n <> o""")
def json_report_diff(spark, sf):
    """Two JSON reports of each asset, with what may differ: sums by three hundredths, and one line's id."""
    def reports(rows):
        line = F.struct(F.col("metric_key").alias("id"), F.col("v").alias("sum"), "n")
        lines = rows.groupBy("asset_id", "metric_key").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
        return lines.groupBy("asset_id").agg(F.to_json(F.struct(F.lit("report").alias("kind"), F.array_sort(F.collect_list(line)).alias("lines"))).alias("report"))  # an asset's lines

    rows = fx(spark, sf, "fx_readings")
    allowed = spark.createDataFrame([("lines[*].sum", 0.03, None), ("*level.4].id", None, None)], "glob string, rel double, abs double")
    return diff.report_differences(reports(rows), reports(rows.where("id % 50 <> 0 and metric_key <> 'level.4'")), allowed, "asset_id").select("asset_id", "path", "kind", "allowed")


@query("purge_refused", """
w AS (
  SELECT 'level.1' AS metric_key, 'configured' AS why UNION SELECT metric_key, 'open anomaly' FROM fx_readings WHERE value > 99 AND metric_key IN ('level.1', 'level.2')
  UNION SELECT b.metric_key, 'rows point into it' FROM fx_readings a JOIN fx_readings b ON a.superseded_by = b.id WHERE b.metric_key IN ('level.1', 'level.2') AND a.metric_key NOT IN ('level.1', 'level.2')
  UNION SELECT metric_key, 'not replaced' FROM fx_readings WHERE superseded_by IS NULL AND status = 'confirmed' AND metric_key IN ('level.1', 'level.2'))
---
SELECT metric_key, string_agg(why, '; ' ORDER BY why) AS refusals FROM w GROUP BY metric_key""")
def purge_refused(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    configured = spark.createDataFrame([("level.0",), ("level.1",)], "metric_key string")
    return store.purge_refusals(rows, configured, rows.where("value > 99").select("metric_key"), ["level.1", "level.2"])


@query("open_anomalies", """
e AS (SELECT user_id AS k, event_id AS t, event_type = 'purchase' AS res FROM fx_events), l AS (SELECT *, count(*) FILTER (WHERE res) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM e)
---
SELECT k AS dedupe_key, max(t) FILTER (WHERE NOT res) AS last_seen FROM l GROUP BY k, life HAVING count(*) FILTER (WHERE NOT res) > 0 AND count(*) FILTER (WHERE res) = 0""")
def open_anomalies(spark, sf):
    e = fx(spark, sf, "fx_events").select(F.col("user_id").alias("dedupe_key"), F.col("event_id").alias("at"), F.expr("if(event_type = 'purchase', 'resolve', 'raise')").alias("kind"), F.col("event_type").alias("severity"))
    return store.fold_anomalies(e).where("open").select("dedupe_key", "last_seen")


def _landed(spark, rows, reply, name, **parameters):
    """Raw files of replies, read by the adapter of that name."""
    folder = shared_folder(spark, name)
    A.land(rows, reply, folder)
    return A.table(spark, name, path=folder, **parameters)


@query("adapter_fills", """
d AS (SELECT event_type AS asset, day, sum(v * 2) AS value FROM fx_events WHERE user_id % 3 = 1 AND event_id % 2 = 0 GROUP BY ALL)
---
SELECT asset, day, value FROM d x WHERE day > (SELECT min(day) FROM d y WHERE y.asset = x.asset)""")
def adapter_fills(spark, sf):
    """Replies list the fills of a user and day; the adapter gives those of one pair and side."""
    fill = F.struct(F.col("event_id").alias("time"), F.concat(F.lit("@"), F.col("user_id") % 3).alias("coin"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"), F.col("v").cast("string").alias("px"), F.lit("2").alias("sz"))
    replies = fx(spark, sf, "fx_events").groupBy("day", F.col("event_type").alias("asset"), "user_id").agg(F.collect_list(fill).alias("fills"))  # a user's fills of a day
    return S.buys_by_day(_landed(spark, replies, F.col("fills"), "landed_fills", pair="@1"), "asset")


def _read(function, value, ok=True):
    return F.struct(F.lit(function).alias("function"), value.alias("value"), F.lit(ok).alias("ok"))


@query("adapter_counter", """
c AS (SELECT event_type AS asset, hour, event_id AS id, CAST(hour * 1000 AS DOUBLE) + 0.25 AS value FROM fx_events WHERE event_id % 11 <> 0), a AS (SELECT asset, max(hour) AS h, arg_max(value, struct_pack(h := hour, i := id)) AS v FROM c WHERE hour <= 200 GROUP BY asset), b AS (SELECT asset, max(hour) AS h, arg_max(value, struct_pack(h := hour, i := id)) AS v FROM c WHERE hour <= 500 GROUP BY asset)
---
SELECT asset, CASE WHEN b.h > a.h AND b.v >= a.v THEN (b.v - a.v) / (b.h - a.h) * 24 * 365 * (1 + CAST(0.5 AS DOUBLE)) END AS rate FROM a JOIN b USING (asset)""")
def adapter_counter(spark, sf):
    """Hexadecimal reads of a counter at blocks, some of which failed, and its rate for a year."""
    rows = fx(spark, sf, "fx_events").withColumn("asset", F.col("event_type"))
    word = F.concat(F.lit("0x"), F.lower(F.hex(F.col("hour") * 100_000 + 25)))
    reply = F.struct(F.lit("minter").alias("contract"), F.col("event_id").alias("block"), F.col("hour").alias("time"), F.array(_read("minted", word, F.col("event_id") % 11 != 0)).alias("results"))
    levels = _landed(spark, rows, reply, "landed_counter", contract="minter", function="minted", decimals="2")
    return S.counter_rate(levels.selectExpr("asset", "time as hour", "block as id", "value"), 200, 500, 0.5, "asset")


@query("adapter_views", "SELECT event_type AS asset, day, count(*) AS n, sum(v * 64 + user_id - event_id) AS total FROM fx_events WHERE event_id % 7 <> 0 GROUP BY event_type, day")
def adapter_views(spark, sf):
    """Sums of three reads of each block, of those blocks at which all three answered."""
    rows = fx(spark, sf, "fx_events").withColumn("asset", F.col("event_type"))
    word = lambda c: F.col(c).cast("long").cast("string")
    rows = rows.withColumn("w", F.col("v") * 64)
    reads = F.array(_read("held", word("w")), _read("locked", word("user_id"), F.col("event_id") % 7 != 0), _read("owed", word("event_id")))
    found = _landed(spark, rows, F.struct(F.col("event_id").alias("block"), F.col("hour").alias("time"), reads.alias("results")), "landed_views", plus="held,locked", minus="owed", decimals="0")
    return found.groupBy("asset", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
