"""Queries over raw landed tables: transfers, JSON bodies, runs, watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import scan as S
from .base import fx, query

_KIND = """
tr AS (SELECT *, CASE WHEN amount = 0 THEN 'zero' WHEN sender % 7 = 0 THEN 'ignored' WHEN sender % 2 = 0 THEN 'listed' WHEN amount <= 100 THEN 'dust' ELSE 'unlisted' END AS kind FROM fx_transfers)
---
"""


def _transfers(spark, sf):
    senders = spark.range(50).withColumnRenamed("id", "sender")
    return S.classify_transfers(fx(spark, sf, "fx_transfers"), senders.where("sender % 2 = 0"), senders.where("sender % 7 = 0"), 100.0)


@query("transfer_kinds", _KIND + "SELECT token, sink, kind, count(*) AS n, sum(amount) AS amount FROM tr GROUP BY ALL")
def transfer_kinds(spark, sf):
    return _transfers(spark, sf).groupBy("token", "sink", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("transfer_day_scan", _KIND + """SELECT token, sink, day, sum(amount) AS amount, count(*) AS n, coalesce(sum(amount) FILTER (WHERE hour = 0), 0) AS h0, coalesce(sum(amount) FILTER (WHERE hour = 23), 0) AS h23 FROM tr WHERE kind = 'listed' GROUP BY ALL""")
def transfer_day_scan(spark, sf):
    days = S.transfer_days(_transfers(spark, sf).where("kind = 'listed'"), "token", "sink")
    return days.select("token", "sink", "day", "amount", "n", F.col("hourly_amounts")[0].alias("h0"), F.col("hourly_amounts")[23].alias("h23"))


@query("unlisted_senders", _KIND + """SELECT sender, count(*) AS n, sum(amount) AS amount, arg_min(transfer_id, struct_pack(d := day, t := transfer_id)) AS first_tx, arg_max(transfer_id, struct_pack(d := day, t := transfer_id)) AS last_tx, min(day) AS first_day, max(day) AS last_day FROM tr WHERE kind = 'unlisted' GROUP BY sender""")
def unlisted_senders(spark, sf):
    return S.unlisted_senders(_transfers(spark, sf))


_M = "md5(CAST(transfer_id AS VARCHAR))"


@query("tx_digest", f"""
r AS (SELECT *, row_number() OVER (PARTITION BY token, sink ORDER BY transfer_id) AS r FROM fx_transfers)
---
SELECT token, sink, count(*) AS n, {", ".join(f"sum(('0x' || substr({_M}, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS h{i}" for i in range(4))}, string_agg(CAST(transfer_id AS VARCHAR), ',' ORDER BY transfer_id) FILTER (WHERE r <= 50) AS refs FROM r GROUP BY token, sink""")
def tx_digest(spark, sf):
    return S.ref_digest(fx(spark, sf, "fx_transfers"), "transfer_id", 50, "token", "sink")


@query("defillama_share", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'BUILDING') > 0 AND sum(v) <> 0 THEN coalesce(sum(v) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) / sum(v) END AS share FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE floor(c_acctbal) END AS v FROM customer) GROUP BY c_nationkey")
def defillama_share(spark, sf):
    rows = fx(spark, sf, "customer").withColumn("v", F.expr("if(c_custkey % 9 = 0, null, cast(floor(c_acctbal) as double))"))
    return S.share_of_total(rows, F.col("c_mktsegment") == "BUILDING", "v", "c_nationkey")


@query("http_json", "SELECT event_id, 3 + 2 * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS value FROM events")
def http_json(spark, sf):
    raw = S.json_path(F.col("props"), "k").try_cast("double")
    return fx(spark, sf, "events").select("event_id", (3 + 2 * raw / 100).alias("value"))


@query("json_series", "SELECT event_type, day, sum(v) AS value FROM fx_events GROUP BY event_type, day")
def json_series(spark, sf):
    """Landed bodies [[day number, value], ...], one for each user and type, read back as a daily series."""
    rows = fx(spark, sf, "fx_events")
    bodies = rows.groupBy("event_type", "user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.concat(F.lit("["), F.unix_date("day"), F.lit(","), F.col("v"), F.lit("]"))), ","), F.lit("]")).alias("body"))
    points = bodies.select("event_type", F.explode(S.json_points(F.col("body"))).alias("p"))
    return points.groupBy("event_type", F.date_from_unix_date(F.col("p")[0].cast("int")).alias("day")).agg(F.sum(F.col("p")[1]).alias("value"))


@query("counter_rate", """
c AS (SELECT event_type AS k, hour, event_id AS id, CAST(hour AS DOUBLE) * 3 AS value FROM fx_events), a AS (SELECT k, max(hour) AS h, arg_max(value, struct_pack(h := hour, i := id)) AS v FROM c WHERE hour <= 200 GROUP BY k), b AS (SELECT k, max(hour) AS h, arg_max(value, struct_pack(h := hour, i := id)) AS v FROM c WHERE hour <= 500 GROUP BY k)
---
SELECT k, CASE WHEN b.h > a.h AND b.v >= a.v THEN (b.v - a.v) / (b.h - a.h) * 24 * 365 * (1 + CAST(0.5 AS DOUBLE)) END AS rate FROM a JOIN b USING (k)""")
def counter_rate(spark, sf):
    c = fx(spark, sf, "fx_events").select(F.col("event_type").alias("k"), "hour", F.col("event_id").alias("id"), (F.col("hour").cast("double") * 3).alias("value"))
    return S.counter_rate(c, 200, 500, 0.5, "k")


@query("view_sum", "SELECT asset_id, sum(CASE WHEN metric_key = 'level.1' THEN -value WHEN metric_key IN ('level.0', 'level.2') THEN value END) AS total FROM fx_readings WHERE metric_key IN ('level.0', 'level.1', 'level.2') GROUP BY asset_id")
def view_sum(spark, sf):
    sign = F.when(F.col("metric_key") == "level.1", -1).when(F.col("metric_key").isin("level.0", "level.2"), 1)
    return fx(spark, sf, "fx_readings").where(sign.isNotNull()).groupBy("asset_id").agg(F.sum(F.col("value") * sign).alias("total"))


@query("buys_daily", "d AS (SELECT event_type AS k, day, sum(v * 2) AS value FROM fx_events GROUP BY ALL)\n---\nSELECT k, day, value FROM d x WHERE day > (SELECT min(day) FROM d y WHERE y.k = x.k)")
def buys_daily(spark, sf):
    trades = fx(spark, sf, "fx_events").select(F.col("event_type").alias("k"), "day", F.col("v").alias("price"), F.lit(2.0).alias("size"))
    return S.buys_by_day(trades, "k")


@query("threshold_crossing", """
p AS (SELECT event_type AS k, hour AS x, sum(sum(v)) OVER (PARTITION BY event_type ORDER BY hour) AS y FROM fx_events GROUP BY event_type, hour),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY k ORDER BY x)), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) AS r FROM l WHERE y >= 5000)
---
SELECT k, round(CASE WHEN px IS NULL OR py >= 5000 THEN x ELSE px + (x - px) * (5000 - py) / (y - py) END, 6) AS "at" FROM f WHERE r = 1""")
def threshold_crossing(spark, sf):
    from pyspark.sql import Window

    p = fx(spark, sf, "fx_events").groupBy(F.col("event_type").alias("k"), F.col("hour").alias("x")).agg(F.sum("v").alias("v"))
    p = p.withColumn("y", F.sum("v").over(Window.partitionBy("k").orderBy("x")))
    return S.crossing(p, 5000.0, "k").withColumn("at", F.round("at", 6))


RUNS = "SELECT event_id AS id, user_id, CASE WHEN event_id % 5 < 2 THEN 'failed' WHEN event_id % 5 = 2 THEN 'skipped' ELSE 'ok' END AS status FROM fx_events"


def runs(spark, sf):
    return spark.sql(RUNS.replace("fx_events", "{e}"), e=fx(spark, sf, "fx_events"))


@query("failure_streak", f"""
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ({RUNS}) WHERE status <> 'skipped')
---
SELECT user_id, count(*) = 3 AND bool_and(status = 'failed') AS failing FROM r WHERE r <= 3 GROUP BY user_id""")
def failure_streak(spark, sf):
    return S.failure_streaks(runs(spark, sf), 3, "user_id")


@query("outcome_rollup", f"SELECT user_id, CASE WHEN bool_and(status <> 'failed') THEN 'ok' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS outcome FROM ({RUNS}) GROUP BY user_id")
def outcome_rollup(spark, sf):
    return S.outcomes(runs(spark, sf), "user_id")


_W = "w AS (SELECT asset_id, metric_key, id, hour, value, lag(value) OVER (PARTITION BY asset_id, metric_key ORDER BY hour, id) AS previous FROM fx_readings)\n---\n"


@query("watch_firings", _W + """
SELECT id, previous, value > 60 AND NOT coalesce(previous > 60, false) AS above, CASE WHEN previous IS NULL THEN false WHEN previous = 0 THEN value <> 0 ELSE abs(value - previous) / abs(previous) * 100 > 50 END AS moved, value < 10 OR value > 90 AS outside FROM w""")
def watch_firings(spark, sf):
    return S.watch_firings(fx(spark, sf, "fx_readings"), "asset_id", "metric_key", above=60.0, change_pct=50.0, low=10.0, high=90.0).select("id", "previous", "above", "moved", "outside")


@query("watch_transitions", _W + "SELECT id, CASE WHEN value > 70 THEN 'fired' ELSE 'cleared' END AS change FROM w WHERE (value > 70) <> coalesce(previous > 70, false)")
def watch_transitions(spark, sf):
    return S.watch_transitions(fx(spark, sf, "fx_readings"), F.col("value") > 70, "asset_id", "metric_key").select("id", "change")


@query("describe_sources", """
SELECT asset_id, metric_key, arg_max(value, struct_pack(h := hour, i := id)) AS in_force, datediff('day', max(day), DATE '2024-02-01')::INTEGER AS age_days, count(*) AS n FROM fx_readings WHERE superseded_by IS NULL AND status <> 'rejected' GROUP BY asset_id, metric_key""")
def describe_sources(spark, sf):
    rows = fx(spark, sf, "fx_readings").where("superseded_by is null and status <> 'rejected'")
    return rows.groupBy("asset_id", "metric_key").agg(F.max_by("value", F.struct("hour", "id")).alias("in_force"), F.datediff(F.lit("2024-02-01").cast("date"), F.max("day")).alias("age_days"), F.count("*").alias("n"))


@query("origin_of", "SELECT CASE WHEN method = 'disclosed' THEN 'manual' WHEN source_type = 'chain' THEN 'onchain' ELSE 'api' END AS origin, count(*) AS n, sum(value) AS total FROM fx_readings GROUP BY 1")
def origin_of(spark, sf):
    from ..functions.values import origin_of as rule

    return fx(spark, sf, "fx_readings").groupBy(rule(F.col("method"), F.col("source_type")).alias("origin")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_METRICS = "SELECT CAST(p_partkey AS BIGINT) AS metric, CASE WHEN p_partkey > 10 OR p_partkey IN (1, 4) THEN 'derived' WHEN p_partkey = 5 THEN 'third_party' WHEN p_partkey = 7 THEN NULL ELSE 'log_scan' END AS source_type FROM {part}"
_INPUTS = """SELECT CAST(p_partkey AS BIGINT) AS metric, CAST(CASE WHEN p_partkey > 10 THEN {third} WHEN p_partkey = 1 THEN 4 WHEN p_partkey = 4 THEN 1 END AS BIGINT) AS input FROM {part}
  UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST({half} AS BIGINT) FROM {part} WHERE p_partkey > 10 AND p_partkey % 6 = 0"""


@query("source_taint", f"""
m AS ({_METRICS.format(part="part")}), e AS ({_INPUTS.format(third="p_partkey // 3", half="p_partkey // 2", part="part")}),
r AS (SELECT metric FROM m WHERE source_type = 'third_party' UNION SELECT e.metric FROM e JOIN r ON e.input = r.metric)
---
SELECT metric, CASE WHEN source_type = 'derived' AND metric IN (SELECT metric FROM r) THEN 'third_party' ELSE source_type END AS rung FROM m""")
def source_taint(spark, sf):
    """The rung of every metric: a derived one that leans on a third-party one through any number of inputs is third-party
    itself; two lean on each other."""
    part = fx(spark, sf, "part")
    metrics, inputs = spark.sql(_METRICS, part=part), spark.sql(_INPUTS.format(third="p_partkey div 3", half="p_partkey div 2", part="{part}"), part=part)
    return graphs.source_rungs(spark, metrics, inputs).select("metric", "rung")


@query("source_ladder", f"""
m AS ({_METRICS.format(part="part")}), e AS ({_INPUTS.format(third="p_partkey // 3", half="p_partkey // 2", part="part")}),
r AS (SELECT metric AS origin, metric AS node FROM m UNION SELECT r.origin, e.input FROM r JOIN e ON e.metric = r.node WHERE e.input IS NOT NULL),
k AS (SELECT origin, min(CASE source_type WHEN 'third_party' THEN 0 WHEN 'derived' THEN 3 WHEN 'log_scan' THEN 7 END) AS k FROM r JOIN m ON m.metric = r.node GROUP BY origin)
---
SELECT metric, CASE k WHEN 0 THEN 'third_party' WHEN 3 THEN 'derived' WHEN 7 THEN 'log_scan' END AS weakest FROM m LEFT JOIN k ON origin = metric""")
def source_ladder(spark, sf):
    """The weakest rung that each metric leans on."""
    part = fx(spark, sf, "part")
    metrics, inputs = spark.sql(_METRICS, part=part), spark.sql(_INPUTS.format(third="p_partkey div 3", half="p_partkey div 2", part="{part}"), part=part)
    return graphs.source_rungs(spark, metrics, inputs).select("metric", "weakest")


@query("rule_violations", """
SELECT line, 'share outside (0, 1]' AS problem FROM (SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS line, l_discount * 20 AS share FROM lineitem) WHERE NOT (share > 0 AND share <= 1)
UNION ALL SELECT o_orderkey, 'no line' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 1)""")
def rule_violations(spark, sf):
    lines = fx(spark, sf, "lineitem")
    share = lines.select((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("line"), (F.col("l_discount") * 20).alias("share")).where("not (share > 0 and share <= 1)")
    alone = fx(spark, sf, "orders").join(lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return share.select("line", F.lit("share outside (0, 1]").alias("problem")).unionByName(alone.select(F.col("o_orderkey").cast("long").alias("line"), F.lit("no line").alias("problem")))


@query("query_read_only", "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus")
def query_read_only(spark, sf):
    from ..sources.readonly import read_only

    return read_only(spark, "select o_orderstatus, count(*) as n, max(o_orderkey) as last_key from {orders} group by o_orderstatus;", orders=fx(spark, sf, "orders"))


@query("snapshot_envelope", """
b AS (SELECT asset_id, concat('{"asset":"', asset_id, '","metrics":{', string_agg(concat('"', metric_key, '":', n), ',' ORDER BY metric_key), '}}') AS body FROM (SELECT asset_id, metric_key, count(*) AS n FROM fx_readings GROUP BY 1, 2) GROUP BY asset_id)
---
SELECT asset_id, body, sha256(body) AS digest FROM b""")
def snapshot_envelope(spark, sf):
    """Canonical JSON (keys in order) of each asset, with its digest."""
    counts = fx(spark, sf, "fx_readings").groupBy("asset_id", "metric_key").agg(F.count("*").alias("n"))
    metrics = counts.groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_key", "n")))).alias("metrics"))  # metrics of an asset
    body = metrics.select("asset_id", F.to_json(F.struct(F.col("asset_id").alias("asset"), "metrics")).alias("body"))
    return body.withColumn("digest", F.sha2("body", 256))
