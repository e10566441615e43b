"""Queries of the observation store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from .base import fx, query

READING = "id, asset_id, metric_key, day, hour, value, status"
_R = [c.strip() for c in READING.split(",")]


@query("scan_active", f"SELECT {READING} FROM fx_readings WHERE superseded_by IS NULL AND status <> 'rejected' AND asset_id = 'click'")
def scan_active(spark, sf):
    return S.active(fx(spark, sf, "fx_readings")).where("asset_id = 'click'").select(*_R)


@query("scan_by_ids", f"SELECT {READING} FROM fx_readings WHERE id IN (1, 5, 17, 99, 500, -3)")
def scan_by_ids(spark, sf):
    return fx(spark, sf, "fx_readings").where(F.col("id").isin(1, 5, 17, 99, 500, -3)).select(*_R)


@query("scan_newest", f"SELECT {READING} FROM fx_readings WHERE asset_id = 'click' AND metric_key = 'level.1' ORDER BY hour DESC, id DESC LIMIT 10")
def scan_newest(spark, sf):
    return S.newest(fx(spark, sf, "fx_readings").where("asset_id = 'click' and metric_key = 'level.1'"), 10, "hour", "id").select(*_R)


@query("scan_provenance", "SELECT id, metric_key, method, source_type FROM fx_readings WHERE superseded_by IS NULL AND status <> 'rejected' AND metric_key IN ('level.0', 'level.3')")
def scan_provenance(spark, sf):
    return S.active(fx(spark, sf, "fx_readings")).where("metric_key in ('level.0', 'level.3')").select("id", "metric_key", "method", "source_type")


@query("keyset_page", f"SELECT {READING} FROM fx_readings WHERE id < 400 ORDER BY id DESC LIMIT 25")
def keyset_page(spark, sf):
    return S.page_before(fx(spark, sf, "fx_readings"), "id", 400, 25).select(*_R)


@query("optional_filters", "SELECT asset_id, count(*) AS n FROM fx_readings WHERE status = 'provisional' AND hour >= 100 GROUP BY asset_id")
def optional_filters(spark, sf):
    rows = S.optional_filters(fx(spark, sf, "fx_readings"), status="provisional", asset_id=None, since_hour=100)
    return rows.groupBy("asset_id").agg(F.count("*").alias("n"))


@query("list_prices", "SELECT hour, source, price FROM fx_prices WHERE token_ref = 'click'")
def list_prices(spark, sf):
    return fx(spark, sf, "fx_prices").where("token_ref = 'click'").select("hour", "source", "price")


@query("stored_hours", """
SELECT DISTINCT token_ref, hour FROM fx_prices p WHERE hour BETWEEN 48 AND 200
AND EXISTS (SELECT 1 FROM (VALUES ('click', 'chain:a'), ('view', 'first_party:b')) m(t, s) WHERE m.t = p.token_ref AND m.s = p.source)""")
def stored_hours(spark, sf):
    methods = spark.createDataFrame([("click", "chain:a"), ("view", "first_party:b")], "token_ref string, source string")
    prices = fx(spark, sf, "fx_prices").where("hour between 48 and 200")
    return prices.join(methods, ["token_ref", "source"], "left_semi").select("token_ref", "hour").distinct()


@query("supersede", """
SELECT a.id, a.status, CASE WHEN a.status <> 'rejected' THEN (SELECT min(b.id) FROM fx_readings b WHERE b.asset_id = a.asset_id AND b.metric_key = a.metric_key AND b.hour = a.hour AND b.id > a.id
  AND (b.status = 'confirmed' OR (a.status = 'provisional' AND b.status = 'provisional'))) END AS superseded_by
FROM fx_readings a""")
def supersede(spark, sf):
    return S.supersede(fx(spark, sf, "fx_readings").drop("superseded_by"), "asset_id", "metric_key", "hour").select("id", "status", "superseded_by")


@query("confirm", """
SELECT id, CASE WHEN id % 8 = 0 AND status = 'provisional' THEN 'confirmed' ELSE status END AS status, CASE WHEN id % 8 = 0 AND status = 'provisional' THEN 'reviewer' END AS approved_by FROM fx_readings""")
def confirm(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    chosen = rows.where("id % 8 = 0").select("id", F.lit("reviewer").alias("by"))
    out = rows.join(chosen, "id", "left").withColumn("hit", F.col("by").isNotNull() & (F.col("status") == "provisional"))
    return out.select("id", F.when(F.col("hit"), "confirmed").otherwise(F.col("status")).alias("status"), F.when(F.col("hit"), F.col("by")).alias("approved_by"))


@query("reject_overlay", "SELECT id, CASE WHEN id % 6 = 0 THEN CASE WHEN id % 12 = 0 THEN 'confirmed' ELSE 'rejected' END ELSE status END AS status FROM fx_readings")
def reject_overlay(spark, sf):
    rows = fx(spark, sf, "fx_readings").select("id", "status")
    first = rows.where("id % 6 = 0").select("id", F.lit("rejected").alias("status"), F.lit(1).alias("at"))
    second = rows.where("id % 12 = 0").select("id", F.lit("confirmed").alias("status"), F.lit(2).alias("at"))
    return S.overlay(rows, first.union(second), "id", "status", "at")


@query("fill_tokens", "SELECT id, CASE WHEN superseded_by IS NULL AND status <> 'rejected' THEN coalesce(amount, value / 2) ELSE amount END AS amount FROM fx_flow_rows")
def fill_tokens(spark, sf):
    rows = fx(spark, sf, "fx_flow_rows")
    return S.fill_missing(rows, rows.select("id", (F.col("value") / 2).alias("amount")), "id", "amount").select("id", "amount")


@query("upsert_prices", """
SELECT token_ref, hour, price FROM (SELECT *, row_number() OVER (PARTITION BY token_ref, hour ORDER BY fetched_at DESC) AS r FROM fx_prices) WHERE r = 1""")
def upsert_prices(spark, sf):
    rows = S.valid_prices(fx(spark, sf, "fx_prices")).where("refused is null")
    return S.latest_by_key(rows.select("token_ref", "hour", "price", "fetched_at"), ["token_ref", "hour"], "fetched_at").select("token_ref", "hour", "price")


@query("upsert_token", """
SELECT user_id, (SELECT event_type FROM fx_events b WHERE b.user_id = a.user_id AND b.event_id % 3 <> 0 ORDER BY event_id LIMIT 1) AS symbol, min(event_id) FILTER (WHERE event_id % 5 = 0) AS peg
FROM fx_events a GROUP BY user_id""")
def upsert_token(spark, sf):
    rows = fx(spark, sf, "fx_events").select("user_id", "event_id", F.expr("case when event_id % 3 <> 0 then event_type end").alias("symbol"), F.expr("case when event_id % 5 = 0 then event_id end").alias("peg"))
    return S.first_known(rows, "user_id", "event_id", "symbol", "peg")


@query("upsert_latest", "SELECT asset_id, metric_key, arg_max(value, struct_pack(h := hour, i := id)) AS value, max(hour) AS hour FROM fx_readings GROUP BY asset_id, metric_key")
def upsert_latest(spark, sf):
    rows = fx(spark, sf, "fx_readings").select("asset_id", "metric_key", "value", "hour", "id")
    return S.latest_by_key(rows, ["asset_id", "metric_key"], "hour", "id").drop("id")


@query("advance_cursor", "SELECT asset_id, metric_key, max(day) AS last_day FROM fx_readings GROUP BY asset_id, metric_key")
def advance_cursor(spark, sf):
    rows = fx(spark, sf, "fx_readings").select("asset_id", "metric_key", F.col("day").alias("last_day"), "id")
    return S.advance_cursor(rows.where("id % 2 = 0").drop("id"), rows.where("id % 2 = 1").drop("id"), ["asset_id", "metric_key"], "last_day")


@query("insert_if_absent", """
SELECT user_id, day, min(event_id) AS event_id FROM fx_events n WHERE event_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM fx_events o WHERE o.event_id % 2 = 0 AND o.user_id = n.user_id AND o.day = n.day) GROUP BY user_id, day""")
def insert_if_absent(spark, sf):
    rows = fx(spark, sf, "fx_events").select("user_id", "day", "event_id")
    return S.insert_if_absent(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "day"], "event_id")


@query("raise_anomaly", """
e AS (SELECT user_id AS k, event_id AS t, event_type = 'purchase' AS res, event_type AS severity FROM fx_events),
l AS (SELECT *, count(*) FILTER (WHERE res) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM e)
---
SELECT k AS dedupe_key, life, count(*) FILTER (WHERE NOT res) AS occurrences, min(t) FILTER (WHERE NOT res) AS first_seen, max(t) FILTER (WHERE NOT res) AS last_seen,
  arg_max(severity, t) FILTER (WHERE NOT res) AS severity, count(*) FILTER (WHERE res) = 0 AS open
FROM l GROUP BY k, life HAVING count(*) FILTER (WHERE NOT res) > 0""")
def raise_anomaly(spark, sf):
    e = fx(spark, sf, "fx_events").select(F.col("user_id").alias("dedupe_key"), F.col("event_id").alias("at"), F.expr("if(event_type = 'purchase', 'resolve', 'raise')").alias("kind"), F.col("event_type").alias("severity"))
    return S.fold_anomalies(e)


@query("decide_anomaly", "SELECT id, CASE WHEN id % 10 = 0 THEN 'resolved' WHEN id % 5 = 0 THEN 'ack' ELSE 'open' END AS state FROM fx_readings")
def decide_anomaly(spark, sf):
    rows = fx(spark, sf, "fx_readings").select("id", F.lit("open").alias("state"))
    events = rows.where("id % 5 = 0").select("id", F.lit("ack").alias("state"), F.lit(1).alias("at")).union(rows.where("id % 10 = 0").select("id", F.lit("resolved").alias("state"), F.lit(2).alias("at")))
    return S.overlay(rows, events, "id", "state", "at")


@query("purge_plan", """
SELECT metric_key, count(*) AS n_rows, count(superseded_by) AS n_superseded, min(day) AS first_day, max(day) AS last_day, coalesce(sum(value), 0) AS total
FROM fx_readings WHERE metric_key IN ('level.1', 'level.4') GROUP BY metric_key""")
def purge_plan(spark, sf):
    return S.purge_plan(fx(spark, sf, "fx_readings"), ["level.1", "level.4"])


@query("purge_prices", """
SELECT token_ref, count(*) AS n, min(hour) AS first_hour, max(hour) AS last_hour, (SELECT count(*) FROM fx_flow_rows f WHERE f.token_ref = p.token_ref) AS n_references FROM fx_prices p GROUP BY token_ref""")
def purge_prices(spark, sf):
    counts = fx(spark, sf, "fx_prices").groupBy("token_ref").agg(F.count("*").alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    refs = fx(spark, sf, "fx_flow_rows").groupBy("token_ref").agg(F.count("*").alias("n_references"))
    return counts.join(refs, "token_ref", "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)))


@query("dangling", "SELECT id FROM fx_readings a WHERE metric_key <> 'level.2' AND superseded_by IN (SELECT id FROM fx_readings WHERE metric_key = 'level.2')")
def dangling(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    return S.dangling(rows, rows.where("metric_key = 'level.2'")).select("id")


@query("unreplaced", """
SELECT id FROM fx_readings a WHERE source_type = 'market_data' AND superseded_by IS NULL AND status <> 'rejected' AND NOT EXISTS (
  SELECT 1 FROM fx_readings b WHERE b.asset_id = a.asset_id AND b.hour = a.hour AND b.source_type <> 'market_data' AND b.superseded_by IS NULL AND b.status <> 'rejected')""")
def unreplaced(spark, sf):
    rows = S.active(fx(spark, sf, "fx_readings"))
    return rows.where("source_type = 'market_data'").join(rows.where("source_type <> 'market_data'").select("asset_id", "hour"), ["asset_id", "hour"], "left_anti").select("id")


@query("retention_keep", """
SELECT id, event_kind FROM (SELECT event_id AS id, event_type AS event_kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM fx_events)
WHERE r <= CASE event_kind WHEN 'view' THEN 7 WHEN 'click' THEN 1 ELSE 0 END""")
def retention_keep(spark, sf):
    return S.keep_newest(fx(spark, sf, "fx_events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event_kind")), "event_kind", "id", {"view": 7, "click": 1})


@query("union_ids", "SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def union_ids(spark, sf):
    return fx(spark, sf, "customer").select(F.col("c_custkey").alias("id")).union(fx(spark, sf, "orders").select("o_custkey")).distinct()


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf):
    return fx(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(fx(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


@query("registry_diff", """
a AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 3 <> 0)
---
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'missing' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def registry_diff(spark, sf):
    s = fx(spark, sf, "supplier")
    old = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("v"))
    new = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.expr("cast(if(s_suppkey % 5 = 0, -1, s_nationkey) as bigint)").alias("v"))
    return S.diff_by_key(old, new, "id", "v")


_LINE = "md5(concat_ws('|', coalesce(CAST(id AS VARCHAR), 'null'), coalesce(status, 'null'), coalesce(CAST(superseded_by AS VARCHAR), 'null')))"


@query("table_hash", f"SELECT asset_id, count(*) AS n, " + ", ".join(f"sum(('0x' || substr({_LINE}, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS h{i}" for i in range(4)) + " FROM fx_readings GROUP BY asset_id")
def table_hash(spark, sf):
    return S.table_hash(fx(spark, sf, "fx_readings"), "asset_id", "id", "status", "superseded_by")


@query("report_diff", """
a AS (SELECT asset_id, metric_key, sum(value) AS v FROM fx_readings GROUP BY 1, 2), b AS (SELECT asset_id, metric_key, sum(value) AS v FROM fx_readings WHERE id % 50 <> 0 GROUP BY 1, 2)
---
SELECT asset_id, metric_key, a.v AS old_value, b.v AS new_value FROM a FULL JOIN b USING (asset_id, metric_key) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0.001 * abs(a.v)""")
def report_diff(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    total = lambda r, c: r.groupBy("asset_id", "metric_key").agg(F.sum("value").alias(c))
    both = total(rows, "old_value").join(total(rows.where("id % 50 <> 0"), "new_value"), ["asset_id", "metric_key"], "full")
    return both.where("old_value is null or new_value is null or abs(old_value - new_value) > 0.001D * abs(old_value)")


@query("superseded_document", "SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) IS NOT NULL AS superseded, '' AS text FROM documents")
def superseded_document(spark, sf):
    from pyspark.sql import Window

    later = F.lead("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return fx(spark, sf, "documents").select("doc_id", later.isNotNull().alias("superseded"), F.lit("").alias("text"))


@query("document_dedupe", r"""
SELECT sha256(regexp_replace(replace(replace(text, chr(65279), ''), chr(13) || chr(10), chr(10)), '\n+$', '')) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def document_dedupe(spark, sf):
    clean = F.regexp_replace(F.replace(F.replace("text", F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n+$", "")
    return fx(spark, sf, "documents").where("text is not null").groupBy(F.sha2(clean, 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("pending_duplicate", "SELECT min(id) AS id, asset_id, metric_key, value, count(*) AS n FROM fx_readings WHERE status = 'provisional' GROUP BY asset_id, metric_key, value HAVING count(*) > 1")
def pending_duplicate(spark, sf):
    rows = fx(spark, sf, "fx_readings").where("status = 'provisional'")
    return rows.groupBy("asset_id", "metric_key", "value").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")


@query("fetch_runs_top", "SELECT event_id, user_id, event_type FROM fx_events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 20")
def fetch_runs_top(spark, sf):
    return S.newest(fx(spark, sf, "fx_events").where("event_type = 'click'"), 20, "event_id").select("event_id", "user_id", "event_type")


@query("newest_day_checks", "SELECT asset_id, metric_key, day, count(*) AS n FROM fx_readings r WHERE day = (SELECT max(day) FROM fx_readings q WHERE q.asset_id = r.asset_id) GROUP BY asset_id, metric_key, day")
def newest_day_checks(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    last = rows.groupBy("asset_id").agg(F.max("day").alias("day"))
    return rows.join(last, ["asset_id", "day"]).groupBy("asset_id", "metric_key", "day").agg(F.count("*").alias("n"))
