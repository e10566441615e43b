"""The full reprice of stored flows: classes and refusals, new references, derived rows over derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reprice as R
from ..streaming.flows import saved
from .base import fx, query

#: Flows of all classes with some old references and missing amounts, their token twins, and stored derived rows.
_ROWS = """
SELECT id, asset_id, metric_key, day, observed_hour, CASE WHEN id % 31 = 0 THEN CAST(7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS period_days, value, status, superseded_by,
  CASE id % 17 WHEN 1 THEN 'disclosed' WHEN 3 THEN 'derived' ELSE 'measured' END AS method,
  CASE id % 16 WHEN 2 THEN 'third_party' WHEN 4 THEN 'contract_state' WHEN 10 THEN 'contract_state' WHEN 14 THEN 'first_party_api' ELSE 'log_scan' END AS source_type,
  CASE id % 16 WHEN 4 THEN 'solana.supply_burn_daily' WHEN 10 THEN 'solana.supply_burn_daily' WHEN 14 THEN 'api.book' END AS adapter,
  CASE WHEN id % 6 = 0 AND token_ref <> 'usd' THEN concat('old:', token_ref) ELSE token_ref END AS token_ref,
  CASE WHEN NOT (id % 16 IN (4, 10) AND id % 5 < 3) THEN amount END AS amount, has_hours AND id % 16 <> 4 AND id % 16 <> 10 AS has_hours, id % 10 = 0 AS marked
FROM {fx_flow_rows}
UNION ALL
SELECT id + 1000000000, asset_id, concat('flow_tokens.', substr(metric_key, 10)), day, observed_hour, CAST(1 AS DOUBLE), value / 4, 'confirmed', NULL, 'measured', 'contract_state', NULL, concat('old:', asset_id), NULL, false, false
FROM {fx_flow_rows} WHERE id % 3 <> 0
UNION ALL
SELECT min(id) + CAST(k AS BIGINT) * 1000000000, asset_id, concat(CASE k WHEN 2 THEN 'run.' WHEN 3 THEN 'net.' ELSE 'smooth.' END, asset_id), day, max(observed_hour), CAST(1 AS DOUBLE), (min(id) % 1000) / CAST(64 AS DOUBLE), 'confirmed', NULL, 'derived', 'derived', NULL, NULL, NULL, false, false
FROM {fx_flow_rows}, (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4) WHERE extract(day FROM day) <> 13 GROUP BY k, asset_id, day"""

_PLAN = """
ob AS (""" + _ROWS.replace("{fx_flow_rows}", "fx_flow_rows") + """),
a AS (SELECT *, CASE WHEN starts_with(token_ref, 'old:') THEN substr(token_ref, 5) ELSE token_ref END AS ref, superseded_by IS NULL AND status <> 'rejected' AS active, observed_hour - 24 >= 72 AS chain, id % 16 IN (4, 10) AS burn FROM ob WHERE starts_with(metric_key, 'flow_usd.')),
t AS (SELECT a.*, w.value AS twin, w.id IS NOT NULL AS has_twin FROM a LEFT JOIN ob w ON w.id = a.id + 1000000000 AND a.burn),
c AS (SELECT *, CASE WHEN token_ref = 'usd' THEN 'usd_native' WHEN source_type = 'third_party' THEN 'third_party' WHEN method <> 'measured' THEN method WHEN period_days <> 1 THEN 'periodic'
    WHEN source_type = 'first_party_api' THEN 'not_coingecko_priced:first_party_api' WHEN burn AND NOT chain AND (ref IS NULL OR amount IS NULL) THEN 'defillama_history' END AS skip,
  CASE WHEN NOT burn AND (ref IS NULL OR amount IS NULL) THEN 'no token amounts' WHEN burn AND (ref IS NULL OR amount IS NULL) AND NOT has_twin THEN 'no amount and no twin row' END AS refuse,
  CASE WHEN NOT burn OR ref IS NOT NULL AND amount IS NOT NULL THEN ref ELSE asset_id END AS new_ref, CASE WHEN burn AND (ref IS NULL OR amount IS NULL) THEN twin END AS new_amount FROM t),
cp AS (SELECT token_ref, hour, price FROM (SELECT *, row_number() OVER (PARTITION BY token_ref, hour ORDER BY fetched_at DESC, source) AS r FROM fx_prices WHERE starts_with(source, 'chain:') OR starts_with(source, 'first_party:')) WHERE r = 1),
todo AS (SELECT * FROM c WHERE active AND skip IS NULL AND refuse IS NULL),
hp AS (SELECT id, count(*) AS needed, count(p) AS priced, sum(amt * p) AS usd FROM (
  SELECT todo.id, h.amount AS amt, (SELECT price FROM cp WHERE cp.token_ref = new_ref AND cp.hour <= observed_hour - 24 + h.h AND cp.hour >= observed_hour - 24 + h.h - 6 ORDER BY cp.hour DESC LIMIT 1) AS p
  FROM todo JOIN fx_flow_hours h ON h.id = todo.id WHERE todo.has_hours AND h.amount <> 0) GROUP BY id),
dp AS (SELECT todo.id, count(price) AS n, avg(price) AS mean FROM todo LEFT JOIN cp ON cp.token_ref = new_ref AND cp.hour >= observed_hour - 24 AND cp.hour < observed_hour WHERE NOT has_hours GROUP BY todo.id),
u AS (SELECT c.*, CASE WHEN active AND skip IS NULL AND refuse IS NULL THEN CASE WHEN has_hours THEN CASE WHEN coalesce(hp.priced, 0) = coalesce(needed, 0) THEN coalesce(hp.usd, 0) END ELSE CASE WHEN n = 24 THEN coalesce(new_amount, amount) * mean END END END AS usd,
  CASE WHEN has_hours THEN concat(coalesce(hp.priced, 0), ' of ', coalesce(needed, 0), ' hours with an amount priced') ELSE concat(n, ' of 24 hours priced (daily mean)') END AS gap FROM c LEFT JOIN hp USING (id) LEFT JOIN dp USING (id)),
fl AS (SELECT *, CASE WHEN skip IS NOT NULL THEN 'skip' WHEN refuse IS NOT NULL THEN 'refuse' WHEN usd IS NULL THEN 'refuse' WHEN marked AND usd = value AND new_ref IS NOT DISTINCT FROM token_ref AND new_amount IS NULL THEN 'unchanged' ELSE 'price' END AS action FROM u WHERE active),
rd AS (SELECT asset_id, metric_key, day FROM fl WHERE action IN ('price', 'unchanged') UNION SELECT asset_id, metric_key, day FROM a WHERE active AND marked),
vals AS (SELECT asset_id, right(metric_key, 1) AS part, day, CASE WHEN action = 'price' THEN usd ELSE value END AS v FROM fl WHERE period_days = 1),
pair AS (SELECT p.asset_id, p.day, p.v AS v1, q.v AS v3 FROM vals p JOIN vals q ON q.asset_id = p.asset_id AND q.day = p.day WHERE p.part = '1' AND q.part = '3'),
pts AS (SELECT asset_id, day, CASE WHEN count(*) OVER r5 = 5 THEN sum(v1 + v3) OVER r5 * 365 / 5 END AS run, CASE WHEN count(*) OVER r3 = 3 THEN sum(v1 - v3) OVER r3 / 3 END AS net FROM pair
  WINDOW r5 AS (PARTITION BY asset_id ORDER BY day RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW), r3 AS (PARTITION BY asset_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
s1 AS (SELECT o.*, split_part(o.metric_key, '.', 1) AS kind, EXISTS (SELECT 1 FROM rd WHERE rd.asset_id = o.asset_id AND o.day - rd.day BETWEEN 0 AND CASE split_part(o.metric_key, '.', 1) WHEN 'run' THEN 4 WHEN 'net' THEN 2 ELSE 5 END) AS touched FROM ob o WHERE o.id >= 2000000000),
netv AS (SELECT s.asset_id, s.day, CASE WHEN touched AND p.net IS NOT NULL THEN p.net ELSE value END AS v FROM s1 s LEFT JOIN pts p USING (asset_id, day) WHERE kind = 'net'),
smo AS (SELECT asset_id, day, CASE WHEN count(*) OVER r4 = 4 THEN sum(v) OVER r4 / 4 END AS smooth FROM netv WINDOW r4 AS (PARTITION BY asset_id ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)),
dr AS (SELECT s.*, CASE kind WHEN 'run' THEN p.run WHEN 'net' THEN p.net ELSE m.smooth END AS point FROM s1 s LEFT JOIN pts p USING (asset_id, day) LEFT JOIN smo m USING (asset_id, day)),
pl AS (
  SELECT id, metric_key, day, action, CASE WHEN skip IS NOT NULL THEN skip WHEN refuse IS NOT NULL THEN refuse WHEN usd IS NULL THEN gap END AS reason, CASE WHEN action IN ('price', 'unchanged') THEN CASE WHEN has_hours THEN 'hourly' ELSE 'daily_mean' END END AS basis,
    value AS old_value, CASE WHEN action = 'price' THEN usd ELSE value END AS new_value, CASE WHEN action = 'price' THEN new_ref ELSE token_ref END AS new_ref, CASE WHEN action = 'price' THEN new_amount END AS new_amount FROM fl
  UNION ALL SELECT id, metric_key, day, 'inactive', NULL, NULL, value, value, token_ref, NULL FROM c WHERE NOT active AND skip IS NULL
  UNION ALL SELECT id, metric_key, day, 'remap', NULL, NULL, value, value, substr(token_ref, 5), NULL FROM ob WHERE starts_with(token_ref, 'old:') AND id NOT IN (SELECT id FROM fl WHERE action = 'price')
  UNION ALL SELECT id, metric_key, day, CASE WHEN NOT touched THEN 'untouched' WHEN point IS NULL THEN 'incomplete' WHEN point = value THEN 'unchanged' ELSE 'recompute' END, NULL, CASE WHEN touched AND point <> value THEN 'derived' END,
    value, CASE WHEN touched AND point IS NOT NULL THEN point ELSE value END, token_ref, NULL FROM dr)
---
"""


def _inputs(spark, sf):
    """Observations with hourly amounts, remap, supply starts and derived metrics."""
    rows = spark.sql(_ROWS, fx_flow_rows=saved(fx(spark, sf, "fx_flow_rows"), spark, "flow-rows"))
    hours = fx(spark, sf, "fx_flow_hours").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "amount"))).alias("m"))  # 24 at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    rows = rows.join(hours, "id", "left").withColumn("hourly_amounts", F.when(F.col("has_hours"), dense)).drop("m", "has_hours")
    rows = saved(rows, spark, "observations")
    assets = rows.select("asset_id").distinct()
    remap = assets.select(F.concat(F.lit("old:"), "asset_id").alias("from_ref"), F.col("asset_id").alias("to_ref"))
    supply = rows.select("asset_id", "metric_key").distinct().where("metric_key like 'flow_usd.%'").select("asset_id", "metric_key", F.lit(72).cast("long").alias("first_hour"), F.col("asset_id").alias("mint_ref"))
    given = spark.createDataFrame([("run", "1", 1, 5, "flow_annualized"), ("run", "3", 1, 5, "flow_annualized"), ("net", "1", 1, 3, "burn_momentum"), ("net", "3", -1, 3, "burn_momentum"), ("smooth", "net", 1, 4, "burn_momentum")], "kind string, part string, sign int, days int, function string")
    name = F.when(F.length("part") == 1, F.concat(F.lit("flow_usd."), "asset_id", F.lit("."), "part")).otherwise(F.concat("part", F.lit("."), "asset_id"))
    derived = assets.join(F.broadcast(given), F.lit(True)).select("asset_id", F.concat("kind", F.lit("."), "asset_id").alias("metric_key"), name.alias("input"), "sign", "days", "function")  # configuration, five rows
    return rows, remap, supply, derived


@query("reprice_rows", _PLAN + "SELECT id, metric_key, day, action, reason, basis, round(new_value, 6) AS new_value, new_ref, new_amount FROM pl")
def reprice_rows(spark, sf):
    """Every row of the plan, derived rows of two levels included."""
    rows, *config = _inputs(spark, sf)
    return R.plan(rows, fx(spark, sf, "fx_prices"), *config).select("id", "metric_key", "day", "action", "reason", "basis", F.round("new_value", 6).alias("new_value"), "new_ref", "new_amount")


@query("reprice_applied", _PLAN + """
SELECT o.id, round(coalesce(w.v, o.value), 6) AS value, coalesce(r.new_ref, w.new_ref, o.token_ref) AS token_ref, coalesce(w.new_amount, o.amount) AS amount, o.marked OR w.id IS NOT NULL AS marked
FROM ob o LEFT JOIN (SELECT id, new_value AS v, new_ref, new_amount FROM pl WHERE action IN ('price', 'recompute')) w USING (id) LEFT JOIN (SELECT id, new_ref FROM pl WHERE action = 'remap') r USING (id)""")
def reprice_applied(spark, sf):
    """The observations after the plan's writes."""
    rows, *config = _inputs(spark, sf)
    planned = saved(R.plan(rows, fx(spark, sf, "fx_prices"), *config), spark, "reprice-plan")
    return R.applied(rows, planned).select("id", F.round("value", 6).alias("value"), "token_ref", "amount", "marked")
