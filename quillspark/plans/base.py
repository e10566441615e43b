"""Registry of queries, and the inputs they run on: tables derived from the driver's parquet by SQL that Spark and the
checking engine both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Derived tables; {name} is another one or a parquet table. Values are multiples of 1/64, so that sums are exact in any
#: order. Hours are counted from the beginning of 2024, days are dates.
FIXTURES = {
    "fx_events": """
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day,
  CAST((extract(doy FROM ts) - 1) * 24 + extract(hour FROM ts) AS BIGINT) AS hour,
  floor(value * 64) / CAST(64 AS DOUBLE) AS v
FROM {events}""",
    "fx_prices": """
SELECT event_type AS token_ref, hour, CASE user_id % 6 WHEN 0 THEN 'coingecko' WHEN 2 THEN 'chain:a' ELSE 'first_party:b' END AS source,
  min(v) + 1 AS price, max(event_id) AS fetched_at
FROM {fx_events} WHERE user_id % 2 = 0
GROUP BY event_type, hour, CASE user_id % 6 WHEN 0 THEN 'coingecko' WHEN 2 THEN 'chain:a' ELSE 'first_party:b' END""",
    "fx_amounts": """
SELECT event_type, user_id % 4 AS part, day, hour, sum(v) AS amount, min(event_id) AS event_id
FROM {fx_events} WHERE user_id % 2 = 1 GROUP BY event_type, user_id % 4, day, hour""",
    "fx_flow_rows": """
SELECT min(event_id) AS id, event_type AS asset_id, concat('flow_usd.', event_type, '.', CAST(part AS VARCHAR(9))) AS metric_key,
  day, CAST(floor(min(hour) / CAST(24 AS DOUBLE)) AS BIGINT) * 24 + 24 AS observed_hour, CAST(1 AS DOUBLE) AS period_days,
  sum(amount) * 2 AS value,
  CASE WHEN min(event_id) % 11 = 0 THEN 'usd' WHEN min(event_id) % 13 = 0 THEN NULL ELSE event_type END AS token_ref,
  CASE WHEN min(event_id) % 13 = 0 THEN NULL ELSE sum(amount) END AS amount,
  min(event_id) % 7 <> 0 AND min(event_id) % 11 <> 0 AND min(event_id) % 13 <> 0 AS has_hours,
  CASE WHEN min(event_id) % 17 = 0 THEN 'rejected' WHEN min(event_id) % 5 = 0 THEN 'provisional' ELSE 'confirmed' END AS status,
  CASE WHEN min(event_id) % 19 = 0 THEN min(event_id) + 1 END AS superseded_by
FROM {fx_amounts} GROUP BY event_type, part, day""",
    "fx_flow_hours": """
SELECT r.id, CAST(a.hour - (r.observed_hour - 24) AS INTEGER) AS h, a.amount
FROM {fx_flow_rows} r JOIN {fx_amounts} a ON a.event_type = r.asset_id AND a.day = r.day
  AND concat('flow_usd.', a.event_type, '.', CAST(a.part AS VARCHAR(9))) = r.metric_key
WHERE r.has_hours""",
    "fx_readings": """
SELECT event_id AS id, event_type AS asset_id, concat('level.', CAST(user_id % 5 AS VARCHAR(9))) AS metric_key, day, hour, v AS value,
  CASE WHEN event_id % 9 = 0 THEN 'rejected' WHEN event_id % 4 = 0 THEN 'provisional' ELSE 'confirmed' END AS status,
  CASE WHEN event_id % 10 = 3 THEN event_id + 7 END AS superseded_by,
  CASE event_id % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'derived' ELSE 'disclosed' END AS method,
  CASE event_id % 4 WHEN 0 THEN 'chain' WHEN 1 THEN 'market_data' WHEN 2 THEN 'third_party' ELSE 'filing' END AS source_type
FROM {fx_events}""",
    "fx_daily": """
SELECT substr(o_orderpriority, 1, 1) AS metric, CAST(o_orderdate AS DATE) AS day, sum(floor(o_totalprice) / CAST(64 AS DOUBLE)) AS value,
  count(*) AS n, min(o_orderkey) AS id
FROM {orders} WHERE extract(doy FROM o_orderdate) % 97 <> 0 GROUP BY substr(o_orderpriority, 1, 1), CAST(o_orderdate AS DATE)
UNION ALL
SELECT CASE WHEN o_orderpriority < '4' THEN 'low' ELSE 'all' END, CAST(o_orderdate AS DATE), sum(floor(o_totalprice) / CAST(64 AS DOUBLE)), count(*), min(o_orderkey)
FROM {orders} WHERE extract(doy FROM o_orderdate) % 97 <> 0 GROUP BY CASE WHEN o_orderpriority < '4' THEN 'low' ELSE 'all' END, CAST(o_orderdate AS DATE)""",
    "fx_stmt_daily": """
SELECT event_type AS asset, concat('m', CAST(user_id % 4 AS VARCHAR(9))) AS metric, day, sum(v) AS value, count(*) AS n, min(event_id) AS id
FROM {fx_events} WHERE NOT (event_type = 'click' AND user_id % 4 = 3 AND extract(day FROM day) = 24) GROUP BY event_type, concat('m', CAST(user_id % 4 AS VARCHAR(9))), day""",
    "fx_stmt_levels": """
SELECT event_type AS asset, max(CASE WHEN user_id % 5 = 0 THEN v END) / 64 + 1 AS price, sum(v) * 4 AS total_supply,
  CASE WHEN min(event_id) % 2 = 0 THEN sum(v) END AS circulating, sum(CASE WHEN user_id % 3 = 0 THEN v END) AS staked, CASE WHEN min(event_id) % 3 = 0 THEN sum(v) / 2 END AS locked,
  sum(CASE WHEN user_id % 10 = 0 THEN v END) AS emission, count(*) / CAST(8 AS DOUBLE) AS run_rate
FROM {fx_events} GROUP BY event_type""",
    "fx_stmt_releases": """
SELECT event_type AS asset, user_id % 3 AS part, CASE WHEN min(event_id) % 11 <> 0 THEN max(v) END AS rate, user_id % 3 <> 0 AS capped, CASE WHEN min(event_id) % 3 <> 0 THEN min(v) + 8 END AS cap
FROM {fx_events} WHERE event_type <> 'view' AND (event_type <> 'click' OR user_id % 3 = 0) GROUP BY event_type, user_id % 3""",
    "fx_transfers": """
SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS transfer_id, l_returnflag AS token, l_linestatus AS sink, l_suppkey % 50 AS sender,
  CAST(l_shipdate AS DATE) AS day, CAST(l_orderkey % 24 AS INTEGER) AS hour, floor(l_extendedprice) / CAST(64 AS DOUBLE) AS amount
FROM {lineitem}""",
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table or a parquet table."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = dict.fromkeys(re.findall(r"{(\w+)}", FIXTURES[name]))
    return spark.sql(FIXTURES[name], **{x: fx(spark, sf_dir, x) for x in needs})


_CTES = ",\n".join(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', sql)})" for name, sql in FIXTURES.items())


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may use the derived tables by name and may begin with its own CTEs ("name AS (...), ...;"
    before the main SELECT, separated by "---")."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            own, _, main = sql.rpartition("---")
            ORACLES[name] = f"WITH RECURSIVE {_CTES}{',' if own else ''}\n{own}\n{main.strip()}"
        return f

    return add
