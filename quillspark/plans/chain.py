"""Queries of source adapters and hourly price computation, over landed readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chain as X
from ..operators import asof
from ..operators import offchain as O
from .base import fx, query


@query("units_to_number", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) + (o_custkey % 1000) / CAST(1000 AS DOUBLE) AS value FROM orders")
def units_to_number(spark, sf):
    raw = F.concat(F.col("o_orderkey").cast("string"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("0" * 40))
    return fx(spark, sf, "orders").select("o_orderkey", X.units_to_number(raw, F.lit(43)).alias("value"))


@query("net_supply", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) * 3 - o_custkey * 2 END AS supply, 5 + 2 * CAST(o_orderkey AS DOUBLE) AS reading FROM orders")
def net_supply(spark, sf):
    """A supply less two balances, in 18 decimals; and a contract's reading, scaled and moved."""
    raw = lambda c: F.concat(c.cast("string"), F.lit("0" * 18))
    total = F.when(F.col("o_orderkey") % 7 == 0, "0x").otherwise(raw(F.col("o_orderkey") * 3))
    net = X.net_units(total, F.array(raw(F.col("o_custkey")), raw(F.col("o_custkey"))), F.lit(18))
    return fx(spark, sf, "orders").select("o_orderkey", F.when(~F.isnan(net), net).alias("supply"), (5 + 2 * X.units_to_number(raw(F.col("o_orderkey")), F.lit(18))).alias("reading"))


@query("wrapped_counter", "SELECT event_id, CAST((hour * 7 + 5) AS DOUBLE) AS moved FROM fx_events")
def wrapped_counter(spark, sf):
    e = fx(spark, sf, "fx_events")
    early = F.lit(str(2**256 - 5))  # the counter wraps between the readings
    return e.select("event_id", X.wrapped_difference((F.col("hour") * 7).cast("string"), early, F.lit(256)).alias("moved"))


@query("pool_prices", "SELECT event_id, round(pow(1.0001::DOUBLE, (event_id % 20000) - 10000) * 1000, 6) AS spot, CASE WHEN v > 20 THEN v / (v - 20) END AS reserve, CAST(floor((v - 40) / 7) AS BIGINT) AS tick FROM fx_events")
def pool_prices(spark, sf):
    spot = X.tick_price(F.col("event_id") % 20000 - 10000, 9, 6)
    return fx(spark, sf, "fx_events").select("event_id", F.round(spot, 6).alias("spot"), X.reserve_price(F.col("v"), F.col("v") - 20).alias("reserve"), X.twap_tick(F.col("v"), F.lit(40.0), F.lit(7.0)).cast("long").alias("tick"))


@query("price_hour", """
r AS (SELECT token_ref, hour, arg_max(price, fetched_at) AS read FROM fx_prices GROUP BY token_ref, hour), m(ref, quote) AS (VALUES ('view', NULL), ('click', 'view'), ('purchase', 'click'))
---
SELECT m.ref AS token_ref, a.hour, CASE WHEN m.quote IS NULL THEN a.read WHEN q.quote IS NULL THEN a.read * b.read / 64 ELSE a.read * (b.read * c.read / 64) / 64 END AS price
FROM m JOIN r a ON a.token_ref = m.ref LEFT JOIN m q ON q.ref = m.quote LEFT JOIN r b ON b.token_ref = m.quote AND b.hour = a.hour LEFT JOIN r c ON c.token_ref = q.quote AND c.hour = a.hour
WHERE m.quote IS NULL OR b.read IS NOT NULL AND (q.quote IS NULL OR c.read IS NOT NULL)""")
def price_hour(spark, sf):
    """Readings times the price of the reference they are quoted in, which is priced first: one join for each depth."""
    reads = asof.hour_price_dedupe(fx(spark, sf, "fx_prices"))
    priced = reads.where("token_ref = 'view'")
    for ref, quote in (("click", "view"), ("purchase", "click")):  # configuration in quote order
        base = priced.where(F.col("token_ref") == quote).select("hour", F.col("price").alias("unit"))
        mine = reads.where(F.col("token_ref") == ref).join(base, "hour").select("token_ref", "hour", (F.col("price") * F.col("unit") / 64).alias("price"))
        priced = priced.select("token_ref", "hour", "price").unionByName(mine)
    return priced


@query("swap_price", """
s AS (SELECT event_type AS token_ref, hour, arg_max(v, event_id) AS price FROM fx_events WHERE v > 10 GROUP BY 1, 2)
---
SELECT e.token_ref, e.hour, (SELECT price FROM s WHERE s.token_ref = e.token_ref AND s.hour <= e.hour AND s.hour >= e.hour - 6 ORDER BY s.hour DESC LIMIT 1) AS price FROM (SELECT DISTINCT token_ref, hour FROM fx_prices) e""")
def swap_price(spark, sf):
    """The last swap above the dust floor, at most six hours old."""
    swaps = fx(spark, sf, "fx_events").where("v > 10").groupBy(F.col("event_type").alias("token_ref"), "hour").agg(F.max_by("v", "event_id").alias("price"))
    hours = fx(spark, sf, "fx_prices").select("token_ref", "hour").distinct()
    return hours.join(asof.forward_prices(swaps, 6), ["token_ref", "hour"], "left")


@query("hour_blocks", """
b AS (SELECT event_type AS chain, hour AS ts, min(event_id) AS block FROM fx_events GROUP BY 1, 2), c AS (SELECT chain, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY chain),
h AS (SELECT chain, unnest(generate_series(lo, hi + 3)) AS hour FROM c)
---
SELECT h.chain, h.hour, (SELECT ts FROM b WHERE b.chain = h.chain AND b.ts >= h.hour ORDER BY ts LIMIT 1) AS ts, (SELECT block FROM b WHERE b.chain = h.chain AND b.ts >= h.hour ORDER BY ts LIMIT 1) AS block
FROM h""")
def hour_blocks(spark, sf):
    """The first block at or after each hour of a chain, and of three hours more, by one sweep in time order."""
    e = fx(spark, sf, "fx_events").withColumnRenamed("event_type", "chain")
    blocks = e.groupBy("chain", "hour").agg(F.min("event_id").alias("block"))
    hours = blocks.groupBy("chain").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select("chain", F.explode(F.expr("sequence(lo, hi + 3)")).alias("hour"))
    both = hours.withColumn("mark", F.lit(None).cast("struct<ts:bigint,block:bigint>")).withColumn("asked", F.lit(True))
    both = both.unionByName(blocks.select("chain", "hour", F.struct(F.col("hour").alias("ts"), "block").alias("mark"), F.lit(False).alias("asked")))
    w = Window.partitionBy("chain").orderBy("hour").rangeBetween(0, Window.unboundedFollowing)
    out = both.withColumn("next", F.first("mark", ignorenulls=True).over(w)).where("asked")
    return out.select("chain", "hour", "next.ts", "next.block")


@query("unlocks_next_year", """
SELECT o_orderpriority AS grp, round(sum(CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN d >= 2000 AND d < 2365 THEN a ELSE 0 END ELSE a * greatest(0, least(d + 500, 2365) - greatest(d, 2000)) / 500 END), 4) AS unlocked
FROM (SELECT *, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d, floor(o_totalprice) AS a FROM orders) GROUP BY 1""")
def unlocks_next_year(spark, sf):
    """Linear releases over 500 days, and tranches at once, that fall into a year."""
    o = fx(spark, sf, "orders").withColumns({"d": F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")), "a": F.floor("o_totalprice").cast("double")})
    stop = F.when(F.col("o_custkey") % 4 == 0, F.col("d")).otherwise(F.col("d") + 500)
    part = X.linear_overlap(F.col("d"), stop, F.lit(2000), F.lit(2365), F.col("a"))
    return o.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.round(F.sum(part), 4).alias("unlocked"))


@query("emission_schedule", """
s(k, r) AS (SELECT 0, 1000000::BIGINT UNION ALL SELECT k + 1, CAST(floor(r * 9 / 10) AS BIGINT) FROM s WHERE k < 20)
---
SELECT p_partkey, r AS rate FROM part JOIN s ON s.k = least(p_partkey % 25, 20)""")
def emission_schedule(spark, sf):
    """A yearly rate that falls by a tenth an epoch in integer division, for as many epochs as have passed."""
    rate = X.stepped_rate(F.lit(1000000).cast("long"), (F.col("p_partkey") % 25).cast("int"), 9, 10, 20)
    return fx(spark, sf, "part").select("p_partkey", rate.alias("rate"))


@query("stake_rate", "SELECT asset, round(CAST(0.08 AS DOUBLE) * sqrt(1000 / staked), 9) AS rate FROM fx_stmt_levels WHERE staked > 0")
def stake_rate(spark, sf):
    """A reward rate that falls with the square root of the stake."""
    return fx(spark, sf, "fx_stmt_levels").where("staked > 0").select("asset", F.round(F.lit(0.08) * F.sqrt(1000 / F.col("staked")), 9).alias("rate"))


@query("reserve_payments", """
SELECT sink, datediff('day', DATE '1995-01-01', day) // 30 AS period, sum(amount) AS paid, count(DISTINCT sender) AS payers, max(day) AS last_day FROM fx_transfers WHERE token = 'A' GROUP BY 1, 2""")
def reserve_payments(spark, sf):
    """Ledger sends by 30-day period."""
    period = F.expr("datediff(day, date'1995-01-01') div 30")
    return fx(spark, sf, "fx_transfers").where("token = 'A'").groupBy("sink", period.alias("period")).agg(F.sum("amount").alias("paid"), F.count_distinct("sender").alias("payers"), F.max("day").alias("last_day"))


@query("staking_reward", """
r AS (SELECT DISTINCT token, day, sender, hour, amount FROM fx_transfers), d AS (SELECT token, day, sum(amount) AS v FROM r GROUP BY 1, 2)
---
SELECT token, max(day) AS day, arg_max(v, day) * 365 / 4096 AS rate FROM d GROUP BY token""")
def staking_reward(spark, sf):
    """The newest day's rewards, each counted once, for a year against a stake."""
    r = fx(spark, sf, "fx_transfers").select("token", "day", "sender", "hour", "amount").distinct()
    d = r.groupBy("token", "day").agg(F.sum("amount").alias("v"))
    return d.groupBy("token").agg(F.max("day").alias("day"), (F.max_by("v", "day") * 365 / 4096).alias("rate"))


@query("weighted_share", "SELECT event_type, CASE WHEN sum(v) > 0 THEN sum(v * (user_id % 4)) / sum(v) END AS share FROM fx_events GROUP BY event_type")
def weighted_share(spark, sf):
    from ..functions.values import divided

    return fx(spark, sf, "fx_events").groupBy("event_type").agg(divided(F.sum(F.col("v") * (F.col("user_id") % 4)), F.sum("v")).alias("share"))


@query("measured_days", """
d AS (SELECT asset, day, bool_and(id % 5 <> 0) AS ok, count(*) AS n FROM fx_stmt_daily GROUP BY asset, day)
---
SELECT asset, count(*) FILTER (WHERE ok AND n = 4) AS days FROM d GROUP BY asset""")
def measured_days(spark, sf):
    """Days on which every series of an asset has a measured row."""
    d = fx(spark, sf, "fx_stmt_daily").groupBy("asset", "day").agg(F.bool_and(F.col("id") % 5 != 0).alias("ok"), F.count("*").alias("n"))
    return d.groupBy("asset").agg(F.count_if(F.col("ok") & (F.col("n") == 4)).alias("days"))


@query("basis_of_line", "SELECT asset, metric, CASE WHEN count(DISTINCT n % 3) = 1 THEN CAST(min(n % 3) AS VARCHAR) ELSE 'mixed' END AS basis FROM fx_stmt_daily WHERE day > DATE '2024-01-26' GROUP BY asset, metric")
def basis_of_line(spark, sf):
    rows = fx(spark, sf, "fx_stmt_daily").where("day > date'2024-01-26'")
    return rows.groupBy("asset", "metric").agg(F.when(F.count_distinct(F.col("n") % 3) == 1, F.min(F.col("n") % 3).cast("string")).otherwise("mixed").alias("basis"))


@query("covered_days", "SELECT id, CAST(observed_hour - 1 AS BIGINT) // 24 - CAST(observed_hour - 24 * (1 + id % 3) AS BIGINT) // 24 + 1 AS n FROM fx_flow_rows WHERE observed_hour >= 72")
def covered_days(spark, sf):
    from ..operators.series import covered_days as days

    rows = fx(spark, sf, "fx_flow_rows").where("observed_hour >= 72").withColumn("period_days", F.expr("1 + id % 3"))
    return rows.select("id", F.size(days()).cast("long").alias("n"))


@query("calendar_functions", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(extract(day FROM last_day(o_orderdate)) AS INTEGER) AS month_days FROM orders""")
def calendar_functions(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return fx(spark, sf, "orders").select("o_orderkey", F.add_months(day, 1).alias("next_month"), F.date_format(day, "yyyy-MM").alias("month"), F.expr("date_sub(cast(o_orderdate as date), weekday(cast(o_orderdate as date)))").alias("week"), F.day(F.last_day(day)).alias("month_days"))


@query("retire_guard", "SELECT c_nationkey AS registry, count(*) FILTER (WHERE c_custkey % 3 = 0) AS gone, count(*) FILTER (WHERE c_custkey % 3 = 0) > 2 OR count(*) FILTER (WHERE c_custkey % 3 = 0) = count(*) AS refused FROM customer GROUP BY 1")
def retire_guard(spark, sf):
    gone = F.count_if(F.col("c_custkey") % 3 == 0)
    return fx(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("registry")).agg(gone.alias("gone"), ((gone > 2) | (gone == F.count("*"))).alias("refused"))


@query("candle_closes", """
c AS (SELECT event_type AS market, hour, arg_max(round(v + 1, 4), event_id) AS close FROM fx_events WHERE event_id % 6 <> 0 AND v > 1 GROUP BY event_type, hour)
---
SELECT market, hour + 473352 AS hour, close FROM c""")
def candle_closes(spark, sf):
    """Candle lists of two forms, in seconds and milliseconds, with closes as numbers and texts, some of them none."""
    e = fx(spark, sf, "fx_events").withColumns({"s": (F.col("hour") + 473_352) * 3600 + F.when(F.col("event_id") % 6 == 0, 1800).otherwise(0), "x": F.when(F.col("v") > 1, F.round(F.col("v") + 1, 4)).otherwise(-1.0)})
    text = F.col("event_type").isin("click", "view")
    number = F.format_string("%.4f", "x")
    candle = F.when(text, F.concat(F.lit('{"t":'), (F.col("s") * 1000).cast("string"), F.lit(',"c":"'), number, F.lit('"}'))).otherwise(F.concat(F.lit('{"timestamp":'), F.col("s").cast("string"), F.lit(',"close":'), number, F.lit("}")))
    lists = e.groupBy(F.col("event_type").alias("market"), F.expr("hour div 100").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", candle.alias("c")))), lambda x: x["c"]), ",").alias("c"))  # a reply's
    reply = F.when(F.col("market").isin("click", "view"), F.concat(F.lit("["), "c", F.lit("]"))).otherwise(F.concat(F.lit('{"candlesticks":['), "c", F.lit("]}")))
    return O.candle_closes(lists.select("market", reply.alias("reply")), "market")


@query("vault_swap_prices", """
t AS (SELECT event_type AS pool, hour * 3600 + event_id % 3600 AS ts, event_id AS seq, event_id % 5 = 0 AS failed, CASE WHEN user_id % 4 <> 0 AND event_id % 7 <> 0 THEN (event_id + 1)::DOUBLE / (floor(v * 64) + 1) END AS price FROM fx_events),
h AS (SELECT pool, unnest(range(0, 730)) AS hour FROM (SELECT DISTINCT pool FROM t)), o AS (SELECT pool, min(ts) AS oldest FROM t GROUP BY pool),
r AS (SELECT h.pool, h.hour, t.ts, t.price, row_number() OVER (PARTITION BY h.pool, h.hour ORDER BY t.ts DESC, seq DESC) AS r FROM h JOIN t ON t.pool = h.pool AND NOT failed AND t.ts < (h.hour + 1) * 3600 AND t.ts >= (h.hour - 5) * 3600),
g AS (SELECT pool, hour, arg_min(price, r) FILTER (WHERE price IS NOT NULL AND r <= 2) AS price, arg_min(ts, r) FILTER (WHERE price IS NOT NULL AND r <= 2) AS ts, max(r) AS n FROM r GROUP BY pool, hour)
---
SELECT h.pool, h.hour, round(price, 9) AS price, (h.hour + 1) * 3600 - ts AS age, CASE WHEN price IS NOT NULL THEN NULL WHEN n > 2 THEN 'read_budget_spent' WHEN oldest < (h.hour - 5) * 3600 THEN 'stale_swap' ELSE 'no_swap' END AS reason
FROM h JOIN o USING (pool) LEFT JOIN g USING (pool, hour)""")
def vault_swap_prices(spark, sf):
    """Prices of every hour from the newest usable swap, two reads an hour; hours go on behind the last swap."""
    e = fx(spark, sf, "fx_events")
    base = F.when(F.col("user_id") % 4 == 0, "0").otherwise(F.concat((F.floor(F.col("v") * 64) + 1).cast("string"), F.lit("000000000")))
    quote = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.concat((F.col("event_id") + 1).cast("string"), F.lit("000000")))
    t = e.select(F.col("event_type").alias("pool"), (F.col("hour") * 3600 + F.col("event_id") % 3600).alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("failed"), O.vault_price(base, quote, F.lit(9), F.lit(6)).alias("price"))
    hours = e.select(F.col("event_type").alias("pool")).distinct().select("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(729).cast("long"))).alias("hour"))
    return O.last_swaps(t, hours, budget=2).withColumn("price", F.round("price", 9))


def _b58(n):
    """SQL of the base-58 text of a key of 32 bytes that is the number n, of three bytes at most."""
    digit = lambda power: f"substr('{X.BASE58}', ({n} // {58**power}) % 58 + 1, 1)"
    more = " || ".join(f"CASE WHEN {n} >= {58**p} THEN {digit(p)} ELSE '' END" for p in (3, 2, 1))
    return f"repeat('1', CASE WHEN {n} < 256 THEN 31 WHEN {n} < 65536 THEN 30 ELSE 29 END) || {more} || {digit(0)}"


@query("pair_accounts", f"""
SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN {_b58("(p_partkey * 7)")} END AS mint_x, CASE WHEN p_partkey % 9 <> 0 THEN {_b58("(p_partkey * 131)")} END AS reserve_y, CASE WHEN p_partkey % 9 = 0 THEN 'too short' END AS reason FROM part""")
def pair_accounts(spark, sf):
    """Accounts of pairs as base-64 bytes, with mints and reserves as big-endian keys of 32 bytes."""
    k = F.col("p_partkey").cast("long")
    key = lambda x: F.lpad(F.hex(x), 64, "0")
    data = F.concat(F.lit("00" * O.MINT_X), key(k * 7), key(k * 11), key(k * 13), key(k * 131))
    data = F.base64(F.unhex(F.when(k % 9 == 0, F.substring(data, 1, 400)).otherwise(data)))
    return fx(spark, sf, "part").select("p_partkey", O.pair_account(F.regexp_replace(data, r"[\r\n]", "")).alias("p")).select("p_partkey", "p.mint_x", "p.reserve_y", "p.reason")
