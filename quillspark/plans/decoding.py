"""Queries of price decoding, resumable price filling and token amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chain as X
from ..functions import prices as D
from ..operators import backfill as B
from ..operators import pricing as P
from ..streaming import flows as W
from .base import fx, query

#: Methods: ref, kind, quote_ref, and how readings are flavoured.
METHODS = [
    ("cl", "chainlink", None, None), ("oracle", "curve_oracle", "cl", None), ("dy", "curve_get_dy", "cl", None), ("v2", "v2_twap", "cl", "prices"), ("aero", "v2_twap", "oracle", "reserves"),
    ("v3t", "v3_twap", "cl", None), ("v3s", "v3_spot", "v2", None), ("v4", "v4_spot", "cl", None), ("band", "bound", "aero", None),
]
_K = "k AS (SELECT hour, min(event_id) % 1000 + 1 AS k FROM fx_events GROUP BY hour)"


def _words(kind: str, flavor: str | None):
    """A reading of that kind which stands for the hour's number k."""
    k = F.col("k")
    hexed = lambda x, zeros=0: F.concat(F.lit("0x"), F.hex(x.cast("long")), F.lit("0" * zeros))
    pool = [F.when(k % 11 == 0, "0x9").otherwise("0x1"), F.lit("0x2")]  # every eleventh is of another pool
    if kind == "chainlink":
        return F.array(hexed(F.when(k % 7 == 0, 0).otherwise(k * 1000000)), hexed(k))
    if kind == "curve_oracle":
        return F.array(hexed(k * 250000000000000))  # k / 4000
    if kind == "curve_get_dy":
        return F.array(hexed(k * 1000000), hexed(F.lit(40000000)))
    if flavor == "prices":  # the cumulative wraps around between the readings
        end = [hexed(k * 3600 - 1, 28), F.lit("0x0"), F.lit("0x1"), F.lit("0x1"), hexed(F.lit(7200))]
        start = [F.lit("0x" + "f" * 36 + "0" * 28), F.lit("0x0"), F.lit("0x1"), F.lit("0x1"), hexed(F.lit(3600))]
        return F.array(*pool, *end, *start)
    if flavor == "reserves":
        return F.array(*pool, hexed(F.lit(360000)), hexed(k * 360000), hexed(F.lit(7200)), F.lit("0x0"), F.lit("0x0"), hexed(F.lit(3600)))
    if kind == "v3_twap":
        return F.array(*pool, F.lit("0x0"), F.concat(F.lit("0x" + "f" * 48), F.lpad(F.hex(-k * 1800), 16, "0")))
    if kind == "v3_spot":
        return F.array(*pool, hexed(k, 24))
    if kind == "v4_spot":
        return F.array(hexed(k, 24), hexed(k % 5))
    return F.array().cast("array<string>")


def _decoded(spark, sf):
    hours = fx(spark, sf, "fx_events").groupBy("hour").agg((F.min("event_id") % 1000 + 1).alias("k"))
    out = None
    for ref, kind, quote, flavor in METHODS:  # configuration
        p = {"kind": kind, "token": "0x1", "quote": "0x2", "decimals": 6, "quote_decimals": 6, "size": 2.0, "seconds": 1800, "flavor": flavor, "start_at": 3600, "end_at": 7200}
        given = F.struct(*(F.lit(v).alias(n) for n, v in p.items())).cast(D.PARAMETERS)
        rows = hours.select(F.lit(ref).alias("ref"), "hour", F.lit(quote).cast("string").alias("quote_ref"), _words(kind, flavor).alias("words"), given.alias("p"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("d", D.decoded("words", "p")).select("ref", "hour", "quote_ref", "d.in_quote", "d.reason")


_DECODED = _K + """, m(ref, quote) AS (VALUES ('cl', NULL), ('oracle', 'cl'), ('dy', 'cl'), ('v2', 'cl'), ('aero', 'oracle'), ('v3t', 'cl'), ('v3s', 'v2'), ('v4', 'cl'), ('band', 'aero')),
d AS (SELECT ref, quote, hour, CASE WHEN ref IN ('v2', 'aero', 'v3t', 'v3s') AND k % 11 = 0 THEN 'bad_read' WHEN ref = 'cl' AND k % 7 = 0 THEN 'not_positive' WHEN ref = 'v4' AND k % 5 = 0 THEN 'zero_liquidity' END AS reason,
  CASE WHEN ref IN ('v2', 'aero', 'v3t', 'v3s') AND k % 11 = 0 OR ref = 'cl' AND k % 7 = 0 OR ref = 'v4' AND k % 5 = 0 THEN NULL ELSE
    CASE ref WHEN 'cl' THEN k / 100.0::DOUBLE WHEN 'oracle' THEN k / 4000.0::DOUBLE WHEN 'dy' THEN k / 2.0::DOUBLE / (1 - 0.004::DOUBLE) WHEN 'v2' THEN k WHEN 'aero' THEN k WHEN 'v3t' THEN pow(1.0001::DOUBLE, -k) WHEN 'v3s' THEN k * k WHEN 'v4' THEN k * k ELSE 1 END END::DOUBLE AS in_quote FROM k, m)"""


@query("price_decode", _DECODED + " --- SELECT ref, hour, round(in_quote, 9) AS in_quote, reason FROM d")
def price_decode(spark, sf):
    """All eight kinds of readings, 256 bits wide, with the reasons of those that give no price."""
    return _decoded(spark, sf).select("ref", "hour", F.round("in_quote", 9).alias("in_quote"), "reason")


@query("price_hour_decoded", _DECODED + """ ---
SELECT d.ref, d.hour, CASE WHEN d.ref = 'v3s' THEN round(x, 2) ELSE round(x, 7) END AS price, reason FROM (SELECT d.ref, d.hour, CASE WHEN d.quote IS NULL THEN d.in_quote WHEN a.quote IS NULL THEN d.in_quote * a.in_quote WHEN b.quote IS NULL THEN d.in_quote * (a.in_quote * b.in_quote) ELSE d.in_quote * (a.in_quote * (b.in_quote * c.in_quote)) END AS x,
  CASE WHEN d.quote IS NOT NULL AND (a.in_quote IS NULL OR a.quote IS NOT NULL AND (b.in_quote IS NULL OR b.quote IS NOT NULL AND c.in_quote IS NULL)) THEN 'quote_missing' ELSE d.reason END AS reason
FROM d LEFT JOIN d a ON a.ref = d.quote AND a.hour = d.hour LEFT JOIN d b ON b.ref = a.quote AND b.hour = d.hour LEFT JOIN d c ON c.ref = b.quote AND c.hour = d.hour) d""")
def price_hour_decoded(spark, sf):
    """In quote order: each reading times its quote's price of the hour."""
    found = P.hour_prices(W.saved(_decoded(spark, sf), spark, "decoded"))
    return found.select("ref", "hour", F.when(F.col("ref") == "v3s", F.round("price", 2)).otherwise(F.round("price", 7)).alias("price"), "reason")


@query("bin_prices", "SELECT event_id, round(pow(1 + 25 / 10000.0::DOUBLE, event_id % 400 - 200), 9) AS bin, CASE WHEN v > 1 THEN round(hour / v, 9) END AS vault FROM fx_events")
def bin_prices(spark, sf):
    """Prices of a pool's active bin and of a vault's reserves."""
    e = fx(spark, sf, "fx_events")
    return e.select("event_id", F.round(X.bin_price(F.col("event_id") % 400 - 200, 25), 9).alias("bin"), F.round(F.when(F.col("v") > 1, X.reserve_price(F.col("hour").cast("double"), F.col("v"))), 9).alias("vault"))


@query("base58_sizes", "SELECT c_custkey, (c_custkey % 3 + CASE WHEN c_custkey % 58 > 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM customer WHERE c_custkey % 58 > 0 UNION ALL SELECT c_custkey, (c_custkey % 3 + 1)::INTEGER FROM customer WHERE c_custkey % 58 = 0")
def base58_sizes(spark, sf):
    """Leading ones are zero bytes; one more digit is a byte."""
    digit = F.substring(F.lit(X.BASE58), (F.col("c_custkey") % 58 + 1).cast("int"), F.lit(1))
    return fx(spark, sf, "customer").select("c_custkey", X.base58_bytes(F.concat(F.repeat(F.lit("1"), (F.col("c_custkey") % 3).cast("int")), digit)).alias("n"))


_WANTED = "w AS (SELECT token_ref, min(hour) AS valid_from FROM fx_prices GROUP BY token_ref), h AS (SELECT token_ref, unnest(generate_series(valid_from, 719)) AS hour FROM w)"


@query("missing_price_hours", _WANTED + " --- SELECT token_ref, hour FROM h WHERE NOT EXISTS (SELECT 1 FROM fx_prices p WHERE p.token_ref = h.token_ref AND p.hour = h.hour)")
def missing_price_hours(spark, sf):
    prices = fx(spark, sf, "fx_prices")
    wanted = prices.groupBy("token_ref").agg(F.min("hour").alias("valid_from"))
    return B.missing_hours(wanted, prices, 0, 720)


@query("fill_prices_resumed", _WANTED + " --- SELECT token_ref, hour, CAST(hour * 2 AS DOUBLE) AS price, 1::BIGINT AS n FROM h WHERE hour >= 600")
def fill_prices_resumed(spark, sf):
    """Runs of a budget each, newest hours first, go on from the stored table until nothing is missing; no hour is written
    twice. The last of them is only planned (dry)."""
    wanted = fx(spark, sf, "fx_prices").groupBy("token_ref").agg(F.min("hour").alias("valid_from"))
    path = W.shared_folder(spark, "prices")
    price = lambda hours: hours.withColumn("price", F.col("hour").cast("double") * 2)
    while True:
        B.fill_prices(spark, wanted, price, path, 600, 720, 400)
        if not B.fill_prices(spark, wanted, price, path, 600, 720, 400, dry=True).limit(1).count():
            break
    return spark.read.parquet(path).groupBy("token_ref", "hour", "price").agg(F.count("*").alias("n"))


_ROWS = "r AS (SELECT id, asset_id, day, metric_key AS series, CASE WHEN id % 4 <> 0 THEN amount END AS amount FROM fx_flow_rows), s AS (SELECT event_type AS asset_id, day, concat('flow_usd.', event_type, '.', CAST(part AS VARCHAR(9))) AS series, sum(amount) AS amount FROM fx_amounts WHERE hour % 168 >= 24 GROUP BY ALL), t AS (SELECT asset_id, day, metric_key AS series, value / 2 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS amount FROM fx_flow_rows WHERE id % 5 <> 0)"


@query("fill_token_amounts", _ROWS + """ ---
SELECT r.id, CASE WHEN r.amount IS NOT NULL THEN 'already' WHEN s.amount IS NULL THEN 'no scan' WHEN t.amount IS NOT NULL AND t.amount <> s.amount THEN 'refused' ELSE 'filled' END AS outcome,
  CASE WHEN r.amount IS NULL AND s.amount IS NOT NULL AND (t.amount IS NULL OR t.amount = s.amount) THEN s.amount ELSE r.amount END AS amount FROM r LEFT JOIN s USING (asset_id, day, series) LEFT JOIN t USING (asset_id, day, series)""")
def fill_token_amounts(spark, sf):
    """Amounts of stored flows from a new scan, refused where the stored twin differs."""
    flows = fx(spark, sf, "fx_flow_rows").withColumn("series", F.col("metric_key"))
    rows = flows.withColumn("amount", F.expr("if(id % 4 <> 0, amount, null)"))
    name = F.concat(F.lit("flow_usd."), "event_type", F.lit("."), F.col("part").cast("string"))
    scanned = fx(spark, sf, "fx_amounts").where("hour % 168 >= 24").groupBy(F.col("event_type").alias("asset_id"), "day", name.alias("series")).agg(F.sum("amount").alias("amount"))
    twins = flows.where("id % 5 <> 0").withColumn("amount", F.expr("value / 2 + if(id % 3 = 0, 1, 0)"))
    return B.fill_amounts(rows, scanned, twins)


@query("twin_differences", "SELECT id, round(abs(value - amount) / greatest(abs(value), abs(amount)), 9) AS rel FROM fx_flow_rows WHERE amount IS NOT NULL")
def twin_differences(spark, sf):
    return fx(spark, sf, "fx_flow_rows").where("amount is not null").select("id", F.round(B.relative_difference(F.col("value"), F.col("amount")), 9).alias("rel"))


@query("breach_once", "SELECT DISTINCT event_type AS ref, hour, user_id % 3 AS check_id FROM fx_events WHERE v > 90")
def breach_once(spark, sf):
    """A breach is raised once for each ref, hour and check, however often it is met."""
    return fx(spark, sf, "fx_events").where("v > 90").select(F.col("event_type").alias("ref"), "hour", (F.col("user_id") % 3).alias("check_id")).dropDuplicates(["ref", "hour", "check_id"])
