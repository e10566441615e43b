"""Prices that aren't read at a block: candles of venues, swaps of pools found by going back through a pool's transactions,
and the accounts of pairs as bytes."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.chain import base58

#: Hours that a swap may be old, transactions that are read for a price, least dollars of a swap that checks one.
SWAP_HOURS, MOST_READS, LEAST_SWAP = 6, 8, 10.0
#: Where a pair's account has its two mints and its two reserves, 32 bytes each, and its least length.
MINT_X, MINT_Y, RESERVE_X, RESERVE_Y, PAIR_BYTES = 88, 120, 152, 184, 216


def candle_closes(replies: DataFrame, *key: str) -> DataFrame:
    """key, hour (since 1970), close of candle lists (reply: JSON, a list of candles or an object with it as c or
    candlesticks; a candle has t or timestamp, in seconds or milliseconds, and c or close, number or text). Candles that don't
    begin an hour, or without a positive close, are none; of an hour given twice the last one counts."""
    candle = "array<struct<t:string,timestamp:string,c:string,close:string>>"
    bare, held = F.from_json("reply", candle), F.from_json("reply", f"struct<c:{candle},candlesticks:{candle}>")
    rows = replies.select(*key, F.posexplode(F.when(F.ltrim("reply").startswith("["), bare).otherwise(F.coalesce(held["c"], held["candlesticks"]))).alias("place", "x"))
    at, close = F.coalesce("x.t", "x.timestamp").try_cast("double"), F.coalesce("x.c", "x.close").try_cast("double")
    at = F.when(at < 1e12, at * 1000).otherwise(at)
    rows = rows.select(*key, "place", at.alias("at"), close.alias("close")).where("close > 0 and close < double('infinity') and at % 3600000 = 0")
    return rows.groupBy(*key, (F.col("at") / 3_600_000).cast("long").alias("hour")).agg(F.max_by("close", "place").alias("close"))


def _units(raw: int, decimals: int) -> float:
    whole, part = divmod(raw, 10**decimals)
    return whole + part / 10**decimals


@pandas_udf(DoubleType())
def vault_price(base: pd.Series, quote: pd.Series, base_decimals: pd.Series, quote_decimals: pd.Series) -> pd.Series:
    """Quote for a base, of a pool's two balances (base units as text) after a swap; null unless both are positive numbers."""

    def one(b: str | None, q: str | None, db: int, dq: int) -> float | None:
        good = b is not None and q is not None and b.isascii() and q.isascii() and b.isdigit() and q.isdigit() and int(b) > 0 and int(q) > 0
        return _units(int(q), dq) / _units(int(b), db) if good else None

    return pd.Series([one(b, q, int(db), int(dq)) for b, q, db, dq in zip(base, quote, base_decimals, quote_decimals)], dtype="float64")


@pandas_udf(StructType([StructField("price", DoubleType()), StructField("dust", BooleanType())]))
def execution_price(token: pd.Series, usd: pd.Series, token_decimals: pd.Series, usd_decimals: pd.Series) -> pd.DataFrame:
    """Of a swap's two changes of balance (base units as text): dollars for a token, and whether it is dust (under LEAST_SWAP
    dollars, no price). Changes of one direction are no swap."""

    def one(t: str | None, u: str | None, dt: int, du: int) -> tuple[float | None, bool]:
        try:
            x, y = int(t), int(u)
        except (TypeError, ValueError):
            return None, False
        if not x or not y or (x > 0) == (y > 0):
            return None, False
        leg = _units(abs(y), du)
        return (None, True) if leg < LEAST_SWAP else (leg / _units(abs(x), dt), False)

    rows = [one(t, u, int(dt), int(du)) for t, u, dt, du in zip(token, usd, token_decimals, usd_decimals)]
    return pd.DataFrame(rows, columns=["price", "dust"])


def last_swaps(transactions: DataFrame, hours: DataFrame, budget: int = MOST_READS) -> DataFrame:
    """pool, hour, price, age (seconds), reason of hours (pool, hour): by the newest transaction (pool, at in seconds, seq,
    failed, price; null: not of use) before the hour's end that has a price, at most SWAP_HOURS old. Failed ones are passed
    over unread; each other one is a read. Without a price the reason is read_budget_spent, stale_swap (only older ones
    follow) or no_swap. A transaction is spread over the hours it may price, so each hour ranks its own few."""
    ahead = transactions.where("not failed").select("pool", "at", "seq", "price", F.explode(F.expr(f"sequence(at div 3600, at div 3600 + {SWAP_HOURS - 1})")).alias("hour"))
    place = F.row_number().over(Window.partitionBy("pool", "hour").orderBy(F.desc("at"), F.desc("seq")))
    near = ahead.join(hours, ["pool", "hour"], "left_semi").withColumn("place", place).where(F.col("place") <= budget + 1)
    usable = F.col("price").isNotNull() & (F.col("place") <= budget)
    found = near.groupBy("pool", "hour").agg(F.min_by(F.struct("price", "at"), F.when(usable, F.col("place"))).alias("r"), F.max("place").alias("reads"))
    oldest = transactions.groupBy("pool").agg(F.min("at").alias("oldest"))
    end = (F.col("hour") + 1) * 3600
    rows = hours.join(found, ["pool", "hour"], "left").join(oldest, "pool", "left")
    older = F.coalesce(F.col("oldest") < end - SWAP_HOURS * 3600, F.lit(False))
    reason = F.when(F.col("r.price").isNotNull(), None).when(F.col("reads") > budget, "read_budget_spent").when(older, "stale_swap").otherwise("no_swap")
    return rows.select("pool", "hour", "r.price", (end - F.col("r.at")).alias("age"), reason.alias("reason"))


@pandas_udf(StructType([StructField(c, StringType()) for c in ("mint_x", "mint_y", "reserve_x", "reserve_y", "reason")]))
def pair_account(data: pd.Series) -> pd.DataFrame:
    """Mints and reserves (base 58) of a pair's account (base 64), or why there are none: no base64 data, too short."""

    def one(text: str | None) -> tuple:
        try:
            raw = base64.b64decode(text, validate=True)
        except (TypeError, ValueError):
            return None, None, None, None, "no base64 data"
        if len(raw) < PAIR_BYTES:
            return None, None, None, None, "too short"
        return (*(base58(raw[a : a + 32]) for a in (MINT_X, MINT_Y, RESERVE_X, RESERVE_Y)), None)

    return pd.DataFrame([one(t) for t in data], columns=["mint_x", "mint_y", "reserve_x", "reserve_y", "reason"])


def held_state(readings: DataFrame, hours: DataFrame, value: str, most: int, *by: str) -> DataFrame:
    """hours (by, hour) with the last value read at or before each, at most `most` hours old; null without one. One sweep of
    readings and hours."""
    marks = readings.select(*by, "hour", F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = marks.unionByName(hours.select(*by, "hour", F.lit(1).alias("_side")), allowMissingColumns=True)
    last: Column = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("hour").rangeBetween(-most, 0))
    return both.withColumn(value, last).where("_side = 1").select(*by, "hour", value)
