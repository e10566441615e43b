"""Decoders of on-chain price readings. A reading is a list of 256-bit words as hex text, as a node gives them; arithmetic
of that width runs in Arrow batches, in plain Python integers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Fixed values of the feeds and pools that are read.
FEED_DECIMALS, ORACLE_DECIMALS, FEE_UNIT = 8, 18, 10**10
_U256, _Q112 = 1 << 256, 1 << 112

PARAMETERS = "struct<kind:string,token:string,quote:string,decimals:int,quote_decimals:int,size:double,seconds:bigint,flavor:string,start_at:bigint,end_at:bigint>"


class _Bad(ValueError):
    """The reading isn't what the method says."""


def _side(words: list[int], p: dict) -> int:
    """Which of the pool's two tokens is priced; the other one must be the quote."""
    token, quote = int(p["token"], 16), int(p["quote"], 16)
    if words[:2] == [token, quote]:
        return 0
    if words[:2] == [quote, token]:
        return 1
    raise _Bad("the pool does not pair the token with its quote")


def _from_sqrt(root: int, side: int, p: dict) -> float:
    """From the square root of the second token's price in the first, times 2^96."""
    if not root:
        raise _Bad("the pool has no price")
    price = (root / 2**96) ** 2
    return (price if side == 0 else 1 / price) * 10.0 ** (p["decimals"] - p["quote_decimals"])


def _folded(last: list[int], at: int) -> list[int]:
    """Cumulative prices (two, the reserves, and the time they were last touched) carried on to a time."""
    c0, c1, r0, r1, touched = last
    elapsed = (at - touched) % (1 << 32)
    if not (elapsed and r0 and r1):
        return [c0, c1]
    return [(c0 + r1 * _Q112 // r0 * elapsed) % _U256, (c1 + r0 * _Q112 // r1 * elapsed) % _U256]


def _mean_price(w: list[int], p: dict) -> float:
    side = _side(w, p)
    w = w[2:]
    if p["flavor"] == "reserves":
        end, start = w[:3], w[3:6]
        took = end[2] - start[2]
        if took <= 0:
            raise _Bad("no time lies between the readings")
        means = [(e - s) / took for e, s in zip(end[:2], start[:2])]
        token, quote = means if side == 0 else means[::-1]
        if not (token > 0 and quote > 0):
            raise _Bad("mean reserves are not positive")
        return quote / 10.0 ** p["quote_decimals"] / (token / 10.0 ** p["decimals"])
    took = p["end_at"] - p["start_at"]
    if took <= 0:
        raise _Bad("no time lies between the readings")
    end, start = _folded(w[:5], p["end_at"]), _folded(w[5:10], p["start_at"])
    return (end[side] - start[side]) % _U256 / took / _Q112 * 10.0 ** (p["decimals"] - p["quote_decimals"])


def _mean_tick(w: list[int], p: dict) -> float:
    side = _side(w, p)
    before, now = (x - _U256 if x >> 255 else x for x in w[2:4])
    price = 1.0001 ** ((now - before) / p["seconds"])
    return (price if side == 0 else 1 / price) * 10.0 ** (p["decimals"] - p["quote_decimals"])


def _sorted_pool(w: list[int], p: dict) -> float:
    """A pool that keeps its tokens in the order of their addresses; it has no price without liquidity."""
    return _from_sqrt(w[0], 0 if int(p["token"], 16) < int(p["quote"], 16) else 1, p)


#: In units of the quote, by kind of method. A bound is its quote's own price.
_DECODERS = {
    "chainlink": lambda w, p: w[0] / 10.0**FEED_DECIMALS,
    "curve_oracle": lambda w, p: w[0] / 10.0**ORACLE_DECIMALS,
    "curve_get_dy": lambda w, p: w[0] / 10.0 ** p["quote_decimals"] / p["size"] / (1 - w[1] / FEE_UNIT),
    "v2_twap": _mean_price,
    "v3_twap": _mean_tick,
    "v3_spot": lambda w, p: _from_sqrt(w[2], _side(w, p), p),
    "v4_spot": _sorted_pool,
    "bound": lambda w, p: 1.0,
}


def _decode(words: list[str] | None, p: dict) -> tuple[float | None, str | None]:
    try:
        w = [int(x, 16) for x in (words if words is not None else [])]
        if p["kind"] == "v4_spot" and w[1] == 0:
            return None, "zero_liquidity"
        value = _DECODERS[p["kind"]](w, p)
    except (_Bad, ArithmeticError, IndexError, KeyError, TypeError, ValueError):
        return None, "bad_read"
    return (value, None) if math.isfinite(value) and value > 0 else (None, "not_positive")


@pandas_udf(StructType([StructField("in_quote", DoubleType()), StructField("reason", StringType())]))
def decoded(words: pd.Series, parameters: pd.DataFrame) -> pd.DataFrame:
    """Of a reading's words and its method's parameters (PARAMETERS): the price in units of the quote, or why there is none:
    bad_read, not_positive or zero_liquidity."""
    rows = [_decode(w, p) for w, p in zip(words, parameters.to_dict("records"))]
    return pd.DataFrame(rows, columns=["in_quote", "reason"])
