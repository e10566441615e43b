"""Numbers of chains: 256-bit words, wrapping counters, pool prices. Words wider than a long go through Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: Base-58 digits.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@F.pandas_udf(DoubleType())
def units_to_number(raw: pd.Series, decimals: pd.Series) -> pd.Series:
    """Base units as text over 10^decimals; whole part and fraction are divided apart. Null for what is no number."""

    def one(text: str | None, d: int) -> float | None:
        if text is None or not text.removeprefix("-").isdigit():
            return None
        whole, part = divmod(abs(int(text)), 10**d)
        value = float(whole) + part / 10**d
        return -value if text.startswith("-") else value

    return pd.Series([one(t, int(d)) for t, d in zip(raw, decimals)], dtype="float64").where(raw.notna(), None)


@F.pandas_udf(DoubleType())
def wrapped_difference(later: pd.Series, earlier: pd.Series, bits: pd.Series) -> pd.Series:
    """later - earlier of counters as text that wrap around at 2^bits."""
    return pd.Series([None if a is None or b is None else float((int(a) - int(b)) % (1 << int(n))) for a, b, n in zip(later, earlier, bits)], dtype="float64")


@F.pandas_udf(IntegerType())
def base58_bytes(text: pd.Series) -> pd.Series:
    """How many bytes a base-58 text stands for, null if it is none."""

    def one(t: str | None) -> int | None:
        if not t or any(c not in BASE58 for c in t):
            return None
        value = 0
        for c in t:
            value = value * 58 + BASE58.index(c)
        return (value.bit_length() + 7) // 8 + len(t) - len(t.lstrip("1"))

    return pd.Series([one(t) for t in text], dtype="Int32")


def base58(data: bytes) -> str:
    """A leading zero byte is a leading one; the rest are the digits of the number."""
    value, digits = int.from_bytes(data, "big"), ""
    while value:
        value, rest = divmod(value, 58)
        digits = BASE58[rest] + digits
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + digits


def tick_price(tick: Column, decimals_in: int, decimals_out: int) -> Column:
    """Price of a pool at a tick."""
    return F.pow(F.lit(1.0001), tick) * F.lit(float(10 ** (decimals_in - decimals_out)))


def twap_tick(later: Column, earlier: Column, seconds: Column) -> Column:
    """Mean tick between two readings of the cumulative, rounded down."""
    return F.floor((later - earlier) / seconds)


def reserve_price(quote: Column, token: Column) -> Column:
    return F.when(token > 0, quote / token)


def linear_overlap(start: Column, stop: Column, lo: Column, hi: Column, amount: Column) -> Column:
    """Part of an amount that is released evenly from start to stop which falls between lo and hi."""
    shared = F.greatest(F.lit(0), F.least(stop, hi) - F.greatest(start, lo))
    return F.when(stop > start, amount * shared / (stop - start)).otherwise(F.when((start >= lo) & (start < hi), amount).otherwise(0.0))


def stepped_rate(rate: Column, epochs: Column, numerator: int, denominator: int, most: int) -> Column:
    """A rate reduced by integer division once an epoch: up to `most` epochs, none below 0."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(epochs, F.lit(most))))
    return F.when(epochs <= 0, rate).otherwise(F.aggregate(steps, rate, lambda r, _: F.floor(r * numerator / denominator)))


def bin_price(active: Column, step: int) -> Column:
    """Price at a bin of a pool whose bins are `step` hundredths of a percent apart."""
    return F.pow(F.lit(1 + step / 10000), active)


@F.pandas_udf(DoubleType())
def net_units(total: pd.Series, balances: pd.Series, decimals: pd.Series) -> pd.Series:
    """total less the balances (base units as text), then in whole units; null if one of them is no number."""

    def one(t: str | None, others: object, d: int) -> float | None:
        try:
            left = int(t) - sum(int(b) for b in (others if others is not None else []))
        except (TypeError, ValueError):
            return None
        whole, part = divmod(abs(left), 10**d)
        return (float(whole) + part / 10**d) * (-1 if left < 0 else 1)

    return pd.Series([one(*x) for x in zip(total, balances, decimals.astype(int))], dtype="float64")
