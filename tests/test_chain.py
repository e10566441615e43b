"""Numbers of chains."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chain as X


def test_units(spark):
    rows = [("123456789012345678901234567890123456789012345678901234567890", 18), ("1500000", 6), ("-25", 1), ("0", 18), ("x", 2), (None, 3)]
    got = [r.v for r in spark.createDataFrame(rows, "raw string, d int").select(X.units_to_number("raw", "d").alias("v")).collect()]
    assert got[0] == pytest.approx(1.2345678901234568e41) and got[1:4] == [1.5, -2.5, 0.0] and got[4:] == [None, None]


def test_wrapping(spark):
    rows = [(str(3), str(2**256 - 2), 256), (str(7), str(5), 32), (None, "1", 32)]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string, n int").select(X.wrapped_difference("a", "b", "n").alias("v")).collect()]
    assert got == [5.0, 2.0, None]


def test_base58(spark):
    rows = [("1",), ("11",), ("2",), ("So11111111111111111111111111111111111111112",), ("0OIl",), ("",), (None,)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").select(X.base58_bytes("t").alias("v")).collect()]
    assert got == [1, 2, 1, 32, None, None, None]


def test_linear_overlap(spark):
    one = lambda s, e, lo, hi: spark.range(1).select(X.linear_overlap(*(F.lit(x) for x in (s, e, lo, hi)), F.lit(100.0)).alias("v")).first().v
    assert (one(0, 10, 5, 20), one(0, 10, 20, 30), one(7, 7, 5, 10), one(7, 7, 8, 10)) == (50, 0, 100, 0)


def test_stepped_rate(spark):
    got = spark.createDataFrame([(0,), (1,), (3,), (9,)], "n int").select(X.stepped_rate(F.lit(100).cast("long"), F.col("n"), 9, 10, 4).alias("v")).collect()
    assert [r.v for r in got] == [100, 90, 72, 64]


def test_scrubbed(spark):
    from quillspark.functions import text as T

    pairs = [
        ("https://user:pw@host/path?apiKey=S1&ref=2#frag", "https://host/path?ref=2"), ("https://h?password=S2&X-Api-Key=1", "https://h/"), ("https://eth.drpc.org/network/abc", "https://eth.drpc.org/"),
        ("https://eth-mainnet.g.alchemy.com/v2/abc", "https://eth-mainnet.g.alchemy.com/v2"), ("https://h/v2/secret_9", "https://h/v2"), ("https://h/v2/plainword", "https://h/v2/plainword"),
        ("https://h/abcdefghij0123456789/x", "https://h/x"), ("https://h/0x" + "a1" * 20, "https://h/0x" + "a1" * 20), ("no address?key=1", "no address?key=1"), (None, None),
    ]
    got = [r.v for r in spark.createDataFrame([(p[0],) for p in pairs], "u string").select(T.scrubbed(F.col("u")).alias("v")).collect()]
    assert got == [p[1] for p in pairs]
