"""Candles, swaps found by going back, accounts as bytes."""

import base64
import random

from pyspark.sql import functions as F

from quillspark.functions.chain import base58, base58_bytes
from quillspark.operators import offchain as O

H = 3_600_000


def test_candles(spark):
    replies = [
        ("a", f'[{{"t":{(470_000 + 5) * H},"c":"1.5"}},{{"t":{(470_000 + 6) * H},"c":2}},{{"t":{(470_000 + 6) * H},"c":"3"}},{{"t":{470_007 * H + 1},"c":1}},{{"t":{(470_000 + 8) * H},"c":"0"}},{{"t":{(470_000 + 9) * H},"c":"x"}},{{"t":{(470_000 + 10) * H}}}]'), ("b", f'{{"c":[{{"t":{470_005 * 3600},"c":4}}]}}'),
        ("c", f'{{"candlesticks":[{{"timestamp":{470_000 * H},"close":"7"}}]}}'), ("d", "no list"), ("e", None), ("f", "{}"), ("g", "[]"),
    ]
    got = O.candle_closes(spark.createDataFrame(replies, "market string, reply string"), "market").collect()
    assert {(r.market, r.hour, r.close) for r in got} == {("a", 470_005, 1.5), ("a", 470_006, 3.0), ("b", 470_005, 4.0), ("c", 470_000, 7.0)}


def test_last_swaps(spark):
    """Against going back transaction by transaction."""
    rng = random.Random(7)
    rows = [(p, rng.randrange(40 * 3600), i, rng.random() < 0.3, rng.choice([None, None, float(i)])) for p in "xy" for i in range(60)] + [("z", 3600 * 7, 1, True, 9.0), ("w", 7200, 1, False, 5.0)]
    hours = [(p, h) for p in "xyzwv" for h in range(50)]
    got = {(r.pool, r.hour): (r.price, r.age, r.reason) for r in O.last_swaps(spark.createDataFrame(rows, "pool string, at long, seq long, failed boolean, price double"), spark.createDataFrame(hours, "pool string, hour long"), budget=3).collect()}

    def walk(pool, hour):
        end, reads = (hour + 1) * 3600, 0
        for _, at, _, failed, price in sorted((r for r in rows if r[0] == pool and r[1] < end), key=lambda r: (-r[1], -r[2])):
            if end - at > O.SWAP_HOURS * 3600:
                return None, None, "stale_swap"
            if failed:
                continue
            if reads == 3:
                return None, None, "read_budget_spent"
            reads += 1
            if price is not None:
                return price, end - at, None
        return None, None, "no_swap"

    assert got == {k: walk(*k) for k in hours}


def test_executions(spark):
    rows = [("-1000000000", "25000000", 9, 6, (25.0, False)), ("1000000000", "-9999999", 9, 6, (None, True)), ("5", "7", 0, 0, (None, False)), ("0", "-7", 0, 0, (None, False)), (None, "-7", 0, 0, (None, False)), ("x", "-7", 0, 0, (None, False)), (str(-(10**30)), str(10**20), 18, 6, (100.0, False))]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, u string, dt int, du int")
    assert [tuple(r.p) for r in df.select("i", O.execution_price("t", "u", "dt", "du").alias("p")).orderBy("i").collect()] == [r[4] for r in rows]
    vaults = [("2000000000", "3000000", 9, 6, 1.5), ("0", "3", 0, 0, None), ("-1", "3", 0, 0, None), (None, "3", 0, 0, None)]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(vaults)], "i int, b string, q string, db int, dq int")
    assert [r.p for r in df.select("i", O.vault_price("b", "q", "db", "dq").alias("p")).orderBy("i").collect()] == [r[4] for r in vaults]


def test_accounts(spark):
    rng = random.Random(3)
    raw = bytes(88) + b"".join(bytes(k) + rng.randbytes(32 - k) for k in (0, 1, 5, 32)) + b"more"
    texts = [base64.b64encode(raw).decode(), base64.b64encode(raw[:215]).decode(), "no base64!", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", O.pair_account("t").alias("p")).orderBy("i").collect()
    assert tuple(rows[0].p) == (*(base58(raw[a : a + 32]) for a in (88, 120, 152, 184)), None) and [r.p.reason for r in rows] == [None, "too short", "no base64 data", "no base64 data"]
    assert rows[0].p.reserve_y == "1" * 32 and base58(b"\0\0Hello World!") == "112NEpo7TZRRrLZSi2U" and base58(b"") == ""
    sizes = spark.createDataFrame([(base58(raw[a : a + 32]),) for a in (88, 120, 152, 184)], "t string").select(base58_bytes("t").alias("n")).collect()
    assert [r.n for r in sizes] == [32] * 4


def test_held_state(spark):
    state = spark.createDataFrame([("p", 3, 7), ("p", 9, 8), ("q", 1, 5)], "pair string, hour long, bin int")
    hours = spark.range(12).select(F.explode(F.array(F.lit("p"), F.lit("q"))).alias("pair"), F.col("id").alias("hour"))
    got = {(r.pair, r.hour): r.bin for r in O.held_state(state, hours, "bin", 4, "pair").collect()}
    assert got == {("p", h): 8 if h >= 9 else 7 if 3 <= h <= 7 else None for h in range(12)} | {("q", h): 5 if 1 <= h <= 5 else None for h in range(12)}
