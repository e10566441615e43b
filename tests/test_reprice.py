"""Repricing: worked examples, second runs, conflicts, intervals against plain days."""

import random

import pytest

from quillspark.operators import reprice as R
from quillspark.streaming.flows import saved

OBS = """id long, asset_id string, metric_key string, day date, observed_hour long, period_days double, value double, status string, superseded_by long, method string, source_type string,
adapter string, token_ref string, amount double, hourly_amounts array<double>, marked boolean"""
FIRST = 480_000  # an hour that begins a day


def day(spark, n):
    import datetime

    return datetime.date(1970, 1, 1) + datetime.timedelta(days=FIRST // 24 + n)


def flow(spark, i, n, value, hours, metric="flow_usd.burn", **more):
    row = {"id": i, "asset_id": "rpx", "metric_key": metric, "day": day(spark, n), "observed_hour": FIRST + n * 24 + 24, "period_days": 1.0, "value": value, "status": "confirmed", "superseded_by": None, "method": "measured",
           "source_type": "log_scan", "adapter": None, "token_ref": "t", "amount": float(sum(hours.values())) if hours is not None else None, "hourly_amounts": None if hours is None else [float(hours.get(h, 0)) for h in range(24)], "marked": False}
    return tuple({**row, **more}.values())


def stored(spark, i, n, metric, value):
    return flow(spark, i, n, value, None, metric, method="derived", source_type="derived", token_ref=None)


def tables(spark, rows, hours):
    """Price 2 + the hour of the day at each of these hours."""
    prices = spark.createDataFrame([(r, FIRST + h, 2.0 + h % 24, "chain:a", 1) for h in hours for r in ("t", "new")], "token_ref string, hour long, price double, source string, fetched_at long")
    remap = spark.createDataFrame([("old", "new")], "from_ref string, to_ref string")
    supply = spark.createDataFrame([("rpx", "flow_usd.fall", FIRST + 24, "mint")], "asset_id string, metric_key string, first_hour long, mint_ref string")
    derived = [("rpx", "index", "flow_usd.burn", 1, 3, "burn_momentum"), ("rpx", "rate", "flow_usd.burn", 1, 2, "flow_annualized"), ("rpx", "over", "index", 1, 2, "burn_momentum")]
    derived = spark.createDataFrame(derived, "asset_id string, metric_key string, input string, sign int, days int, function string")
    return spark.createDataFrame(rows, OBS), prices, remap, supply, derived


def actions(df):
    return {r.id: (r.action, r.reason) for r in df.collect()}


def test_worked_example(spark):
    rows = [flow(spark, i, i, 100.0 + i, {3: 2, 20: i}) for i in range(4)] + [stored(spark, 10 + n, n, "index", 1.0) for n in (2, 3)] + [stored(spark, 20 + n, n, "rate", 2.0) for n in (0, 1, 2, 3)] + [stored(spark, 33, 3, "over", 3.0)]
    given = tables(spark, rows, range(-6, 97))
    planned = saved(R.plan(*given), spark, "plan")
    new = {i: 2 * 5.0 + i * 22.0 for i in range(4)}
    got = {r.id: r for r in planned.collect()}
    assert {i: got[i].new_value for i in range(4)} == new and all(got[i].action == "price" and got[i].basis == "hourly" for i in range(4))
    index = {n: sum(new[n - k] for k in range(3)) / 3 for n in (2, 3)}
    assert (got[12].new_value, got[13].new_value) == (index[2], index[3])
    assert [got[20 + n].action for n in range(4)] == ["incomplete", *["recompute"] * 3] and got[23].new_value == (new[3] + new[2]) * 365 / 2
    assert got[33].new_value == (index[2] + index[3]) / 2  # over rows that are worked out again themselves
    after = saved(R.applied(given[0], planned), spark, "after")
    assert {r.id for r in after.where("marked").collect()} == {0, 1, 2, 3, 12, 13, 21, 22, 23, 33} and after.columns == given[0].columns
    again = actions(R.plan(after, *given[1:]))
    assert {a for a, _ in again.values()} == {"unchanged", "incomplete"} and again[20] == ("incomplete", None)
    late = actions(R.plan(*given, start=str(day(spark, 2))))
    assert set(late) == {2, 3, 12, 13, 22, 23, 33} and late[12] == ("recompute", None)


def test_refusals_and_classes(spark):
    fall = {"metric": "flow_usd.fall", "source_type": "contract_state", "adapter": R.SUPPLY_BURN}
    rows = [
        flow(spark, 1, 0, 9.0, {0: 10, 9: 3}), flow(spark, 2, 0, 9.0, {9: 1}, token_ref="old"), flow(spark, 3, 0, 9.0, {9: 1}, token_ref=None), flow(spark, 4, 0, 9.0, {9: 1}, period_days=7.0),
        flow(spark, 5, 0, 9.0, {9: 1}, source_type="third_party"), flow(spark, 6, 0, 9.0, {9: 1}, token_ref="usd"), flow(spark, 7, 0, 9.0, {9: 1}, source_type="first_party_api"), flow(spark, 8, 0, 9.0, {9: 1}, method="disclosed"),
        flow(spark, 9, 0, 9.0, {0: 1}, status="rejected"), flow(spark, 10, 0, 9.0, {9: 1}, superseded_by=1, source_type="third_party"),
        flow(spark, 11, 0, 9.0, None, **fall), flow(spark, 12, 1, 9.0, None, token_ref=None, **fall), flow(spark, 13, 2, 9.0, None, **fall), flow(spark, 14, 3, 9.0, {1: 4}, **fall),
        flow(spark, 15, 1, 6.0, None, "flow_tokens.fall", token_ref="old", source_type="contract_state"), flow(spark, 16, 0, 1.0, {0: 1, 1: 1, 2: 1}, metric="flow_usd.zero"),
    ]
    given = tables(spark, rows, [h for h in range(1, 96) if not 80 < h < 90])
    planned = saved(R.plan(*given), spark, "plan")
    got = {r.id: (r.action, r.reason) for r in planned.where("action <> 'remap'").collect()}
    assert got == {
        1: ("refuse", "1 of 2 hours with an amount priced"), 2: ("price", None), 3: ("refuse", "no token amounts"), 4: ("skip", "periodic"), 5: ("skip", "third_party"), 6: ("skip", "usd_native"), 7: ("skip", "not_coingecko_priced:first_party_api"),
        8: ("skip", "disclosed"), 9: ("inactive", None), 11: ("skip", "defillama_history"), 12: ("price", None), 13: ("refuse", "no amount and no twin row"), 14: ("refuse", "15 of 24 hours priced (daily mean)"),
        16: ("refuse", "2 of 3 hours with an amount priced"),
    }
    by_id = {r.id: r for r in planned.where("action <> 'refuse'").collect()}
    assert (by_id[12].new_ref, by_id[12].new_amount, by_id[12].new_value, by_id[12].basis) == ("new", 6.0, 6.0 * 13.5, "daily_mean") and by_id[2].new_ref == "new"
    assert {r.id: r.new_ref for r in planned.where("action = 'remap'").collect()} == {15: "new"}


def test_conflicts_hold_back_a_day(spark):
    given = tables(spark, [flow(spark, i, i // 2, 100.0, {3: 2}, metric=f"flow_usd.{i}") for i in range(4)], range(-6, 97))
    planned = saved(R.plan(*given), spark, "plan")
    changed = given[0].selectExpr(*(c if c != "value" else "if(id = 1, 7D, value) as value" for c in given[0].columns))
    assert [r.id for r in R.conflicts(changed, planned).collect()] == [1]
    assert {r.id: r.value for r in R.applied(changed, planned).collect()} == {0: 100.0, 1: 7.0, 2: 10.0, 3: 10.0}


def test_cycle_is_refused(spark):
    rows, prices, remap, supply, derived = tables(spark, [flow(spark, 1, 0, 1.0, {1: 1})], range(24))
    loop = spark.createDataFrame([("rpx", "a", "b", 1, 2, "burn_momentum"), ("rpx", "b", "a", 1, 2, "burn_momentum")], derived.schema)
    with pytest.raises(ValueError, match="cycle"):
        R.plan(rows, prices, remap, supply, loop)


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    rng = random.Random(seed)
    given = [(k, a, a + rng.randint(0, 4)) for k in "xy" for a in (rng.randrange(60) for _ in range(10))]
    df = spark.createDataFrame(given, "k string, first int, last int")
    got = sorted(tuple(r) for r in R.merged(df, "k").collect())
    days = {(k, d) for k, a, b in given for d in range(a, b + 1)}
    assert sorted((k, d) for k, a, b in got for d in range(a, b + 1)) == sorted(days)
    assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(got, got[1:]))
    rows = spark.range(70).selectExpr("id", "date_from_unix_date(cast(id as int)) as day", "if(id % 2 = 0, 'x', 'y') as k")
    touched = {(r.k, r.id) for r in R.covered(rows, R.merged(df, "k"), "k").where("touched").collect()}
    assert touched == {(k, d) for k, d in days if (d % 2 == 0) == (k == "x")}
