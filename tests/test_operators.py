"""Worked examples of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import values as V
from quillspark.operators import asof, checks, pricing, scan, series, store
from quillspark.sources.readonly import read_only, single_statement

DAY = dt.date(2024, 1, 1)


def daily(spark, values, metric="m", gaps=()):
    rows = [(metric, DAY + dt.timedelta(days=i), float(v), i) for i, v in enumerate(values) if i not in gaps]
    return spark.createDataFrame(rows, "metric string, day date, value double, id long")


def by_day(df, column):
    return {(r.day - DAY).days: r[column] for r in df.collect()}


def test_growth(spark):
    g = series.growth(daily(spark, [1] * 10 + [2] * 10), 10, "metric").orderBy(F.desc("day")).first()
    assert (g.current, g.prior, g.change) == (20, 10, 1)
    assert g.annualized == pytest.approx(2**36.5 - 1)
    assert series.growth(daily(spark, [1] * 5), 10, "metric").first().note == "incomplete"
    g = series.growth(daily(spark, [0] * 4), 2, "metric").orderBy(F.desc("day")).first()
    assert (g.change, g.annualized, g.note) == (None, None, "not meaningful")


def test_momentum(spark):
    assert by_day(series.burn_momentum(daily(spark, [10, 20, 30, 40]), 3, "metric"), "mean") == {2: 20, 3: 30}
    assert by_day(series.burn_momentum(daily(spark, [10, 20, 0, 40, 50], gaps=[2]), 2, "metric"), "mean") == {1: 15, 4: 45}
    assert by_day(series.burn_momentum(daily(spark, [0, 0, 30]), 3, "metric"), "mean") == {2: 10}


def test_annualized(spark):
    assert by_day(series.flow_annualized(daily(spark, [10, 20, 30, 40]), 3, "metric"), "annualized") == {2: 7300, 3: 10950}


def test_missing_is_not_zero(spark):
    d = daily(spark, [1, 2, 3], "a").union(daily(spark, [1, 2, 3], "b", gaps=[1]))
    assert series.window_sum(d, "2024-01-03", 3, ["a"]).first().total == 6
    assert series.window_sum(d, "2024-01-03", 3, ["a", "b"]).first().total is None
    assert by_day(series.day_align(d, {"a": 1, "b": -1}), "value") == {0: 0, 2: 0}


def test_gap_pct(spark):
    row = spark.range(1).select(*(V.gap_pct(F.lit(float(a)), F.lit(float(b))).alias(f"g{i}") for i, (a, b) in enumerate([(100, 90), (0, 0), (0, 5)]))).first()
    assert [round(x, 9) for x in row] == [10, 0, 100]


def test_reducers(spark):
    one = lambda rows: spark.createDataFrame(rows, "v double").agg(V.total_or_null(F.col("v")).alias("a"), V.strict_total(F.col("v")).alias("b"), V.measured_total(F.col("v")).alias("c")).first()
    assert tuple(one([])) == (0, None, 0)
    assert tuple(one([(1.0,), (None,)])) == (None, None, 1)
    assert tuple(one([(None,)])) == (None, None, None)
    assert tuple(one([(1.0,), (2.0,)])) == (3, 3, 3)


def flow(spark, amounts=None, token="t", amount=1.0, value=7.0, ref_hour=24):
    rows = [(1, "flow_usd.x", ref_hour, 1.0, value, token, amount, amounts, "confirmed", None)]
    return spark.createDataFrame(rows, "id long, metric_key string, observed_hour long, period_days double, value double, token_ref string, amount double, hourly_amounts array<double>, status string, superseded_by long")


def prices(spark, hours, source="chain:a", fetched=1, price=None):
    return spark.createDataFrame([("t", h, source, float(price or 10 + h), fetched) for h in hours], "token_ref string, hour long, source string, price double, fetched_at long")


def hourly(**at):
    out = [0.0] * 24
    for h, v in at.items():
        out[int(h[1:])] = v
    return out


def test_flow_usd(spark):
    f = flow(spark, hourly(h3=2.0, h20=1.5))
    r = pricing.flow_usd(f, prices(spark, range(24))).first()
    assert (r.usd, r.usd_basis, r.hours_priced, r.hours_needed) == (71, "hourly", 24, 2)
    r = pricing.flow_usd(f, prices(spark, range(13))).first()
    assert (r.usd, r.usd_basis, r.hours_priced) == (7, "legacy_unpriced", 19)


def test_flow_usd_chain(spark):
    one = flow(spark, hourly(h5=10.0))
    r = pricing.flow_usd_chain(one, prices(spark, range(24), "coingecko")).first()
    assert (r.usd_basis, r.hours_priced, r.hours_needed) == ("legacy_unpriced", 0, 1)
    both = prices(spark, [5], price=7).union(prices(spark, [5], "chain:b", 2, 5))
    assert pricing.flow_usd_chain(one, both).first().usd == 50  # the newest fetched
    whole = flow(spark, None, amount=10.0)
    alternate = prices(spark, range(0, 24, 2), price=2).union(prices(spark, range(1, 24, 2), price=4))
    r = pricing.flow_usd_chain(whole, alternate).first()
    assert (r.usd, r.usd_basis) == (30, "daily_mean")
    r = pricing.flow_usd_chain(whole, alternate.where("hour > 0")).first()
    assert (r.usd, r.usd_basis, r.hours_priced) == (7, "legacy_no_hourly", 23)
    assert pricing.flow_usd_chain(flow(spark, None, "usd", 3.0), alternate).first().usd_basis == "usd_native"


def test_price_gap(spark):
    got = {r.hour: r.price for r in asof.forward_prices(prices(spark, [2, 10]).select("token_ref", "hour", "price"), 6).collect()}
    assert sorted(got) == [*range(2, 9), *range(10, 17)]


def test_supersede(spark):
    rows = [(1, "k", "provisional"), (2, "k", "provisional"), (3, "k", "confirmed"), (4, "k", "provisional"), (5, "k", "rejected")]
    got = store.supersede(spark.createDataFrame(rows, "id long, k string, status string"), "k").collect()
    assert {r.id: r.superseded_by for r in got} == {1: 2, 2: 3, 3: None, 4: None, 5: None}


def test_breach_runs(spark):
    gaps = {0: 9.0, 1: None, 2: 9.0, 3: 9.0, 5: 9.0, 6: 0.0, 7: 9.0, 8: 9.0}
    rows = spark.createDataFrame([("t", h, g, h != 8) for h, g in gaps.items()], "t string, hour long, gap double, fresh boolean")
    assert [r.hour for r in pricing.breach_runs(rows, 5.0, 2, "t").orderBy("hour").collect()] == [2, 8]
    stale = rows.withColumn("fresh", F.lit(False))
    assert pricing.breach_runs(stale, 5.0, 2, "t").count() == 0


def test_burns(spark):
    r = spark.createDataFrame([("a", 0, 0, 100.0), ("a", 1, 12, 88.0), ("a", 2, 60, 40.0)], "a string, id long, hour long, supply double")
    assert {x.day_no: x.burned for x in series.burns_by_day(r, "a").collect()} == {0: 24, 1: 24}
    rise = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 24, 2.0)], "a string, id long, hour long, supply double")
    with pytest.raises(Exception, match="supply rose"):
        series.burns_by_day(rise, "a").collect()


def test_judge(spark):
    sides = spark.createDataFrame([("a", "s", 1000.0, 1000.0), ("b", "s", 1000.0, 900.0), ("c", "s", 0.046, 0.0), ("d", "s", 2.0, 0.0), ("e", "s", None, 1.0)], "asset string, check_id string, lhs double, rhs double")
    tol = spark.createDataFrame([("s", 1.0, 1.0)], "check_id string, tolerance_pct double, tolerance_abs double")
    assert {r.asset: r.status for r in checks.judge(sides, tol).collect()} == {"a": "ok", "b": "breach", "c": "ok", "d": "breach", "e": "incomplete"}


def test_anomalies(spark):
    e = spark.createDataFrame([("k", 1, "raise", "low"), ("k", 2, "raise", "high"), ("k", 3, "resolve", "x"), ("k", 4, "raise", "low")], "dedupe_key string, at long, kind string, severity string")
    got = store.fold_anomalies(e).orderBy("life").collect()
    assert [(r.occurrences, r.severity, r.open) for r in got] == [(2, "high", False), (1, "low", True)]


def test_crossing(spark):
    p = spark.createDataFrame([("k", 0, 0.0), ("k", 10, 100.0), ("k", 20, 300.0)], "k string, x long, y double")
    assert scan.crossing(p, 200.0, "k").first().at == 15


def test_read_only(spark):
    assert read_only(spark, "select ';' as x, \"a;b\" as y;").count() == 1
    for bad in ("select 1; select 2", "drop table t", "select '\\n'", "x" * 9000, "select 1\0"):
        with pytest.raises(ValueError):
            single_statement(bad)


def test_same_multiset(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert store.same_multiset(a, a) and not store.same_multiset(a, a.distinct())


def test_dilution(spark):
    """No release: emissions alone. Several add up, a cap bounds its own, and what is declared but not known leaves nothing."""
    from quillspark.operators import statement as I

    levels = spark.createDataFrame([(a, 2.0, 1000.0, 50.0) for a in ("none", "open", "two", "capless", "rateless")], "asset string, price double, total_supply double, emission double")
    rows = [("open", 30.0, False, None), ("two", 30.0, False, None), ("two", 40.0, True, 10.0), ("capless", 30.0, True, None), ("rateless", None, False, None)]
    releases = spark.createDataFrame(rows, "asset string, rate double, capped boolean, cap double")
    got = {r.asset: (r.tokens, r.pct, r.usd) for r in I.dilution(levels, releases).collect()}
    assert got == {"none": (50, 0.05, 100), "open": (80, 0.08, 160), "two": (90, 0.09, 180), "capless": (None, None, None), "rateless": (None, None, None)}


def test_cancelling(spark):
    """By metric and weight, each as often; sums of doubles don't decide."""
    from quillspark.operators import statement as I

    columns = "asset string, section string, kind string, metric string, weight double, mix double"
    rows = [("same", "revenue", "terms", "m", 0.1, None), ("same", "revenue", "terms", "n", 0.2, None), ("same", "holders", "terms", "n", 0.2, None), ("same", "protocol", "terms", "m", 0.1, None)]
    rows += [("split", "revenue", "terms", "m", 0.3, None), ("split", "holders", "terms", "m", 0.1, None), ("split", "protocol", "terms", "m", 0.2, None)]
    rows += [("level", "revenue", "level", None, None, None), ("twice", "revenue", "terms", "m", 0.1, None), ("twice", "cost", "terms", "m", 0.1, None), ("twice", "holders", "terms", "m", 0.1, None)]
    got = {r.asset: r.cancels for r in I.cancelling(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"same": True, "split": False, "level": False, "twice": False}


def test_narrow(spark):
    from quillspark.operators import report

    rows = [("a", m, h, i, 1.0) for i, (m, h) in enumerate([("lv", 5), ("lv", 9), ("lv", 9), ("lv", 11), ("sc", 3), ("sc", 8), ("sc", 12), ("ev", 9), ("ev", 11), ("fl", 10), ("fl", -85), ("fl", -86), ("fl", 11), ("no", 1), ("un", 1)])]
    kinds = [("a", "lv", "level", None), ("a", "sc", "schedule", None), ("a", "ev", "event", None), ("a", "fl", "flow", 3), ("a", "un", "flow", None)]
    readings = spark.createDataFrame(rows, "asset_id string, metric_key string, hour long, id long, value double")
    metrics = spark.createDataFrame(kinds, "asset_id string, metric_key string, kind string, window_days int")
    assert sorted(r.id for r in report.narrow(readings, metrics, 10).collect()) == [2, 5, 6, 8, 9, 10]


def test_report_day(spark):
    from quillspark.operators import report

    daily = spark.createDataFrame([("a", "m", "2023-12-31"), ("a", "n", "2023-12-31"), ("a", "m", "2024-01-01"), ("a", "x", "2024-01-01"), ("b", "m", "2024-01-01")], "asset string, metric string, day string").selectExpr("asset", "metric", "cast(day as date) as day")
    series = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m"), ("b", "n")], "asset string, metric string")
    assert [(r.asset, str(r.day)) for r in report.report_day(daily, series).collect()] == [("a", "2023-12-31")]


def test_decoded(spark):
    """Readings of each kind, their refusals, and time that wraps around."""
    from quillspark.functions import prices as D

    base = {"kind": "", "token": "0x0a", "quote": "0x0b", "decimals": 18, "quote_decimals": 6, "size": 1.0, "seconds": 1800, "flavor": None, "start_at": 1000, "end_at": 4600}
    q96, q112 = 2**96, 2**112
    cases = [
        ("chainlink", [250000000000, 7], {}, (2500.0, None)), ("chainlink", [0, 7], {}, (None, "not_positive")), ("chainlink", [], {}, (None, "bad_read")),
        ("curve_oracle", [1500000000000000000], {}, (1.5, None)), ("curve_get_dy", [996000, 40000000], {}, (1.0, None)),
        ("v3_spot", [10, 11, q96 * 2], {"quote_decimals": 18}, (4.0, None)), ("v3_spot", [11, 10, q96 * 2], {"quote_decimals": 18}, (0.25, None)), ("v3_spot", [10, 12, q96], {}, (None, "bad_read")), ("v3_spot", [10, 11, 0], {}, (None, "bad_read")),
        ("v4_spot", [q96 * 3, 1], {"quote_decimals": 18}, (9.0, None)), ("v4_spot", [q96, 0], {}, (None, "zero_liquidity")),
        ("v3_twap", [10, 11, 0, 1800 * 1000], {"quote_decimals": 18}, (1.0001**1000, None)), ("v3_twap", [11, 10, 0, 2**256 - 1800 * 1000], {"quote_decimals": 18}, (1.0001**1000, None)),
        ("v2_twap", [10, 11, 7200, 7200 * 3, 4600, 0, 0, 1000], {"flavor": "reserves", "quote_decimals": 18}, (3.0, None)), ("v2_twap", [10, 11, 1, 1, 5, 0, 0, 5], {"flavor": "reserves"}, (None, "bad_read")),
        # touched 600 seconds before the end: the cumulative goes on at the reserves
        ("v2_twap", [10, 11, 3000 * 2 * q112 - q112, 0, 5, 10, 4000, 2**256 - q112, 0, 5, 10, 1000], {"flavor": "prices", "quote_decimals": 18}, (2.0, None)),
        ("v2_twap", [10, 11, 0, 0, 1, 1, 0, 0, 0, 1, 1, 0], {"flavor": "prices", "end_at": 1000}, (None, "bad_read")), ("bound", [], {}, (1.0, None)),
    ]
    rows = [(i, [hex(w) for w in words], {**base, "kind": kind, **more}) for i, (kind, words, more, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, words array<string>, p {D.PARAMETERS}")
    got = [tuple(r.d) for r in df.select("i", D.decoded("words", "p").alias("d")).orderBy("i").collect()]
    for (value, reason), (_, _, _, (wanted, why)) in zip(got, cases):
        assert reason == why and value == (None if wanted is None else pytest.approx(wanted, rel=1e-12))


def test_fill_prices(spark, tmp_path):
    """A budget at a time, newest first; a run that is repeated adds nothing."""
    from quillspark.operators import backfill as B

    wanted = spark.createDataFrame([("a", 0), ("b", 40)], "token_ref string, valid_from long")
    price = lambda hours: hours.withColumn("price", F.lit(1.0))
    path = f"file://{tmp_path}/prices"
    first = {(r.token_ref, r.hour) for r in B.fill_prices(spark, wanted, price, path, 24, 50, 4).collect()}
    assert first == {("a", 49), ("b", 49), ("a", 48), ("b", 48)} or not first  # the rows are missing no more once they are written
    sizes = [spark.read.parquet(path).count()]
    while B.fill_prices(spark, wanted, price, path, 24, 50, 9, dry=True).limit(1).count():
        B.fill_prices(spark, wanted, price, path, 24, 50, 9)
        sizes.append(spark.read.parquet(path).count())
    assert sizes == [4, 13, 22, 31, 36] and spark.read.parquet(path).distinct().count() == 36


def test_details(spark):
    from quillspark.functions import text as T

    details = ['{"a":1,"note":"x","day":"2024-01-01","list":["a",2,{"tx":"0x1","y":"z"}]}', '"text"', "3", "no json", None]
    got = [r.v for r in spark.createDataFrame([(i, d) for i, d in enumerate(details)], "i int, d string").select("i", T.reading_of("d").alias("v")).orderBy("i").collect()]
    assert got == ['{"a":1,"day":"2024-01-01","list":[2,{"tx":"0x1"}]}', None, "3", None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
@pytest.mark.parametrize("end", ["2024-01-01", "2024-03-11", "2024-11-04", "2024-04-07"])
def test_hours_of_real_days(spark, zone, end):
    """A day's 24 amounts meet the prices of their hours over a turn of the year and changes to and from daylight saving,
    in whatever zone the session is."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        last = dt.datetime.fromisoformat(f"{end}T00:00:00+00:00")
        prices = [("t", last - dt.timedelta(hours=30 - i), "coingecko", 10.0 + i, i) for i in range(30) if i not in (8, 9)]
        prices = spark.createDataFrame(prices, "token_ref string, ts timestamp, source string, price double, fetched_at long").withColumn("hour", V.hour_number(F.col("ts")))
        amounts = [float(h % 3) for h in range(24)]
        flows = spark.createDataFrame([(1, "flow_usd.x", last, 1.0, 5.0, "t", 24.0, amounts, "confirmed", None)], "id long, metric_key string, at timestamp, period_days double, value double, token_ref string, amount double, hourly_amounts array<double>, status string, superseded_by long")
        got = pricing.flow_usd(flows.withColumn("observed_hour", V.hour_number(F.col("at"))), prices).first()
        # hour h of the day is price number h + 6; 8 and 9 are missing, so the one before counts
        wanted = sum(a * (10 + (7 if h + 6 in (8, 9) else h + 6)) for h, a in enumerate(amounts))
        assert (got.usd, got.usd_basis, got.hours_priced, got.hours_needed) == (wanted, "hourly", 24, 16)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_overlaps_of_all_kinds(spark):
    """Against every pair, in bins of an hour, of a day and between; periods may be long, empty or before hour 0."""
    import random

    from quillspark.operators import asof

    pick = random.Random(5)
    sides = [[(i, pick.choice("ab"), s, s + pick.choice([-1, 0, 1, 1, 2, 3, 30, 100])) for i, s in enumerate(pick.choices(range(-40, 90), k=60))] for _ in range(2)]
    due = sorted((k, i, j, min(t, v) - max(s, u)) for i, k, s, t in sides[0] for j, m, u, v in sides[1] if k == m and s < t and u < v and min(t, v) > max(s, u))
    a, b = (spark.createDataFrame(x, "id long, k string, start long, stop long") for x in sides)
    for width in (1, 5, 24):
        assert sorted(tuple(r) for r in asof.overlaps(a, b, "k", width).collect()) == due


def test_overlaps_of_one_hour(spark):
    """Periods of one hour are shared by many tasks, each with few of them; every pair is there once."""
    from quillspark.operators import asof

    a, b = (spark.range(n).select("id", F.expr("concat('k', id % 1)").alias("k"), F.expr("5 + id % 1").alias("start"), F.expr("6 + id % 3").alias("stop")) for n in (150, 240))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = asof.overlaps(a, b, "k", 1, most=20).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.a_id, r.b_id) for r in rows) == [(i, j) for i in range(150) for j in range(240)]
    assert all(r.overlap_hours == min(r.a_id % 3, r.b_id % 3) + 1 for r in rows)
    assert len({r.task for r in rows}) == 4
    mixed = spark.createDataFrame([(i, "ab"[i % 7 == 0], i % 5, i % 5 + 1 + i % 4) for i in range(200)], "id long, k string, start long, stop long")
    plain = sorted(tuple(r) for r in asof.overlaps(mixed, mixed, "k", 2).collect())
    assert plain and plain == sorted(tuple(r) for r in asof.overlaps(mixed, mixed, "k", 2, most=7).collect())
