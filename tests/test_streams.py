"""Streams over several micro-batches: restarts, repeated micro-batches, late and revised rows."""

import random

import pytest

from quillspark.operators import pricing
from quillspark.streaming import flows as W
from quillspark.streaming import stateful as S

RESPONSE = "series string, response long, today long, day long, value double"


def plain_series(rows, revision, backfill):
    """Responses one after the other."""
    stored, cursor = {}, {}
    for key in sorted({(r[0], r[1]) for r in rows}, key=lambda k: k[1]):
        of = [r for r in rows if (r[0], r[1]) == key]
        series, c = key[0], cursor.get(key[0])
        days, today = {d: v for _, _, _, d, v in of}, of[0][2]
        first = today - backfill
        for d, v in days.items():
            if v is not None and d < today and (d >= (first if c is None else c + 1 - revision) or (d >= first and (series, d) not in stored)):
                stored[series, d] = v
                cursor[series] = max(cursor.get(series, d), d)
    return {(*k, v) for k, v in stored.items()}


def responses(seed, n=25):
    rng = random.Random(seed)
    out = []
    for s in "ab":
        for r in range(n):
            today = r + 3
            days = sorted(rng.sample(range(max(0, today - 12), today + 1), min(6, today + 1)))
            out += [(s, r, today, d, rng.choice([None, 1.0, float(r), float(d)])) for d in days]
    return out


def test_series_in_five_batches(spark):
    """Five micro-batches over several runs: one run fails when its sink has written half, so that its micro-batch is
    repeated; old days are revised throughout."""
    rows = responses(1)
    folder = W.shared_folder(spark, "series")
    schema = spark.createDataFrame([], RESPONSE).schema
    stream = lambda: S.series_changes(W.landed_parts(spark, folder, schema), "series", revision=3, backfill=9)
    for k in range(5):
        W.land(spark.createDataFrame([r for r in rows if r[1] // 5 == k], RESPONSE), folder, k)
        if k == 2:  # stopped halfway: the rows are written, but the micro-batch isn't done
            def broken(batch, number):
                batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
                raise ValueError("stopped")

            before = spark.conf.get(S._PROVIDER)
            spark.conf.set(S._PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            q = stream().writeStream.foreachBatch(broken).outputMode("update").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
            with pytest.raises(Exception, match="stopped"):
                q.awaitTermination()
            spark.conf.set(S._PROVIDER, before)
        changes = S.numbered(stream(), spark, folder)
        assert {tuple(r) for r in S.series_now(changes, "series").collect()} == plain_series([r for r in rows if r[1] // 5 <= k], 3, 9)
    again = S.numbered(stream(), spark, folder)  # nothing new
    assert {tuple(r) for r in S.series_now(again, "series").collect()} == plain_series(rows, 3, 9)
    # every change tells what it replaces
    by_day = {}
    for r in sorted(changes.collect(), key=lambda r: r.response):
        assert r.previous == by_day.get((r.series, r.day)) and r.value != r.previous
        by_day[r.series, r.day] = r.value


def test_series_batch(spark):
    """The batch form over all responses gives the same where they reach back less than the backfill."""
    rows = [r for r in responses(4) if r[4] is not None]
    got = {tuple(r) for r in S.series_batch(spark.createDataFrame(rows, RESPONSE), "series", revision=3).collect()}
    assert got == plain_series(rows, 3, 1000)


READING = "metric string, hour long, id long, value double, rule string, firing boolean"


def watched(spark, folder, part, rows, **options):
    W.land(spark.createDataFrame([(m, h, h, float(v), rule, f) for m, h, v, rule, f in rows], READING), folder, part)
    stream = W.landed_parts(spark, folder, spark.createDataFrame([], READING).schema)
    return sorted((r.metric, r.hour, r.change, r.rule, r.since) for r in S.numbered(S.watch_changes(stream, "metric", **options), spark, folder).collect())


def test_watch_over_runs(spark):
    """Fires once, stays quiet, clears once; a metric that isn't read keeps its state; a changed rule starts afresh."""
    folder = W.shared_folder(spark, "watch")
    a = [("m", 1, 5, "v1", False), ("m", 2, 9, "v1", True), ("k", 2, 9, "v1", True)]
    fired = [("k", 2, "fired", "v1", 2), ("m", 2, "fired", "v1", 2)]
    assert watched(spark, folder, 0, a) == fired
    assert watched(spark, folder, 1, [("m", 3, 9, "v1", True), ("m", 2, 0, "v1", False)]) == fired  # the second comes too late
    more = sorted([*fired, ("m", 4, "cleared", "v1", 4)])
    assert watched(spark, folder, 2, [("m", 4, 1, "v1", False)]) == more
    # k was firing by v1; by v2 it fires anew, and what v2 finds quiet isn't cleared
    more = sorted([*more, ("k", 5, "fired", "v2", 5)])
    assert watched(spark, folder, 3, [("k", 5, 9, "v2", True), ("k", 6, 9, "v2", True)]) == more
    assert watched(spark, folder, 4, [("k", 7, 1, "v3", False)]) == more
    assert watched(spark, folder, 5, []) == more


def test_watch_silence(spark):
    folder = W.shared_folder(spark, "silence")
    watched(spark, folder, 0, [("m", 1, 5, "v1", True), ("k", 1, 5, "v1", False)], silence=5)
    watched(spark, folder, 1, [("k", 20, 5, "v1", False)], silence=5)
    got = watched(spark, folder, 2, [("k", 21, 5, "v1", False), ("m", 22, 5, "v1", True)], silence=5)
    assert ("m", 6, "silent", "v1", 1) in got and sum(r[2] == "silent" for r in got if r[0] == "m") == 1
    assert sum(r[2] == "fired" for r in got if r[0] == "m") == 1  # the state was kept


@pytest.mark.parametrize("seed", [1, 2])
def test_breaches_in_any_order(spark, seed):
    """Shuffled arrival over five runs gives what the batch form gives, after each run for what has come so far."""
    rng = random.Random(seed)
    schema = "ref string, hour long, gap double, fresh boolean"
    rows = [(ref, h, rng.choice([None, 1.0, 9.0, 9.0, -9.0]), rng.random() < 0.4) for ref in "ab" for h in range(60) if rng.random() < 0.9]
    rng.shuffle(rows)
    folder = W.shared_folder(spark, "breaches")
    kind = spark.createDataFrame([], schema).schema
    for k in range(5):
        W.land(spark.createDataFrame(rows[k::5], schema), folder, k)
        changes = S.numbered(S.breach_changes(W.landed_parts(spark, folder, kind), 5.0, 3, "ref", late="100 hours"), spark, folder)
        seen = spark.createDataFrame([r for j in range(k + 1) for r in rows[j::5]], schema)
        want = {(r.ref, r.hour) for r in pricing.breach_runs(seen, 5.0, 3, "ref").collect()}
        assert {tuple(r) for r in S.open_breaches(changes, "ref").collect()} == want
    assert seed != 1 or changes.where("change = 'withdrawn'").count() > 0


def test_breaches_behind_the_watermark(spark):
    """Hours that the watermark has passed are folded up, so that state doesn't grow, and the run goes on from there."""
    schema = "ref string, hour long, gap double, fresh boolean"
    rows = [("a", h, 9.0 if h % 10 else 1.0, True) for h in range(100)]
    folder = W.shared_folder(spark, "breaches")
    kind = spark.createDataFrame([], schema).schema
    for k in range(5):
        W.land(spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema), folder, k)
        changes = S.numbered(S.breach_changes(W.landed_parts(spark, folder, kind), 5.0, 3, "ref", late="5 hours"), spark, folder)
    assert {tuple(r) for r in S.open_breaches(changes, "ref").collect()} == {(r.ref, r.hour) for r in pricing.breach_runs(spark.createDataFrame(rows, schema), 5.0, 3, "ref").collect()}
    assert changes.where("change = 'withdrawn'").count() == 0


def test_latest_over_runs(spark):
    folder = W.shared_folder(spark, "latest")
    schema = "k long, at long, v string"
    kind = spark.createDataFrame([], schema).schema
    take = lambda: {tuple(r) for r in W.latest_table(W.landed_parts(spark, folder, kind), spark, folder, ["k"], "at").collect()}
    W.land(spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], schema), folder, 0)
    assert take() == {(1, 1, "a"), (2, 5, "b")}
    assert take() == {(1, 1, "a"), (2, 5, "b")}  # nothing new
    W.land(spark.createDataFrame([(1, 3, "c"), (2, 4, "old"), (3, 1, "d")], schema), folder, 1)
    assert take() == {(1, 3, "c"), (2, 5, "b"), (3, 1, "d")}
    assert W.all_changes(spark, W.shared_folder(spark, "never"), kind).count() == 0
