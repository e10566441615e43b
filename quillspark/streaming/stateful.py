"""Streams with state of their own for each key, by transformWithState: series with a cursor and revisions, watch rules, runs
of breaches. A key's state is one value; its rows of a micro-batch are taken in order, so their number (bounded by what a
micro-batch reads) sets a task's memory, not the history. Changes are written in numbered folders: a micro-batch that is
repeated after a failure writes the same again, and a later run goes on from the checkpoint."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .flows import all_changes

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _none(x: Any) -> Any:
    return None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x


class _Keyed(StatefulProcessor):
    """A processor whose state is one row of `state`, handled by step(rows in order, state or None, watermark in hours)."""

    state: str
    order: list[str]
    columns: list[str]

    def init(self, handle) -> None:
        self.handle, self.value = handle, handle.getValueState("state", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        old = self.value.get() if self.value.exists() else None
        found, new = self.step(list(frame.itertuples(index=False)), old, timerValues.getCurrentWatermarkInMs() // 3_600_000)
        self.value.update(new)
        if found:
            yield pd.DataFrame([(*key, *f) for f in found], columns=self.columns, dtype=object)

    def step(self, rows: list, old: Any, watermark: int) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def numbered(changes: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Takes what is there (availableNow) and reads all changes that the folder's runs have written so far."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        q = changes.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return all_changes(spark, folder, changes.schema)


def _types(rows: DataFrame, by: tuple[str, ...]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return "".join(f"{b} {kinds[b]}, " for b in by)


# ---- series with a cursor ---------------------------------------------------------------------------------------------


class _Series(_Keyed):
    state, order = "cursor long, days array<long>, value array<double>", ["response"]

    def __init__(self, by: tuple[str, ...], revision: int, backfill: int):
        self.revision, self.backfill = revision, backfill
        self.columns = [*by, "response", "day", "value", "previous"]

    def step(self, rows, old, watermark):
        cursor, stored = (old[0], dict(zip(old[1], old[2]))) if old else (None, {})
        found, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end].response == rows[at].response:
                end += 1
            first = rows[at].today - self.backfill
            start = first if cursor is None else cursor + 1 - self.revision
            newest = cursor
            for day, value in sorted({int(r.day): _none(r.value) for r in rows[at:end]}.items()):
                gap = day not in stored and day >= first
                if value is None or day >= rows[at].today or not (day >= start or gap):
                    continue
                newest = day if newest is None else max(newest, day)
                if stored.get(day) != value:
                    found.append((int(rows[at].response), day, value, stored.get(day)))
                    stored[day] = value
            cursor, at = newest, end
        days = sorted(stored)
        return found, (cursor, days, [stored[d] for d in days])


def series_changes(responses: DataFrame, *by: str, revision: int, backfill: int) -> DataFrame:
    """Of landed responses (response, today, day, value; days as numbers): what they change in the stored series, a row
    (response, day, value, previous) for a new or revised day.

    Responses count in ascending order. A response is read from `revision` days before its series' cursor (the newest day
    stored) on, and where a day of the last `backfill` days has no value yet; older days stay as they are. Days from today
    on aren't complete; a null value is no value; a value that is stored already changes nothing. A day that a response
    lists twice counts once, as listed last."""
    types = _types(responses, by)
    return responses.groupBy(*by).transformWithStateInPandas(_Series(by, revision, backfill), f"{types}response long, day long, value double, previous double", "Update", "None")


def series_now(changes: DataFrame, *by: str) -> DataFrame:
    """The series that all changes make: day, value."""
    return changes.groupBy(*by, "day").agg(F.max_by("value", "response").alias("value"))


def series_batch(responses: DataFrame, *by: str, revision: int) -> DataFrame:
    """series_now() of all responses at once, for responses that reach back less than `backfill` days."""
    rows = responses.where("value is not null and day < today")
    newest = rows.groupBy(*by, "response").agg(F.max("day").alias("_newest"))
    before = Window.partitionBy(*by).orderBy("response").rowsBetween(Window.unboundedPreceding, -1)
    cursor = newest.select(*by, "response", F.max("_newest").over(before).alias("_cursor"))
    first = F.row_number().over(Window.partitionBy(*by, "day").orderBy("response")) == 1
    rows = rows.withColumn("_first", first).join(cursor, [*by, "response"])
    return rows.where(F.col("_first") | (F.col("day") >= F.col("_cursor") + 1 - revision)).groupBy(*by, "day").agg(F.max_by("value", "response").alias("value"))


# ---- watch rules ------------------------------------------------------------------------------------------------------


class _Watch(_Keyed):
    state, order = "rule string, firing boolean, since long, hour long, id long, value double", ["hour", "id"]

    def __init__(self, by: tuple[str, ...], silence: int | None):
        self.by, self.silence = by, silence
        self.columns = [*by, "id", "hour", "change", "rule", "since"]

    def step(self, rows, old, watermark):
        rule, was, since, hour, at, value = old or (None, False, None, None, None, None)
        found = []
        for r in rows:
            if hour is not None and (r.hour, r.id) <= (hour, at):  # read before what is known
                continue
            if r.rule != rule:
                was, since = False, None
            now = bool(r.firing)
            if since is None or now != was:
                since = int(r.hour)
            if now != was:
                found.append((int(r.id), int(r.hour), "fired" if now else "cleared", r.rule, since))
            rule, was, hour, at, value = r.rule, now, int(r.hour), int(r.id), _none(r.value)
        if self.silence is not None and hour is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((hour + self.silence) * 3_600_000)
        return found, (rule, was, since, hour, at, value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule, _, since, hour, at, _ = self.value.get()
        yield pd.DataFrame([(*key, at, hour + self.silence, "silent", rule, since)], columns=self.columns, dtype=object)


def watch_changes(readings: DataFrame, *by: str, silence: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Of readings (hour, id, value, rule, firing) the ones at which a rule begins to fire or clears: id, hour, change,
    rule, since (the hour the state before or now began).

    Readings of a key count in the order of (hour, id); one that comes after later ones were taken is passed over. rule
    names a rule and its version: a key whose rule is another than before starts afresh, as not firing. Keys that aren't
    read keep their state. silence: a key without a reading for so many hours, by the watermark, gives a change `silent`
    once, and keeps its state; times are hours since 1970 then."""
    out = f"{_types(readings, by)}id long, hour long, change string, rule string, since long"
    rows = readings.select(*by, "hour", "id", "value", "rule", "firing")
    if silence is None:
        return rows.groupBy(*by).transformWithStateInPandas(_Watch(by, None), out, "Update", "None")
    rows = rows.withColumn("_at", F.timestamp_seconds(F.col("hour") * 3600)).withWatermark("_at", late)
    return rows.groupBy(*by).transformWithStateInPandas(_Watch(by, silence), out, "Update", "EventTime")


# ---- runs of breaches -------------------------------------------------------------------------------------------------


class _Breaches(_Keyed):
    state = "last long, length long, fresh boolean, hours array<long>, gaps array<double>, news array<boolean>, given array<long>"
    order = ["hour"]

    def __init__(self, by: tuple[str, ...], tolerance: float, consecutive: int):
        self.tolerance, self.consecutive = tolerance, consecutive
        self.columns = [*by, "hour", "change"]

    def step(self, rows, old, watermark):
        last, length, fresh, hours, gaps, news, given = old or (None, 0, False, [], [], [], [])
        known = {h: (_none(g), f) for h, g, f in zip(hours, gaps, news)}
        for r in rows:
            if last is None or r.hour > last:  # hours up to the last closed one are done with
                known[int(r.hour)] = (_none(r.gap), bool(r.fresh))
        now, closed = [], None
        state = (last, length, fresh)
        for hour in sorted(known):
            gap, new = known[hour]
            at, n, any_fresh = state
            if at is not None and hour != at + 1:
                n, any_fresh = 0, False
            if gap is not None and abs(gap) <= self.tolerance:
                n, any_fresh = 0, False
            elif gap is not None:
                n, any_fresh = n + 1, any_fresh or new
                if n == self.consecutive and any_fresh:
                    now.append(hour)
            state = (hour, n, any_fresh)
            if hour < watermark:
                closed = state
        before = set(given)
        found = [(h, "opened") for h in now if h not in before] + [(h, "withdrawn") for h in sorted(before - set(now))]
        if closed is not None:
            last, length, fresh = closed
            known = {h: x for h, x in known.items() if h > last}
            now = [h for h in now if h > last]
        hours = sorted(known)
        return found, (last, length, fresh, hours, [known[h][0] for h in hours], [known[h][1] for h in hours], now)


def breach_changes(prices: DataFrame, tolerance: float, consecutive: int, *by: str, late: str) -> DataFrame:
    """breach_runs() over a stream of (hour, gap, fresh), hours since 1970: hour and change, `opened` where a run of breaching
    hours becomes `consecutive` long, `withdrawn` where a late hour has shown that it doesn't there: runs are joined when a
    late hour fills what was between them, and cut when it breaks one. Hours that the watermark (`late` behind the latest)
    has passed are folded into the run that ends there; rows of such hours are dropped. An hour that comes twice counts as
    it came last."""
    rows = prices.select(*by, "hour", "gap", "fresh", F.timestamp_seconds(F.col("hour") * 3600).alias("_at")).withWatermark("_at", late)
    return rows.groupBy(*by).transformWithStateInPandas(_Breaches(by, tolerance, consecutive), f"{_types(prices, by)}hour long, change string", "Update", "EventTime")


def open_breaches(changes: DataFrame, *by: str) -> DataFrame:
    """Hours that are opened once more often than withdrawn."""
    balance = F.sum(F.when(F.col("change") == "opened", 1).otherwise(-1))
    return changes.groupBy(*by, "hour").agg(balance.alias("_n")).where("_n > 0").drop("_n")
