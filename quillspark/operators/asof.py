"""As-of joins over hour-aligned tables, as windows: no range join, one shuffle by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods of a side that meet at once.
MOST_MEET = 16_384


def hour_price_dedupe(prices: DataFrame) -> DataFrame:
    """One price for each token and hour: the newest fetched, then the first source."""
    best = F.min_by("price", F.struct((-F.col("fetched_at")).alias("a"), F.col("source").alias("b")))
    return prices.groupBy("token_ref", "hour").agg(best.alias("price"))


def asof_value(left: DataFrame, right: DataFrame, by: str, on: str, value: str, back: int) -> DataFrame:
    """left with the value of right's latest row of the key at or before `on`, at most `back` hours before; null if
    there is none. right has a row for each key and hour at most. Both sides are dealt by the key and swept in order, so
    one key's rows are one task's, sorted on disk if need be; where a key may hold a third of all rows, forward_prices()
    makes the join one of equality."""
    marks = right.select(by, F.col(on).alias(on), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(by, on, "_row", F.lit(1).alias("_side"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on).rangeBetween(-back, 0)
    found = both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return found.where("_side = 1").select("_row.*", value)


def forward_prices(prices: DataFrame, back: int) -> DataFrame:
    """The price in force at each hour: every price is valid for `back` hours after its own, the latest one counts.
    Spreading prices forward (back + 1 rows each) makes the as-of join an equality join on token and hour, which Spark
    can split however many rows one token has."""
    spread = prices.select("token_ref", F.explode(F.sequence(F.col("hour"), F.col("hour") + back)).alias("at"), "hour", "price")
    return spread.groupBy("token_ref", "at").agg(F.max_by("price", "hour").alias("price")).withColumnRenamed("at", "hour")


def asof_level(levels: DataFrame, as_of: Column | int, *by: str) -> DataFrame:
    """The latest reading at or before an hour; ties to the higher id."""
    return levels.where(F.col("hour") <= as_of).groupBy(*by).agg(F.max_by(F.struct("hour", "id", "value"), F.struct("hour", "id")).alias("r")).select(*by, "r.*")


def first_reading(levels: DataFrame, start: int, hours: int, *by: str) -> DataFrame:
    """The first reading in [start, start + hours)."""
    rows = levels.where((F.col("hour") >= start) & (F.col("hour") < start + hours))
    return rows.groupBy(*by).agg(F.min_by(F.struct("hour", "id", "value"), F.struct("hour", "id")).alias("r")).select(*by, "r.*")


def schedule(steps: DataFrame, as_of: int, *by: str) -> DataFrame:
    """The step in force at an hour and those after it."""
    now = asof_level(steps, as_of, *by).withColumn("in_force", F.lit(True))
    later = steps.where(F.col("hour") > as_of).select(*by, "hour", "id", "value", F.lit(False).alias("in_force"))
    return now.select(later.columns).union(later)


def previous(rows: DataFrame, *by: str) -> DataFrame:
    """Each reading with the value of the newest one strictly before its hour."""
    w = Window.partitionBy(*by).orderBy("hour").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.max_by("value", F.struct("hour", "id")).over(w))


def nearest(points: DataFrame, others: DataFrame, by: str, within: int) -> DataFrame:
    """For each point (key, at) the other row (hour, id, value) of the key nearest in time, at most `within` hours away,
    the earlier of two as near; the earliest of all where none is. others are spread over coarse bins of that width, so
    that the join is one of equality."""
    bins = lambda c: F.expr(f"{c} div {within}")
    near = others.select(by, "hour", "id", "value", F.explode(F.array(bins("hour") - 1, bins("hour"), bins("hour") + 1)).alias("_bin"))
    met = points.withColumn("_bin", bins("at")).join(near, [by, "_bin"]).where(F.abs(F.col("hour") - F.col("at")) <= within)
    best = met.groupBy(by, "at").agg(F.min_by(F.struct("hour", "value"), F.struct(F.abs(F.col("hour") - F.col("at")), F.col("hour"), F.col("id"))).alias("n"))
    first = others.groupBy(by).agg(F.min_by(F.struct("hour", "value"), F.struct("hour", "id")).alias("f"))
    out = points.join(best, [by, "at"], "left").join(first, by, "left").withColumn("x", F.coalesce("n", "f"))
    return out.select(by, "at", F.col("x.hour").alias("base_hour"), F.col("x.value").alias("base"), F.when(F.col("n").isNotNull(), "near").otherwise("earliest").alias("basis"))


def overlaps(left: DataFrame, right: DataFrame, by: str, bin_hours: int = 24, most: int = MOST_MEET) -> DataFrame:
    """Pairs of periods [start, stop) of a key that overlap by more than nothing, once each, with the hours of overlap.
    Of a pair the later start lies in the other period. So starts meet the periods that are dealt to their bin; in bins of
    an hour every pair that meets is one, in wider ones longer periods are dealt to fewer. Work grows with the pairs. Where more
    than about `most` of a side share a bin, both sides are dealt into cells by id, so that any number of tasks share its pairs and
    each holds few; that ships a row for most / 2 pairs. The list of such bins has a row for `most` dealt periods at most."""
    bin_ = lambda c: F.expr(f"{c} div {bin_hours}")
    sides = lambda df, p: df.select(by, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("stop").alias(f"{p}_stop")).where(f"{p}_start < {p}_stop")
    a, b = sides(left, "a"), sides(right, "b")
    dealt = lambda df, p: df.withColumn("_bin", F.explode(F.sequence(bin_(f"{p}_start"), bin_(f"({p}_stop - 1)"))))
    starts = lambda df, p: df.withColumn("_bin", bin_(f"{p}_start"))
    one = lambda p: dealt(a if p == "a" else b, p).select(by, "_bin", F.lit(int(p == "a")).alias("_a"), F.lit(int(p == "b")).alias("_b"))
    sizes = one("a").unionByName(one("b")).groupBy(by, "_bin").agg(*(F.ceil(F.sum(c) / most).alias(c) for c in ("_a", "_b")))
    crowded = F.broadcast(sizes.where("_a > 0 and _b > 0 and (_a > 1 or _b > 1)"))

    def placed(df: DataFrame, p: str) -> DataFrame:
        other = F.sequence(F.lit(0).cast("long"), F.coalesce("_b" if p == "a" else "_a", F.lit(1)) - 1)
        own = F.coalesce(F.pmod(F.xxhash64(f"{p}_id"), f"_{p}"), F.lit(0))
        cells = F.transform(other, lambda x: own * F.coalesce("_b", F.lit(1)) + x if p == "a" else x * F.coalesce("_b", F.lit(1)) + own)
        return df.join(crowded, [by, "_bin"], "left").withColumn("_cell", F.explode(cells)).drop("_a", "_b")

    met = lambda x, y: placed(x, "a").join(placed(y, "b"), [by, "_bin", "_cell"])
    in_b = met(starts(a, "a"), dealt(b, "b")).where("b_start <= a_start and a_start < b_stop")
    in_a = met(dealt(a, "a"), starts(b, "b")).where("a_start < b_start and b_start < a_stop")
    hours = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    both = [x.select(by, "a_id", "b_id", hours.alias("overlap_hours")) for x in (in_b, in_a)]
    return both[0].unionByName(both[1])
