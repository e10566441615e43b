"""Transfer scans and the computations behind sources, over landed raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_transfers(transfers: DataFrame, listed: DataFrame, ignored: DataFrame, dust: float) -> DataFrame:
    """transfers with kind: listed, ignored, dust or unlisted, by sender. Both lists have a sender once; Spark
    sees their size and picks the join."""
    rows = transfers.join(listed.select("sender", F.lit(True).alias("_l")), "sender", "left").join(ignored.select("sender", F.lit(True).alias("_i")), "sender", "left")
    kind = F.when(F.col("amount") == 0, "zero").when(F.col("_i"), "ignored").when(F.col("_l"), "listed").when(F.col("amount") <= dust, "dust").otherwise("unlisted")
    return rows.withColumn("kind", kind).drop("_l", "_i")


def transfer_days(transfers: DataFrame, *by: str) -> DataFrame:
    """Amount and the 24 hourly amounts of each day; hours outside are clamped to the day's ends."""
    hour = F.greatest(F.lit(0), F.least(F.lit(23), F.col("hour")))
    sums = [F.coalesce(F.sum(F.when(hour == h, F.col("amount"))), F.lit(0.0)) for h in range(24)]
    return transfers.groupBy(*by, "day").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.array(*sums).alias("hourly_amounts"))


def unlisted_senders(transfers: DataFrame) -> DataFrame:
    rows = transfers.where("kind = 'unlisted'")
    at = F.struct("day", "transfer_id")
    return rows.groupBy("sender").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min_by("transfer_id", at).alias("first_tx"), F.max_by("transfer_id", at).alias("last_tx"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def ref_digest(rows: DataFrame, ref: str, most: int, *by: str) -> DataFrame:
    """The first `most` references in order, their number, and an order-free digest of all of them: the sums of the
    four quarters of their MD5. No group is gathered."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(ref))
    h = F.md5(F.col(ref).cast("string"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)))
    some = rows.select(*by, ref).withColumn("_r", rank).where(F.col("_r") <= most).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(ref)), ",").alias("refs"))
    return whole.join(some, list(by))


def day_digest(rows: DataFrame, ref: str, *by: str) -> DataFrame:
    """n, digest of each group's references: the SHA-256 of their ordered list as JSON. by names the day of the row that
    keeps the digest, so a group is a day's; larger groups have ref_digest()."""
    refs = F.array_sort(F.collect_list(F.col(ref).cast("string")))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.to_json(refs), 256).alias("digest"))


def share_of_total(rows: DataFrame, part: Column, value: str, *by: str) -> DataFrame:
    """Share of the rows of `part` in a group's total; null values are 0; null where nothing is of `part` or the total
    is 0."""
    v = F.coalesce(value, F.lit(0.0))
    return rows.groupBy(*by).agg(F.when((F.count_if(part) > 0) & (F.sum(v) != 0), F.sum(F.when(part, v)) / F.sum(v)).alias("share"))


def json_points(body: Column) -> Column:
    """[[seconds or name, value], ...] of a JSON text as an array of arrays of doubles."""
    return F.from_json(body, "array<array<double>>")


def json_path(body: Column, path: str) -> Column:
    """A dot path; segments that are numbers are places in a list."""
    return F.get_json_object(body, "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in path.split(".")))


def counter_rate(levels: DataFrame, start: int, end: int, share: float, *by: str) -> DataFrame:
    """Change of a counter between the latest readings at two hours, for a year, plus a share of it; null for a counter
    that fell."""
    at = lambda h, p: levels.where(F.col("hour") <= h).groupBy(*by).agg(F.max_by(F.struct("hour", "value"), F.struct("hour", "id")).alias(p))
    both = at(start, "a").join(at(end, "b"), list(by))
    hours, change = F.col("b.hour") - F.col("a.hour"), F.col("b.value") - F.col("a.value")
    return both.select(*by, F.when((hours > 0) & (change >= 0), change / hours * 24 * 365 * (1 + share)).alias("rate"))


def buys_by_day(trades: DataFrame, *by: str) -> DataFrame:
    """Sum of price times size by day, without the oldest day, which may be cut."""
    days = trades.groupBy(*by, "day").agg(F.sum(F.col("price") * F.col("size")).alias("value"))
    oldest = days.groupBy(*by).agg(F.min("day").alias("_first"))
    return days.join(oldest, list(by)).where("day > _first").drop("_first")


def crossing(points: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Where y first reaches the threshold, between the point and the one before by a straight line."""
    w = Window.partitionBy(*by).orderBy("x")
    rows = points.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("y").over(w)}).where(F.col("y") >= threshold)
    first = rows.groupBy(*by).agg(F.min_by(F.struct("x", "y", "_x", "_y"), "x").alias("p"))
    line = F.col("p._x") + (F.col("p.x") - F.col("p._x")) * (threshold - F.col("p._y")) / (F.col("p.y") - F.col("p._y"))
    return first.select(*by, F.when(F.col("p._x").isNull() | (F.col("p._y") >= threshold), F.col("p.x").cast("double")).otherwise(line).alias("at"))


def failure_streaks(runs: DataFrame, n: int, *by: str) -> DataFrame:
    """Whether the newest n statuses that aren't skipped are all failures."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("id")))
    last = runs.where("status <> 'skipped'").withColumn("_r", rank).where(F.col("_r") <= n)
    return last.groupBy(*by).agg(((F.count("*") == n) & F.bool_and(F.col("status") == "failed")).alias("failing"))


def outcomes(runs: DataFrame, *by: str) -> DataFrame:
    good, bad = F.bool_and(F.col("status") != "failed"), F.bool_and(F.col("status") == "failed")
    return runs.groupBy(*by).agg(F.when(good, "ok").when(bad, "failed").otherwise("partial").alias("outcome"))


def watch_firings(rows: DataFrame, *by: str, above: float, change_pct: float, low: float, high: float) -> DataFrame:
    """above, moved and outside of each reading against the one before: a reading over the bar fires unless the one
    before was over it; a move from 0 to anything fires."""
    w = Window.partitionBy(*by).orderBy("hour", "id")
    v, p = F.col("value"), F.lag("value").over(w)
    out = rows.withColumn("previous", p)
    p = F.col("previous")
    moved = F.when(p.isNull(), False).when(p == 0, v != 0).otherwise(F.abs(v - p) / F.abs(p) * 100 > change_pct)
    return out.withColumns({"above": (v > above) & ~F.coalesce(p > above, F.lit(False)), "moved": moved, "outside": (v < low) | (v > high)})


def watch_transitions(rows: DataFrame, firing: Column, *by: str) -> DataFrame:
    """Readings at which a rule begins to fire or clears, and since when the state before lasted."""
    w = Window.partitionBy(*by).orderBy("hour", "id")
    state = rows.withColumn("firing", firing).withColumn("was", F.coalesce(F.lag("firing").over(w), F.lit(False)))
    return state.where("firing <> was").withColumn("change", F.when(F.col("firing"), "fired").otherwise("cleared"))


def complete_days(rows: DataFrame, kinds: int, today: str, *by: str) -> DataFrame:
    """day, value: the sum over kinds (kind, day, value) of each completed day. A kind counts from its first day on; a day
    that a kind misses from then on has no value; a kind with no row of today holds back its newest day, which may be
    partial; a key with fewer kinds has no days. A day that a kind lists twice has no value either."""
    now = F.lit(today).cast("date")
    span = rows.groupBy(*by, "kind").agg(F.min("day").alias("first"), F.max(F.when(F.col("day") < now, F.col("day"))).alias("newest"), F.bool_or(F.col("day") == now).alias("has_today"))
    held = span.where(~F.col("has_today")).select(*by, F.col("newest").alias("day"), F.lit(True).alias("held")).distinct()
    known = span.where("newest is not null").groupBy(*by).agg(F.count("*").alias("n_kinds"), F.sort_array(F.collect_list("first")).alias("firsts"))  # a date a kind
    days = rows.where(F.col("day") < now).groupBy(*by, "day").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("present"), F.sum("value").alias("value"))
    out = days.join(known.where(F.col("n_kinds") == kinds), list(by)).join(held, [*by, "day"], "left").where("held is null")
    due = F.size(F.filter("firsts", lambda f: f <= F.col("day")))
    return out.select(*by, "day", F.when((F.col("n") == F.col("present")) & (F.col("present") == due), F.col("value")).alias("value"))


def declared_share(code: Column, kinds: list[str]) -> Column:
    """The share n in `return s.has(x)?n:1` of a script, where s is a set of exactly the kinds; null unless one such number
    in (0, 1] is found."""
    sets = F.regexp_extract_all(code, F.lit(r"[A-Za-z0-9_$]+=new Set\(\[[^\]]*\]\)"), 0)
    members = lambda s: F.array_sort(F.split(F.regexp_replace(F.regexp_extract(s, r"\[([^\]]*)\]", 1), "[ `'\"]", ""), ","))
    names = F.transform(F.filter(sets, lambda s: members(s) == F.array(*map(F.lit, sorted(kinds)))), lambda s: F.substring_index(s, "=", 1))
    uses = F.regexp_extract_all(code, F.lit(r"return [A-Za-z0-9_$]+\.has\([A-Za-z0-9_$]+\)\?[0-9.]+:1"), 0)
    own = F.filter(uses, lambda u: F.array_contains(names, F.regexp_extract(u, r"^return ([A-Za-z0-9_$]+)\.has", 1)))
    share = F.regexp_extract(F.get(own, F.lit(0)), r"\?([0-9.]+):1$", 1).try_cast("double")
    return F.when((F.size(own) == 1) & (share > 0) & (share <= 1), share)


def yearly_emission(per_block: Column, seconds: Column, blocks: Column) -> Column:
    """Of an emission for each block, over a sample of so many blocks and seconds; null unless blocks take time."""
    return F.when(seconds > 0, per_block * (365 * 86_400) / (seconds / blocks))
