"""The observation store as folds over append-only rows: supersede, overlays, keyed upserts, anomalies, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_active() -> Column:
    """Neither superseded nor rejected."""
    return F.col("superseded_by").isNull() & (F.col("status") != "rejected")


def active(observations: DataFrame) -> DataFrame:
    return observations.where(is_active())


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows that come last by the columns; a top-k, not a sort of all."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def page_before(rows: DataFrame, key: str, before: int | None, n: int) -> DataFrame:
    """Keyset paging: the n rows with the largest keys below `before`."""
    return newest(rows if before is None else rows.where(F.col(key) < before), n, key)


def optional_filters(rows: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters, and since_x for x at or after a value; those that are None are left out of the plan."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name.removeprefix("since_")) >= value if name.startswith("since_") else F.col(name) == value)
    return rows


def supersede(observations: DataFrame, *key: str) -> DataFrame:
    """superseded_by of every row, from append order (id): a confirmed row supersedes all earlier ones of its key, a
    provisional one only provisional ones; rejected rows do nothing. One shuffle by the key."""
    later = Window.partitionBy(*key).orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    by_confirmed = F.first(F.when(F.col("status") == "confirmed", F.col("id")), ignorenulls=True).over(later)
    by_any = F.first(F.when(F.col("status").isin("confirmed", "provisional"), F.col("id")), ignorenulls=True).over(later)
    return observations.withColumn("superseded_by", F.when(F.col("status") == "provisional", by_any).when(F.col("status") == "confirmed", by_confirmed))


def latest_by_key(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def overlay(rows: DataFrame, events: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """rows with column replaced by that of the key's latest event, where there is one."""
    last = events.groupBy(key).agg(F.max_by(column, order).alias("_new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def fill_missing(rows: DataFrame, found: DataFrame, key: str, *columns: str) -> DataFrame:
    """Active rows' null columns from found, which has a row for each key at most."""
    new = found.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.when(is_active(), F.coalesce(c, f"_{c}")).otherwise(F.col(c)) for c in columns}).select(rows.columns)


def first_known(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """For each key the first value of each column that isn't null, by arrival: later writes fill nulls only."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*first)


def valid_prices(rows: DataFrame) -> DataFrame:
    """Rows with a reason why a price write is refused, null if it is not."""
    twice = Window.partitionBy("token_ref", "source", "hour", "fetched_at")
    return rows.withColumn("refused", F.when(F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0), "not a positive price").when(F.count("*").over(twice) > 1, "hour given twice"))


def advance_cursor(old: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """Cursors never go back."""
    return old.unionByName(new).groupBy(*key).agg(F.max(column).alias(column))


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of new that may be added: their key is neither in old nor earlier in new."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), order).alias("r"))
    return first.join(old.select(*key), key, "left_anti").select(*key, "r.*").select(new.columns)


def fold_anomalies(events: DataFrame) -> DataFrame:
    """events (dedupe_key, at, kind: raise | resolve, severity): one row for each life of an anomaly, with the number of
    raises, first and last of them, severity of the last, and whether it is open. A raise after a resolve opens anew."""
    by = Window.partitionBy("dedupe_key").orderBy("at")
    life = F.count_if(F.col("kind") == "resolve").over(by.rowsBetween(Window.unboundedPreceding, -1))
    raised = F.col("kind") == "raise"
    out = events.withColumn("life", life).groupBy("dedupe_key", "life").agg(
        F.count_if(raised).alias("occurrences"), F.min(F.when(raised, F.col("at"))).alias("first_seen"), F.max(F.when(raised, F.col("at"))).alias("last_seen"),
        F.max_by("severity", F.when(raised, F.col("at"))).alias("severity"), (F.count_if(~raised) == 0).alias("open"),
    )
    return out.where("occurrences > 0")


def purge_plan(observations: DataFrame, metrics: list[str]) -> DataFrame:
    """What a purge would delete, by metric."""
    doomed = observations.where(F.col("metric_key").isin(metrics))
    return doomed.groupBy("metric_key").agg(
        F.count("*").alias("n_rows"), F.count("superseded_by").alias("n_superseded"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")
    )


def purge_refusals(observations: DataFrame, configured: DataFrame, anomalies: DataFrame, metrics: list[str]) -> DataFrame:
    """metric_key, refusals of the metrics that may not be purged: still configured, an open anomaly names it, rows of
    other metrics point into it, or a row of it has no later one in its place. configured and anomalies: metric_key."""
    doomed = observations.where(F.col("metric_key").isin(metrics))
    found = [
        configured.select("metric_key", F.lit("configured").alias("why")),
        anomalies.select("metric_key", F.lit("open anomaly").alias("why")),
        dangling(observations, doomed).select(F.col("superseded_by").alias("id")).join(doomed.select("id", "metric_key"), "id").select("metric_key", F.lit("rows point into it").alias("why")),
        doomed.where("superseded_by is null and status = 'confirmed'").select("metric_key", F.lit("not replaced").alias("why")),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return every.where(F.col("metric_key").isin(metrics)).groupBy("metric_key").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("refusals"))


def dangling(observations: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows that stay although the row that supersedes them goes."""
    ids = doomed.select(F.col("id"))
    return observations.join(ids, "id", "left_anti").join(ids.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi")


def keep_newest(rows: DataFrame, kind: str, order: str, n: dict[str, int]) -> DataFrame:
    """The n newest rows of each kind; kinds that aren't listed keep none."""
    most = F.coalesce(*(F.when(F.col(kind) == k, v) for k, v in n.items()), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def diff_by_key(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """added, missing, changed or same, of each key of either side."""
    both = old.select(key, F.col(column).alias("_old"), F.lit(True).alias("_o")).join(new.select(key, F.col(column).alias("_new"), F.lit(True).alias("_n")), key, "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return both.select(key, kind.alias("change"))


def table_hash(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Order-free digest of each group's rows: the sums of the four 32-bit quarters of the rows' MD5, and their number."""
    line = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))
    part = [F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *part)


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    """Whether both have the same rows, each as often."""
    return not left.exceptAll(right).limit(1).count() and not right.exceptAll(left).limit(1).count()
