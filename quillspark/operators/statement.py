"""The income statement of all assets in one plan: declared lines joined to window sums and levels.

A line (asset, line, section, kind, metric, weight, bucket, haircut, base, by_metric, over_metric, level) is worth
- terms: its metric's sum over the window times weight; null if a day is missing,
- apportion: the same times the window sum of by_metric over that of over_metric, never over 0,
- level: the level given, already a year's,
- none: not measured.
Lines whose (metric, weight) terms cancel leave exactly 0, whatever rounding their sums have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import divided

DAYS_PER_YEAR = 365
BUCKETS = ("burn", "hold", "cash")


def window_sums(daily: DataFrame, end: str, days: int) -> DataFrame:
    """asset, metric, total and prior: sums over the window to end and the one before, null where a day is missing."""
    day = F.lit(end).cast("date")
    now, before = F.col("day") > F.date_sub(day, days), F.col("day") <= F.date_sub(day, days)
    rows = daily.where((F.col("day") <= day) & (F.col("day") > F.date_sub(day, 2 * days)))
    part = lambda c: F.when(F.count_if(c) == days, F.sum(F.when(c, F.col("value"))))
    return rows.groupBy("asset", "metric").agg(part(now).alias("total"), part(before).alias("prior"))


def line_values(lines: DataFrame, sums: DataFrame) -> DataFrame:
    """lines with term and prior_term (weighted window sums, null where incomplete), mix, and flow (the metric's whole
    window sum). lines are configuration;
    sums have a row for each series."""
    one = lambda c, p: sums.select("asset", F.col("metric").alias(c), F.col("total").alias(f"{p}_total"), F.col("prior").alias(f"{p}_prior"))
    out = lines.join(one("metric", "m"), ["asset", "metric"], "left").join(one("by_metric", "b"), ["asset", "by_metric"], "left").join(one("over_metric", "o"), ["asset", "over_metric"], "left")
    mix = F.when(F.col("o_total") != 0, F.col("b_total") / F.col("o_total"))
    weight = F.when(F.col("kind") == "apportion", F.col("weight") * mix).when(F.col("kind") == "terms", F.col("weight"))
    return out.withColumns({"mix": F.when(F.col("kind") == "apportion", mix), "term": F.col("m_total") * weight, "prior_term": F.col("m_prior") * weight, "flow": F.col("m_total")}).drop("m_total", "m_prior", "b_total", "b_prior", "o_total", "o_prior")


def to_year(total: Column, days: int) -> Column:
    return total * DAYS_PER_YEAR / days


def annualized(days: int) -> Column:
    """A line's figure for a year."""
    return F.when(F.col("kind") == "level", F.col("level")).otherwise(to_year(F.col("term"), days))


def _whole(values: Column, of: Column) -> Column:
    """Sum over the rows of `of`; 0 without such rows, null if one has no value."""
    return F.when(F.count_if(of & values.isNull()) == 0, F.coalesce(F.sum(F.when(of, values)), F.lit(0.0)))


def sections(values: DataFrame, days: int) -> DataFrame:
    """asset, section: measured (what is measured, null if a measured line misses a day), total (null too if a line is
    not measured), not_measured (sorted line names), terms and prior (sums before they are brought to a year)."""
    measured, level = F.col("kind") != "none", F.col("kind") == "level"
    terms = _whole(F.col("term"), measured & ~level)
    out = values.groupBy("asset", "section").agg(
        terms.alias("terms"), _whole(F.col("prior_term"), measured & ~level).alias("prior"), _whole(F.col("level"), level).alias("levels"),
        F.array_join(F.array_sort(F.collect_list(F.when(~measured, F.col("line")))), ",").alias("not_measured"),
    )
    out = out.withColumn("measured", to_year(F.col("terms"), days) + F.col("levels"))
    return out.withColumn("total", F.when(F.col("not_measured") == "", F.col("measured")))


def section_columns(found: DataFrame, names: dict[str, str], *columns: str) -> DataFrame:
    """One row for each asset with the columns of each section, named <name>_<column>."""
    picks = [F.max(F.when(F.col("section") == s, F.col(c))).alias(f"{n}_{c}") for s, n in names.items() for c in columns]
    here = [F.max(F.col("section") == s).alias(f"has_{n}") for s, n in names.items()]
    return found.groupBy("asset").agg(*picks, *here)


def profit(found: DataFrame, days: int) -> DataFrame:
    """revenue, costs, gross_profit (null with a cost not measured) and base (revenue less the measured costs)."""
    p = section_columns(found, {"revenue": "revenue", "cost": "costs"}, "terms", "levels", "total", "measured")
    zero = lambda c: F.when(F.col("has_costs"), F.col(c)).otherwise(0.0)  # noqa: E731  no cost lines: nothing to take off
    base = to_year(F.col("revenue_terms") - zero("costs_terms"), days) + F.col("revenue_levels") - zero("costs_levels")
    p = p.withColumn("base", base).withColumn("gross_profit", F.when(F.col("has_costs") & F.col("costs_total").isNull(), None).otherwise(F.col("base")))
    return p.select("asset", F.col("revenue_total").alias("revenue"), zero("costs_measured").alias("costs"), "gross_profit", "base", "revenue_terms", zero("costs_terms").alias("costs_terms"))


def cancelling(values: DataFrame) -> DataFrame:
    """asset, cancels: whether the uses pass on exactly what comes in: each (metric, weight) is as often in revenue as in
    costs and uses, and no level is among them."""
    rows = values.where("section in ('revenue', 'cost', 'holders', 'protocol', 'operating') and kind <> 'none'")
    weight = F.when(F.col("kind") != "level", F.col("weight") * F.when(F.col("kind") == "apportion", F.col("mix")).otherwise(1.0))
    side = F.when(F.col("section") == "revenue", 1).otherwise(-1)
    terms = rows.groupBy("asset", "metric", weight.alias("w")).agg(F.sum(side).alias("n"), F.bool_or(F.col("kind") == "level").alias("level"))
    return terms.groupBy("asset").agg((F.bool_and(F.col("n") == 0) & ~F.bool_or("level")).alias("cancels"))


def uses(found: DataFrame, days: int, remainder: str | None = None, cancels: DataFrame | None = None) -> DataFrame:
    """holders, protocol, operating and unreconciled for each asset. With a remainder section that section is revenue
    less the rest and nothing is left; else unreconciled is what is left, exactly 0 where cancelling() says so."""
    p = profit(found, days)
    u = section_columns(found, {"holders": "holders", "protocol": "protocol", "operating": "operating"}, "terms", "total", "levels")
    out = p.join(u, "asset", "left")
    total = {n: F.when(F.col(f"has_{n}"), F.col(f"{n}_total")).otherwise(0.0) for n in ("holders", "protocol", "operating")}
    terms = {n: F.when(F.col(f"has_{n}"), F.col(f"{n}_terms")).otherwise(0.0) for n in total}
    level = {n: F.when(F.col(f"has_{n}"), F.col(f"{n}_levels")).otherwise(0.0) for n in total}
    if remainder:
        others = [n for n in total if n != remainder]
        known = F.col("base").isNotNull() & total[others[0]].isNotNull() & total[others[1]].isNotNull()
        total[remainder] = F.when(known, F.col("base") - total[others[0]] - total[others[1]])
        left = F.lit(0.0)
    else:
        known = F.col("base").isNotNull() & total["holders"].isNotNull() & total["protocol"].isNotNull() & total["operating"].isNotNull()
        left = F.col("base") - to_year(sum(terms.values(), F.lit(0.0)), days) - sum(level.values(), F.lit(0.0))
        if cancels is not None:
            out = out.join(cancels, "asset", "left")
            left = F.when(F.col("cancels"), 0.0).otherwise(left)
    return out.select("asset", *(c.alias(n) for n, c in total.items()), F.when(known, left).alias("unreconciled"))


def recipients(base: Column) -> Column:
    """Tokens that a holder flow is paid on."""
    return F.when(base == "all", F.col("total_supply")).when(base == "locked", F.coalesce("locked", "staked")).otherwise(F.col("staked"))


def holder_lines(values: DataFrame, levels: DataFrame, days: int) -> DataFrame:
    """Lines that reach holders: gross of their own, and what totals count: unit_gross, net of the haircut, yield on the
    recipients' tokens at the price. Lines of an apportioned flow that all reach holders alike (one bucket, haircut and
    base) count once, at the first of them, as the whole flow; the others are no unit."""
    rows = values.where("section = 'holders' or (section = 'below' and bucket is not null)")
    key = ["asset", "metric", "over_metric"]
    size = values.where("kind = 'apportion'").groupBy(*key).agg(F.count("*").alias("set_size"))
    alike = rows.where("kind = 'apportion'").groupBy(*key).agg(
        F.count("*").alias("n"), F.count_distinct("bucket", "haircut", "base").alias("kinds"), F.min_by("line", F.struct(F.col("section") == "below", F.col("line"))).alias("first")
    )
    alike = alike.join(size, key).where("n = set_size and kinds = 1 and n > 1").select(*key, "first")
    rows = rows.join(alike, key, "left")
    own = F.when(F.col("kind") == "level", F.col("level")).otherwise(to_year(F.col("term"), days))
    whole = F.when(F.col("first").isNotNull(), to_year(F.col("flow"), days)).otherwise(own)
    out = rows.withColumns({"gross": own, "unit_gross": whole, "unit": F.col("first").isNull() | (F.col("line") == F.col("first"))})
    out = out.join(levels.select("asset", "price", "total_supply", "staked", "locked"), "asset", "left")
    out = out.withColumn("net", F.col("unit_gross") * (1 - F.col("haircut"))).withColumn("n", recipients(F.col("base")))
    paid = F.when((F.col("n") > 0) & (F.col("price") > 0), F.col("net") / (F.col("n") * F.col("price")))
    return out.withColumn("yield", paid).select("asset", "line", "section", "kind", "bucket", "unit", "gross", "unit_gross", "net", "yield")


def by_bucket(lines: DataFrame) -> DataFrame:
    """gross, net and yield of each bucket; null if a holders line of it is not measured, or a value is missing. A
    below-line line that is not measured is left out."""
    rows = lines.where("not (section = 'below' and kind = 'none')")
    unknown = F.count_if(F.col("kind") == "none") > 0
    total = lambda c: F.when(~unknown & (F.count_if(F.col("unit") & F.col(c).isNull()) == 0), F.sum(F.when(F.col("unit"), F.col(c))))
    below = F.col("section") == "below"
    return rows.groupBy("asset", "bucket").agg(total("unit_gross").alias("gross"), total("net").alias("net"), total("yield").alias("yield"), F.when(F.count_if(below) > 0, F.sum(F.when(below, F.col("gross")))).otherwise(0.0).alias("from_below"))


def bucket_columns(buckets: DataFrame) -> DataFrame:
    """has_<bucket>, net_<bucket>, yield_<bucket> in one row for each asset."""
    cols = []
    for b in BUCKETS:
        here = F.col("bucket") == b
        cols += [F.max(here).alias(f"has_{b}"), F.max(F.when(here, F.col("net"))).alias(f"net_{b}"), F.max(F.when(here, F.col("yield"))).alias(f"yield_{b}")]
    return buckets.groupBy("asset").agg(*cols)


def dilution(levels: DataFrame, releases: DataFrame) -> DataFrame:
    """Emissions and releases against the supply. releases: asset, rate, capped, cap; an asset may have none (nothing is
    added) or several (they add up). A release counts as far as its cap allows, one that is not capped whole; a rate or a
    cap that is declared but not known makes the asset's sum null."""
    counted = F.when(~F.col("capped"), F.col("rate")).when(F.col("rate").isNotNull() & F.col("cap").isNotNull(), F.least("rate", "cap"))
    released = releases.groupBy("asset").agg(F.when(F.count(counted) == F.count("*"), F.sum(counted)).alias("released"), F.lit(True).alias("declared"))
    rows = levels.join(released, "asset", "left").withColumn("tokens", F.col("emission") + F.when(F.col("declared"), F.col("released")).otherwise(0.0))
    fdv = F.col("price") * F.col("total_supply")
    pct = F.when(F.col("total_supply") > 0, F.col("tokens") / F.col("total_supply"))
    return rows.select("asset", "tokens", pct.alias("pct"), (pct * fdv).alias("usd"))


def yields(buckets: DataFrame, diluted: DataFrame, growth: DataFrame) -> DataFrame:
    """Cash and buyback yields (a bucket without a line is 0, a missing value makes the sum null), net of dilution, the
    multiple and its ratio to growth in percent. growth: asset, annualized."""
    b = bucket_columns(buckets).join(diluted, "asset", "left").join(growth, "asset", "left")
    part = lambda n: F.when(F.col(f"has_{n}"), F.col(f"yield_{n}")).otherwise(0.0)
    cash, buyback = part("cash"), part("burn") + part("hold")
    holder = cash + buyback
    multiple = F.when(holder > 0, 1 / holder)
    return b.select("asset", cash.alias("cash"), buyback.alias("buyback"), holder.alias("shareholder"), F.col("pct").alias("dilution"), (holder - F.col("pct")).alias("net_shareholder"), multiple.alias("multiple"), F.when(F.col("annualized") > 0, multiple / (F.col("annualized") * 100)).alias("peg"))


def multiples(levels: DataFrame, p: DataFrame, net: DataFrame) -> DataFrame:
    """Market value over revenue, gross profit and net holder flow; null unless the divisor is positive."""
    mcap = F.col("price") * F.col("circulating")
    rows = levels.join(p, "asset").join(net, "asset", "left")
    return rows.select("asset", mcap.alias("mcap"), *(divided(mcap, F.col(c)).alias(f"mcap_to_{c}") for c in ("revenue", "gross_profit", "net")))


def per_token(levels: DataFrame, p: DataFrame, diluted: DataFrame) -> DataFrame:
    """Figures for a token, on the circulating and on the total supply."""
    rows = levels.select("asset", F.explode(F.array(F.struct(F.lit("circulating").alias("supply"), F.col("circulating").alias("n")), F.struct(F.lit("total").alias("supply"), F.col("total_supply").alias("n")))).alias("s")).select("asset", "s.supply", "s.n")
    rows = rows.join(p, "asset").join(diluted.select("asset", "usd"), "asset", "left")
    return rows.select("asset", "supply", *(divided(F.col(c), F.col("n")).alias(c) for c in ("revenue", "gross_profit", "usd")))
