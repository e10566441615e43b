"""Queries of the income statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as P
from ..operators import statement as I
from .base import fx, query

END, DAYS = "2024-01-28", 7
#: The declared lines: line, section, kind, metric, weight, bucket, haircut, base, by_metric, over_metric, run_rate.
LINES = [
    ("rev_a", "revenue", "terms", "m0", 1.0, None, None, None, None, None, False),
    ("rev_b", "revenue", "terms", "m1", 0.5, None, None, None, None, None, False),
    ("rev_c", "revenue", "terms", "m3", 0.25, None, None, None, None, None, False),
    ("cost_a", "cost", "terms", "m2", 0.25, None, None, None, None, None, False),
    ("hold_a", "holders", "terms", "m0", 0.5, "burn", 0.0, "all", None, None, False),
    ("hold_b", "holders", "terms", "m1", 0.25, "cash", 0.125, "staked", None, None, False),
    ("hold_c", "holders", "apportion", "m2", 1.0, "hold", 0.0, "locked", "m0", "m1", False),
    ("below_c", "below", "apportion", "m2", 1.0, "hold", 0.0, "locked", "m1", "m1", False),
    ("prot_a", "protocol", "apportion", "m1", 0.5, None, None, None, "m0", "m2", False),
    ("oper_a", "operating", "terms", "m2", 0.125, None, None, None, None, None, False),
    ("below_a", "below", "level", None, None, "cash", 0.0, "all", None, None, True),
    ("below_b", "below", "none", None, None, "cash", 0.0, "all", None, None, False),
]
_SCHEMA = "line string, section string, kind string, metric string, weight double, bucket string, haircut double, base string, by_metric string, over_metric string, run_rate_level boolean"


def _sql(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


VALUES = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in LINES)
CTE = f"""
cfg(line, section, kind, metric, weight, bucket, haircut, base, by_metric, over_metric, rr) AS (VALUES {VALUES}),
ws AS (SELECT asset, metric, CASE WHEN count(*) FILTER (WHERE day > DATE '{END}' - {DAYS}) = {DAYS} THEN sum(value) FILTER (WHERE day > DATE '{END}' - {DAYS}) END AS total,
  CASE WHEN count(*) FILTER (WHERE day <= DATE '{END}' - {DAYS}) = {DAYS} THEN sum(value) FILTER (WHERE day <= DATE '{END}' - {DAYS}) END AS prior
  FROM fx_stmt_daily WHERE day <= DATE '{END}' AND day > DATE '{END}' - {2 * DAYS} GROUP BY asset, metric),
ln AS (SELECT a.asset, cfg.*, CASE WHEN rr THEN a.run_rate END AS level, CASE WHEN kind = 'apportion' AND o.total <> 0 THEN b.total / o.total END AS mix,
  m.total * CASE kind WHEN 'apportion' THEN weight * CASE WHEN o.total <> 0 THEN b.total / o.total END WHEN 'terms' THEN weight END AS term,
  m.prior * CASE kind WHEN 'apportion' THEN weight * CASE WHEN o.total <> 0 THEN b.total / o.total END WHEN 'terms' THEN weight END AS prior_term
  FROM fx_stmt_levels a, cfg LEFT JOIN ws m ON m.asset = a.asset AND m.metric = cfg.metric LEFT JOIN ws b ON b.asset = a.asset AND b.metric = by_metric LEFT JOIN ws o ON o.asset = a.asset AND o.metric = over_metric),
se AS (SELECT asset, section, CASE WHEN count(*) FILTER (WHERE kind NOT IN ('none', 'level') AND term IS NULL) = 0 THEN coalesce(sum(term ORDER BY line), 0) END AS terms,
  CASE WHEN count(*) FILTER (WHERE kind = 'level' AND level IS NULL) = 0 THEN coalesce(sum(level), 0) END AS levels,
  coalesce(string_agg(line, ',' ORDER BY line) FILTER (WHERE kind = 'none'), '') AS nm FROM ln GROUP BY asset, section),
st AS (SELECT *, terms * 365 / {DAYS} + levels AS measured, CASE WHEN nm = '' THEN terms * 365 / {DAYS} + levels END AS total FROM se),
pf AS (SELECT r.asset, r.total AS revenue, c.measured AS costs, (r.terms - c.terms) * 365 / {DAYS} + r.levels - c.levels AS base FROM st r JOIN st c ON c.asset = r.asset AND c.section = 'cost' WHERE r.section = 'revenue'),
gp AS (SELECT pf.*, CASE WHEN c.total IS NOT NULL THEN base END AS gross_profit FROM pf JOIN st c ON c.asset = pf.asset AND c.section = 'cost'),
hl0 AS (SELECT asset, line, section, kind, bucket, haircut, base, CASE kind WHEN 'level' THEN level ELSE term * 365 / {DAYS} END AS own, line <> 'below_c' AS unit,
  CASE WHEN line = 'hold_c' THEN (SELECT total FROM ws WHERE ws.asset = ln.asset AND ws.metric = 'm2') * 365 / {DAYS} WHEN kind = 'level' THEN level ELSE term * 365 / {DAYS} END AS gross FROM ln
  WHERE (section = 'holders' OR section = 'below' AND bucket IS NOT NULL)),
hl AS (SELECT h.asset, line, section, kind, bucket, own, unit, gross, gross * (1 - haircut) AS net,
  CASE WHEN CASE base WHEN 'all' THEN total_supply WHEN 'locked' THEN coalesce(locked, staked) ELSE staked END > 0 AND price > 0
    THEN gross * (1 - haircut) / (CASE base WHEN 'all' THEN total_supply WHEN 'locked' THEN coalesce(locked, staked) ELSE staked END * price) END AS yield FROM hl0 h JOIN fx_stmt_levels USING (asset)),
bu AS (SELECT asset, bucket, CASE WHEN count(*) FILTER (WHERE unit AND gross IS NULL) = 0 THEN sum(gross ORDER BY line) FILTER (WHERE unit) END AS gross, CASE WHEN count(*) FILTER (WHERE unit AND net IS NULL) = 0 THEN sum(net ORDER BY line) FILTER (WHERE unit) END AS net,
  CASE WHEN count(*) FILTER (WHERE unit AND yield IS NULL) = 0 THEN sum(yield ORDER BY line) FILTER (WHERE unit) END AS yield,
  CASE WHEN count(*) FILTER (WHERE section = 'below') > 0 THEN sum(own ORDER BY line) FILTER (WHERE section = 'below') ELSE 0 END AS from_below FROM hl WHERE NOT (section = 'below' AND kind = 'none') GROUP BY asset, bucket),
rl AS (SELECT asset, CASE WHEN count(x) = count(*) THEN sum(x) END AS released FROM (SELECT asset, CASE WHEN NOT capped THEN rate WHEN rate IS NOT NULL AND cap IS NOT NULL THEN least(rate, cap) END AS x FROM fx_stmt_releases) GROUP BY asset),
di AS (SELECT l.asset, emission + CASE WHEN r.asset IS NULL THEN 0 ELSE r.released END AS tokens, price, total_supply FROM fx_stmt_levels l LEFT JOIN rl r ON r.asset = l.asset),
dl AS (SELECT asset, tokens, CASE WHEN total_supply > 0 THEN tokens / total_supply END AS pct, CASE WHEN total_supply > 0 THEN tokens / total_supply END * (price * total_supply) AS usd FROM di)
---
"""


def _lines(spark, sf):
    levels = fx(spark, sf, "fx_stmt_levels")
    cfg = F.broadcast(spark.createDataFrame(LINES, _SCHEMA))  # configuration, a few rows
    return levels.select("asset", "run_rate").join(cfg, F.lit(True)).withColumn("level", F.when(F.col("run_rate_level"), F.col("run_rate"))).drop("run_rate", "run_rate_level")


def _values(spark, sf):
    return I.line_values(_lines(spark, sf), I.window_sums(fx(spark, sf, "fx_stmt_daily"), END, DAYS))


def _sections(spark, sf):
    return I.sections(_values(spark, sf), DAYS)


def _dilution(spark, sf):
    return I.dilution(fx(spark, sf, "fx_stmt_levels"), fx(spark, sf, "fx_stmt_releases"))


def _holder(spark, sf):
    return I.holder_lines(_values(spark, sf), fx(spark, sf, "fx_stmt_levels"), DAYS)


R = lambda c: f"round({c}, 6) AS {c}"


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("stmt_lines", CTE + f"SELECT asset, line, section, round(CASE kind WHEN 'level' THEN level ELSE term * 365 / {DAYS} END, 6) AS annualized FROM ln")
def stmt_lines(spark, sf):
    return _values(spark, sf).select("asset", "line", "section", F.round(I.annualized(DAYS), 6).alias("annualized"))


@query("stmt_apportion", CTE + "SELECT asset, line, round(mix, 9) AS mix FROM ln WHERE kind = 'apportion'")
def stmt_apportion(spark, sf):
    return _values(spark, sf).where("kind = 'apportion'").select("asset", "line", F.round("mix", 9).alias("mix"))


@query("stmt_sections", CTE + f"SELECT asset, section, {R('measured')}, {R('total')}, nm AS not_measured FROM st")
def stmt_sections(spark, sf):
    return _r(_sections(spark, sf), "measured", "total").select("asset", "section", "measured", "total", "not_measured")


@query("stmt_revenue_growth", CTE + f"""
SELECT asset, round(CASE WHEN count(term) = count(*) THEN sum(term) END * 365 / {DAYS}, 6) AS annualized, round(CASE WHEN count(term) = count(*) AND count(prior_term) = count(*) AND sum(prior_term) > 0 THEN sum(term) / sum(prior_term) - 1 END, 9) AS change
FROM ln WHERE section = 'revenue' AND line <> 'rev_c' GROUP BY asset""")
def stmt_revenue_growth(spark, sf):
    s = I.sections(_values(spark, sf).where("section = 'revenue' and line <> 'rev_c'"), DAYS)
    return s.select("asset", F.round("total", 6).alias("annualized"), F.round(F.when(F.col("prior") > 0, F.col("terms") / F.col("prior") - 1), 9).alias("change"))


@query("stmt_gross_profit", CTE + f"SELECT asset, {R('revenue')}, {R('costs')}, {R('gross_profit')}, {R('base')} FROM gp")
def stmt_gross_profit(spark, sf):
    return _r(I.profit(_sections(spark, sf), DAYS), "revenue", "costs", "gross_profit", "base").select("asset", "revenue", "costs", "gross_profit", "base")


_USES = CTE + f"""
SELECT pf.asset, round(h.total, 6) AS holders, {{prot}} AS protocol, round(o.total, 6) AS operating, {{left}} AS unreconciled
FROM pf JOIN st h ON h.asset = pf.asset AND h.section = 'holders' JOIN st p ON p.asset = pf.asset AND p.section = 'protocol' JOIN st o ON o.asset = pf.asset AND o.section = 'operating'"""


@query("stmt_uses", _USES.format(prot="round(p.total, 6)", left=f"round(base - (h.terms + p.terms + o.terms) * 365 / {DAYS} - h.levels - p.levels - o.levels, 6)"))
def stmt_uses(spark, sf):
    return _r(I.uses(_sections(spark, sf), DAYS, cancels=I.cancelling(_values(spark, sf))), "holders", "protocol", "operating", "unreconciled")


#: Uses that pass on revenue whole, with weights that doubles don't hold exactly.
PASSED_ON = [
    ("rev_a", "revenue", "terms", "m0", 0.1, None, None, None, None, None, False),
    ("rev_b", "revenue", "terms", "m1", 0.3, None, None, None, None, None, False),
    ("rev_c", "revenue", "terms", "m1", 0.7, None, None, None, None, None, False),
    ("hold_a", "holders", "terms", "m1", 0.3, "burn", 0.0, "all", None, None, False),
    ("prot_a", "protocol", "terms", "m0", 0.1, None, None, None, None, None, False),
    ("oper_a", "operating", "terms", "m1", 0.7, None, None, None, None, None, False),
]


@query("stmt_cancels", f"""
w AS (SELECT asset, count(*) FILTER (WHERE metric = 'm0') AS n0, count(*) FILTER (WHERE metric = 'm1') AS n1 FROM fx_stmt_daily WHERE day <= DATE '{END}' AND day > DATE '{END}' - {DAYS} GROUP BY asset)
---
SELECT l.asset, CASE WHEN n0 = {DAYS} AND n1 = {DAYS} THEN 0.0::DOUBLE END AS unreconciled FROM fx_stmt_levels l LEFT JOIN w USING (asset)""")
def stmt_cancels(spark, sf):
    """Exactly 0, not about 0: terms cancel before any sum is rounded."""
    daily = fx(spark, sf, "fx_stmt_daily").withColumn("value", F.col("value") * 0.1)
    cfg = F.broadcast(spark.createDataFrame(PASSED_ON, _SCHEMA))  # configuration, a few rows
    lines = fx(spark, sf, "fx_stmt_levels").select("asset", F.lit(None).cast("double").alias("level")).join(cfg, F.lit(True)).drop("run_rate_level")
    values = I.line_values(lines, I.window_sums(daily, END, DAYS))
    return I.uses(I.sections(values, DAYS), DAYS, cancels=I.cancelling(values)).select("asset", "unreconciled")


@query("stmt_remainder", _USES.format(prot="round(base - h.total - o.total, 6)", left="CASE WHEN base IS NOT NULL AND h.total IS NOT NULL AND o.total IS NOT NULL THEN 0.0::DOUBLE END"))
def stmt_remainder(spark, sf):
    return _r(I.uses(_sections(spark, sf), DAYS, "protocol"), "holders", "protocol", "operating", "unreconciled")


@query("stmt_holder_flow", CTE + "SELECT asset, line, section, unit, round(own, 5) AS gross, round(CASE WHEN unit THEN net END, 5) AS net, round(CASE WHEN unit THEN yield END, 9) AS yield FROM hl")
def stmt_holder_flow(spark, sf):
    rows = _holder(spark, sf).withColumns({c: F.when(F.col("unit"), F.col(c)) for c in ("net", "yield")})
    return rows.select("asset", "line", "section", "unit", F.round("gross", 5).alias("gross"), F.round("net", 5).alias("net"), F.round("yield", 9).alias("yield"))


@query("stmt_by_bucket", CTE + "SELECT asset, bucket, round(gross, 5) AS gross, round(net, 5) AS net, round(yield, 9) AS yield, round(from_below, 5) AS from_below FROM bu")
def stmt_by_bucket(spark, sf):
    return I.by_bucket(_holder(spark, sf)).withColumns({"gross": F.round("gross", 5), "net": F.round("net", 5), "yield": F.round("yield", 9), "from_below": F.round("from_below", 5)})


@query("stmt_dilution", CTE + "SELECT asset, tokens, round(pct, 9) AS pct, round(usd, 5) AS usd FROM dl")
def stmt_dilution(spark, sf):
    return _dilution(spark, sf).select("asset", "tokens", F.round("pct", 9).alias("pct"), F.round("usd", 5).alias("usd"))


@query("stmt_supply_flow", CTE + f"""
SELECT di.asset, round(total * 365 / {DAYS}, 5) AS burned, tokens AS added, round(tokens - total * 365 / {DAYS}, 5) AS net, round((tokens - total * 365 / {DAYS}) / total_supply, 9) AS net_pct FROM di LEFT JOIN ws ON ws.asset = di.asset AND metric = 'm3'""")
def stmt_supply_flow(spark, sf):
    levels = fx(spark, sf, "fx_stmt_levels")
    burned = I.window_sums(fx(spark, sf, "fx_stmt_daily"), END, DAYS).where("metric = 'm3'").select("asset", I.to_year(F.col("total"), DAYS).alias("burned"))
    rows = _dilution(spark, sf).join(levels.select("asset", "total_supply"), "asset").join(burned, "asset", "left").withColumn("net", F.col("tokens") - F.col("burned"))
    return rows.select("asset", F.round("burned", 5).alias("burned"), F.col("tokens").alias("added"), F.round("net", 5).alias("net"), F.round(F.when(F.col("total_supply") > 0, F.col("net") / F.col("total_supply")), 9).alias("net_pct"))


_YIELD = CTE.removesuffix("\n---\n").rstrip("-\n ") + f""",
gr AS (SELECT asset, CASE WHEN count(term) = count(*) AND count(prior_term) = count(*) AND sum(prior_term) > 0 THEN pow(sum(term) / sum(prior_term), CAST(365 AS DOUBLE) / {DAYS}) - 1 END AS g FROM ln WHERE line = 'rev_a' GROUP BY asset),
yi AS (SELECT d.asset, max(yield) FILTER (WHERE bucket = 'cash') AS cash, max(yield) FILTER (WHERE bucket = 'burn') + max(yield) FILTER (WHERE bucket = 'hold') AS buyback, any_value(pct) AS pct, any_value(g) AS g FROM dl d JOIN bu USING (asset) JOIN gr USING (asset) GROUP BY d.asset)
---
SELECT asset, round(cash, 9) AS cash, round(buyback, 9) AS buyback, round(cash + buyback, 9) AS shareholder, round(pct, 9) AS dilution, round(cash + buyback - pct, 9) AS net_shareholder,
  round(CASE WHEN cash + buyback > 0 THEN 1 / (cash + buyback) END, 6) AS multiple, round(CASE WHEN g > 0 AND cash + buyback > 0 THEN 1 / (cash + buyback) / (g * 100) END, 6) AS peg FROM yi"""


@query("stmt_yields", _YIELD)
def stmt_yields(spark, sf):
    s = I.sections(_values(spark, sf).where("line = 'rev_a'"), DAYS)
    growth = s.select("asset", F.when(F.col("prior") > 0, F.pow(F.col("terms") / F.col("prior"), F.lit(365 / DAYS)) - 1).alias("annualized"))
    y = I.yields(I.by_bucket(_holder(spark, sf)), _dilution(spark, sf), growth)
    return y.withColumns({c: F.round(c, 6 if c in ("multiple", "peg") else 9) for c in y.columns if c != "asset"})


@query("stmt_ratios", CTE + """
SELECT gp.asset, round(CASE WHEN revenue > 0 THEN gross_profit / revenue END, 9) AS take_rate, round(CASE WHEN gross_profit IS NOT NULL THEN CASE WHEN gross_profit > 0 THEN h.total / gross_profit END ELSE CASE WHEN revenue > 0 THEN h.total / revenue END END, 9) AS payout,
  CASE WHEN gross_profit IS NOT NULL THEN 'gross profit' ELSE 'revenue' END AS basis FROM gp JOIN st h ON h.asset = gp.asset AND h.section = 'holders'""")
def stmt_ratios(spark, sf):
    found = _sections(spark, sf)
    p = I.profit(found, DAYS).join(found.where("section = 'holders'").select("asset", F.col("total").alias("holders")), "asset")
    known = F.col("gross_profit").isNotNull()
    payout = F.when(known, I.divided(F.col("holders"), F.col("gross_profit"))).otherwise(I.divided(F.col("holders"), F.col("revenue")))
    return p.select("asset", F.round(I.divided(F.col("gross_profit"), F.col("revenue")), 9).alias("take_rate"), F.round(payout, 9).alias("payout"), F.when(known, "gross profit").otherwise("revenue").alias("basis"))


def _net(spark, sf):
    b = I.by_bucket(_holder(spark, sf))
    return b.groupBy("asset").agg(F.when(F.count("net") == F.count("*"), F.sum("net")).alias("net"))


@query("stmt_multiples", CTE + """
SELECT l.asset, price * circulating AS mcap, round(CASE WHEN revenue > 0 THEN price * circulating / revenue END, 9) AS mcap_to_revenue, round(CASE WHEN gross_profit > 0 THEN price * circulating / gross_profit END, 9) AS mcap_to_gross_profit,
  round(CASE WHEN n.net > 0 THEN price * circulating / n.net END, 9) AS mcap_to_net
FROM fx_stmt_levels l JOIN gp USING (asset) JOIN (SELECT asset, CASE WHEN count(net) = count(*) THEN sum(net) END AS net FROM bu GROUP BY asset) n USING (asset)""")
def stmt_multiples(spark, sf):
    m = I.multiples(fx(spark, sf, "fx_stmt_levels"), I.profit(_sections(spark, sf), DAYS), _net(spark, sf))
    return m.withColumns({c: F.round(c, 9) for c in m.columns if c.startswith("mcap_to")})


@query("stmt_per_token", CTE + """
SELECT l.asset, s.supply, round(CASE WHEN s.n > 0 THEN revenue / s.n END, 9) AS revenue, round(CASE WHEN s.n > 0 THEN gross_profit / s.n END, 9) AS gross_profit, round(CASE WHEN s.n > 0 THEN usd / s.n END, 9) AS usd
FROM (SELECT asset, 'circulating' AS supply, circulating AS n FROM fx_stmt_levels UNION ALL SELECT asset, 'total', total_supply FROM fx_stmt_levels) s JOIN fx_stmt_levels l USING (asset) JOIN gp USING (asset) JOIN dl USING (asset)""")
def stmt_per_token(spark, sf):
    levels = fx(spark, sf, "fx_stmt_levels")
    p = I.per_token(levels, I.profit(_sections(spark, sf), DAYS), _dilution(spark, sf))
    return p.withColumns({c: F.round(c, 9) for c in ("revenue", "gross_profit", "usd")})


@query("stmt_volume", CTE + f"SELECT asset, round(CASE WHEN count(total) = count(*) THEN sum(total) END * 365 / {DAYS}, 6) AS annualized FROM ws WHERE metric IN ('m1', 'm3') GROUP BY asset")
def stmt_volume(spark, sf):
    s = I.window_sums(fx(spark, sf, "fx_stmt_daily"), END, DAYS).where("metric in ('m1', 'm3')")
    return s.groupBy("asset").agg(F.round(I.to_year(F.when(F.count("total") == F.count("*"), F.sum("total")), DAYS), 6).alias("annualized"))


@query("stmt_method_split", f"""
SELECT asset, method, round(v / sum(v) OVER (PARTITION BY asset), 9) AS share FROM (
  SELECT asset, CASE WHEN id % 3 = 0 THEN 'measured' ELSE 'disclosed' END AS method, sum(value) AS v FROM fx_stmt_daily WHERE day > DATE '{END}' - {DAYS} AND day <= DATE '{END}' GROUP BY 1, 2)""")
def stmt_method_split(spark, sf):
    rows = fx(spark, sf, "fx_stmt_daily").where(f"day > date_sub(date'{END}', {DAYS}) and day <= date'{END}'")
    part = rows.groupBy("asset", F.expr("if(id % 3 = 0, 'measured', 'disclosed')").alias("method")).agg(F.sum("value").alias("v"))
    whole = part.groupBy("asset").agg(F.sum("v").alias("w"))
    return part.join(whole, "asset").select("asset", "method", F.round(F.col("v") / F.col("w"), 9).alias("share"))


@query("stmt_header", "SELECT asset, price, price * circulating AS mcap, price * total_supply AS fdv FROM fx_stmt_levels")
def stmt_header(spark, sf):
    return fx(spark, sf, "fx_stmt_levels").select("asset", "price", (F.col("price") * F.col("circulating")).alias("mcap"), (F.col("price") * F.col("total_supply")).alias("fdv"))


@query("stmt_flags", CTE + """
SELECT st.asset, array_to_string(list_filter([CASE WHEN bool_or(section = 'revenue' AND measured IS NULL) THEN 'revenue incomplete' END, CASE WHEN string_agg(nm, '') <> '' THEN 'lines not measured' END, CASE WHEN any_value(circulating) IS NULL THEN 'no circulating supply' END], lambda x: x IS NOT NULL), '; ') AS flags
FROM st JOIN fx_stmt_levels USING (asset) GROUP BY st.asset""")
def stmt_flags(spark, sf):
    s = _sections(spark, sf).groupBy("asset").agg(F.bool_or((F.col("section") == "revenue") & F.col("measured").isNull()).alias("a"), F.bool_or(F.col("not_measured") != "").alias("b"))
    s = s.join(fx(spark, sf, "fx_stmt_levels").select("asset", "circulating"), "asset")
    flags = F.array_compact(F.array(F.when(F.col("a"), "revenue incomplete"), F.when(F.col("b"), "lines not measured"), F.when(F.col("circulating").isNull(), "no circulating supply")))
    return s.select("asset", F.array_join(flags, "; ").alias("flags"))


@query("stmt_reported_growth", f"""
w AS (SELECT asset, metric, sum(value) FILTER (WHERE day > DATE '{END}' - {DAYS}) AS cur, sum(value) FILTER (WHERE day <= DATE '{END}' - {DAYS}) AS pri, count(*) AS n FROM fx_stmt_daily WHERE day <= DATE '{END}' AND day > DATE '{END}' - {2 * DAYS} GROUP BY 1, 2)
---
SELECT asset, metric, CASE WHEN n = {2 * DAYS} AND pri > 0 THEN cur / pri - 1 END AS change FROM w""")
def stmt_reported_growth(spark, sf):
    sums = I.window_sums(fx(spark, sf, "fx_stmt_daily"), END, DAYS)
    return sums.select("asset", "metric", F.when(F.col("prior") > 0, F.col("total") / F.col("prior") - 1).alias("change"))


@query("stmt_summary", _YIELD.rpartition("---")[0] + f"""---
SELECT l.asset, DATE '{END}' AS day, {DAYS} AS window_days, price, price * circulating AS market_cap, price * l.total_supply AS fdv, round(revenue, 6) AS revenue, round(gross_profit, 6) AS gross_profit, round(b.net, 5) AS burn_net, round(h.net, 5) AS hold_net, round(c.net, 5) AS cash_net,
  round(cash + buyback, 9) AS shareholder, round(pct, 9) AS dilution, round(cash + buyback - pct, 9) AS net_shareholder, round(CASE WHEN cash + buyback > 0 THEN 1 / (cash + buyback) END, 6) AS multiple, round(CASE WHEN revenue > 0 THEN price * circulating / revenue END, 9) AS mcap_to_revenue
FROM fx_stmt_levels l JOIN gp USING (asset) JOIN yi USING (asset) JOIN bu b ON b.asset = l.asset AND b.bucket = 'burn' JOIN bu h ON h.asset = l.asset AND h.bucket = 'hold' JOIN bu c ON c.asset = l.asset AND c.bucket = 'cash'""")
def stmt_summary(spark, sf):
    levels, found = fx(spark, sf, "fx_stmt_levels"), _sections(spark, sf)
    p, b = I.profit(found, DAYS), I.by_bucket(_holder(spark, sf))
    none = levels.select("asset", F.lit(None).cast("double").alias("annualized"))
    s = P.summary(levels, p, b, I.yields(b, _dilution(spark, sf), none), I.multiples(levels, p, _net(spark, sf)), END, DAYS)
    s = s.select("asset", "day", "window_days", "price", F.col("mcap").alias("market_cap"), "fdv", "revenue", "gross_profit", "burn_net", "hold_net", "cash_net", "shareholder", "dilution", "net_shareholder", "multiple", "mcap_to_revenue")
    places = {"revenue": 6, "gross_profit": 6, "burn_net": 5, "hold_net": 5, "cash_net": 5, "shareholder": 9, "dilution": 9, "net_shareholder": 9, "multiple": 6, "mcap_to_revenue": 9}
    return s.withColumns({c: F.round(c, n) for c, n in places.items()})


#: What the metrics of the readings are, for narrow(); level.4 is not declared.
KINDS = [("level.0", "level", None), ("level.1", "schedule", None), ("level.2", "event", None), ("level.3", "flow", 3)]


@query("narrow_usable", """
n AS (SELECT asset_id, metric_key, max(hour) AS hi, arg_max(id, struct_pack(h := hour, i := id)) AS newest FROM fx_readings WHERE hour <= 400 GROUP BY asset_id, metric_key)
---
SELECT r.id, r.asset_id, r.metric_key, r.hour, r.value FROM fx_readings r LEFT JOIN n USING (asset_id, metric_key)
WHERE metric_key = 'level.0' AND id = newest OR metric_key = 'level.1' AND (id = newest OR hour > 400) OR metric_key = 'level.2' AND hour > 400 OR metric_key = 'level.3' AND hour <= 400 AND hour > hi - 96""")
def narrow_usable(spark, sf):
    rows = fx(spark, sf, "fx_readings")
    cfg = F.broadcast(spark.createDataFrame(KINDS, "metric_key string, kind string, window_days int"))  # configuration, a few rows
    metrics = rows.select("asset_id").distinct().join(cfg, F.lit(True))
    return P.narrow(rows, metrics, 400).select("id", "asset_id", "metric_key", "hour", "value")


@query("report_levels", """
d AS (SELECT asset, day, count(DISTINCT metric) AS n FROM fx_stmt_daily GROUP BY asset, day), l AS (SELECT asset, max(day) AS day FROM d WHERE n = 4 GROUP BY asset)
---
SELECT l.asset AS asset_id, l.day, r.metric_key, arg_max(r.value, struct_pack(h := r.hour, i := r.id)) AS value, max(r.hour) AS hour, count(*) AS n FROM l JOIN fx_readings r ON r.asset_id = l.asset
WHERE r.status = 'confirmed' AND r.superseded_by IS NULL AND r.hour < extract(doy FROM l.day) * 24 + 24 GROUP BY l.asset, l.day, r.metric_key""")
def report_levels(spark, sf):
    """Levels as of the report day of each asset, the last one on which all its series have a value."""
    daily = fx(spark, sf, "fx_stmt_daily")
    series = fx(spark, sf, "fx_stmt_levels").select("asset", F.explode(F.array(*map(F.lit, ("m0", "m1", "m2", "m3")))).alias("metric"))
    days = P.report_day(daily, series).select(F.col("asset").alias("asset_id"), "day", (F.dayofyear("day") * 24).cast("long").alias("end_hour"))
    return P.levels_as_of(fx(spark, sf, "fx_readings"), days).join(days.select("asset_id", "day"), "asset_id").select("asset_id", "day", "metric_key", "value", "hour", "n")


@query("window_totals", "SELECT metric, day, w AS window, round(t, 6) AS total FROM (" + " UNION ALL ".join(f"SELECT metric, day, {n} AS w, CASE WHEN count(*) OVER w = {n} THEN sum(value) OVER w END AS t FROM fx_daily WINDOW w AS (PARTITION BY metric ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)" for n in (7, 30, 91)) + ") WHERE t IS NOT NULL")
def window_totals(spark, sf):
    """Windows of three lengths to every day of every series."""
    return P.window_totals(fx(spark, sf, "fx_daily"), [7, 30, 91], "metric").withColumn("total", F.round("total", 6))


_LEVELS = ("price", "total_supply", "circulating", "staked", "locked", "emission", "run_rate")
_STMT_READINGS = "SELECT event_id AS id, event_type AS asset_id, " + "CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_LEVELS)) + """ END AS metric_key, hour, v + 1 AS value,
  CASE WHEN event_id % 9 = 0 THEN 'rejected' ELSE 'confirmed' END AS status, CASE WHEN event_id % 10 = 3 THEN event_id + 7 END AS superseded_by FROM {fx_events}"""
_REPORTS = "SELECT DISTINCT asset, day FROM {fx_stmt_daily} WHERE day >= DATE '2024-01-14'"


@query("statement_days", f"""
w AS ({_REPORTS.replace("{fx_stmt_daily}", "fx_stmt_daily")}),
sd AS (SELECT concat(w.asset, '@', w.day) AS asset, d.metric, DATE '{END}' - (w.day - d.day)::INTEGER AS day, d.value FROM w JOIN fx_stmt_daily d ON d.asset = w.asset AND d.day <= w.day AND d.day > w.day - {2 * DAYS}),
rr AS ({_STMT_READINGS.replace("{fx_events}", "fx_events")}),
lr AS (SELECT concat(w.asset, '@', w.day) AS asset, metric_key, arg_max(value, struct_pack(h := hour, i := id)) AS value FROM w JOIN rr ON asset_id = w.asset AND status = 'confirmed' AND superseded_by IS NULL AND hour < extract(doy FROM w.day) * 24 + 24 GROUP BY 1, 2),
lv AS (SELECT concat(w.asset, '@', w.day) AS asset, {", ".join(f"max(value) FILTER (WHERE metric_key = '{m}') AS {m}" for m in _LEVELS)} FROM w LEFT JOIN lr ON lr.asset = concat(w.asset, '@', w.day) GROUP BY 1),
""" + CTE.replace("fx_stmt_levels", "lv").replace("fx_stmt_daily", "sd").replace(", rl AS", ", rl0 AS").replace("---", "") .rsplit("rl AS", 1)[0].rstrip().rstrip(",") + f""",
od AS (SELECT asset, max(day) AS day FROM (SELECT asset, day FROM fx_stmt_daily GROUP BY asset, day HAVING count(DISTINCT metric) = 4) GROUP BY asset)
---
SELECT w.asset, w.day, w.day = od.day AS own_day, round(gp.revenue, 6) AS revenue, round(gp.gross_profit, 6) AS gross_profit, round(h.total, 6) AS holders, round(p.total, 6) AS protocol, round(o.total, 6) AS operating,
  round(gp.base - (h.terms + p.terms + o.terms) * 365 / {DAYS} - h.levels - p.levels - o.levels, 6) AS unreconciled, round(lv.price * lv.circulating, 6) AS mcap, round(lv.price * lv.total_supply, 6) AS fdv
FROM w JOIN od USING (asset) JOIN lv ON lv.asset = concat(w.asset, '@', w.day) JOIN gp ON gp.asset = lv.asset JOIN st h ON h.asset = lv.asset AND h.section = 'holders' JOIN st p ON p.asset = lv.asset AND p.section = 'protocol' JOIN st o ON o.asset = lv.asset AND o.section = 'operating'""")
def statement_days(spark, sf):
    """Statements as of every day of every asset in one plan, with levels as of each; own_day marks the asset's report day."""
    daily = fx(spark, sf, "fx_stmt_daily")
    reports = spark.sql(_REPORTS, fx_stmt_daily=daily).select(F.concat_ws("@", "asset", "day").alias("report"), "asset", "day")
    series = daily.select("asset").distinct().select("asset", F.explode(F.array(*map(F.lit, ("m0", "m1", "m2", "m3")))).alias("metric"))
    own = P.report_day(daily, series).select("asset", F.col("day").alias("own"))
    read = P.levels_at(spark.sql(_STMT_READINGS, fx_events=fx(spark, sf, "fx_events")), reports.select("report", F.col("asset").alias("asset_id"), (F.dayofyear("day") * 24).alias("end_hour")))
    levels = read.groupBy(F.col("report").alias("asset")).agg(*(F.max(F.when(F.col("metric_key") == m, F.col("value"))).alias(m) for m in _LEVELS))
    levels = reports.select(F.col("report").alias("asset")).join(levels, "asset", "left")
    cfg = F.broadcast(spark.createDataFrame(LINES, _SCHEMA))  # configuration, a few rows
    lines = levels.select("asset", "run_rate").join(cfg, F.lit(True)).withColumn("level", F.when(F.col("run_rate_level"), F.col("run_rate"))).drop("run_rate", "run_rate_level")
    found = I.sections(I.line_values(lines, P.sums_at(daily, reports, DAYS)), DAYS)
    out = reports.join(own, "asset").join(levels.withColumnRenamed("asset", "report"), "report")
    for part in (I.profit(found, DAYS).select("asset", "revenue", "gross_profit"), I.uses(found, DAYS)):
        out = out.join(part.withColumnRenamed("asset", "report"), "report")
    out = out.withColumns({"own_day": F.col("day") == F.col("own"), "mcap": F.col("price") * F.col("circulating"), "fdv": F.col("price") * F.col("total_supply")})
    return _r(out, "revenue", "gross_profit", "holders", "protocol", "operating", "unreconciled", "mcap", "fdv").select("asset", "day", "own_day", "revenue", "gross_profit", "holders", "protocol", "operating", "unreconciled", "mcap", "fdv")
