"""Rules over declared configuration, as tables: closures of references, cycles, listing bars, and scans of config files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.flows import shared_folder


def closure(spark: SparkSession, start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node) of every node that is reached from start (origin, node) by edges (node, input) in any number of
    steps, the start's own included. Each step goes on from what the step before reached for the first time, so cycles
    end; its rows are written to the shared folder, and there are as many steps as the longest chain has links."""
    folder, step = shared_folder(spark, "closure"), 0
    schema = start.select("origin", "node").schema
    start.select("origin", "node").distinct().write.parquet(f"{folder}/step={step:06}")
    while True:
        last = spark.read.schema(schema).parquet(f"{folder}/step={step:06}")
        if not last.limit(1).count():
            return spark.read.schema(schema).parquet(f"{folder}/step=*")
        seen = spark.read.schema(schema).parquet(f"{folder}/step=*")
        near = last.join(edges.where("input is not null").hint("merge"), "node")  # a broadcast would go through the driver once a step
        near = near.select("origin", F.col("input").alias("node")).distinct()
        step += 1
        near.join(seen.hint("merge"), ["origin", "node"], "left_anti").write.parquet(f"{folder}/step={step:06}")


def failing_lines(lines: DataFrame, metrics: DataFrame, allowed: list[str]) -> DataFrame:
    """line, source_type of the lines (line, metrics: array) that miss the listing bar: no metric, or a metric whose type
    (metric, source_type) isn't allowed; source_type is that of the first such metric, null without any."""
    each = lines.select("line", F.posexplode_outer("metrics").alias("place", "metric"))
    known = each.join(metrics, "metric", "left")
    fails = F.col("metric").isNull() | F.col("source_type").isNull() | ~F.col("source_type").isin(allowed)
    return known.where(fails).groupBy("line").agg(F.min_by("source_type", "place").alias("source_type"))


def level_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics that the hourly run reads: levels and schedules with a source that is read, and of those only shown just the
    watched ones."""
    read = F.col("source").isNotNull() & ~F.col("source").isin("derived", "constant")
    return metrics.where(F.col("kind").isin("level", "schedule") & read & (~F.col("monitor_only") | F.col("watched"))).select("metric")


def named_metrics(lines: DataFrame, *columns: str) -> DataFrame:
    """The distinct metrics that lines name in any of the columns."""
    return lines.select(F.explode(F.array_compact(F.array(*columns))).alias("metric")).distinct()


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """name, config, digest, fault of the JSON config files at path: the parsed text, the SHA-256 of the whole text, and
    why a file is refused (no text, or not of the schema), null if it isn't."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("name"), "value")
    config = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    first = schema.split()[0]
    fault = F.when(F.trim("value") == "", "empty").when(config.isNull() | config[first].isNull(), "not of the schema")
    return files.select("name", config.alias("config"), F.sha2("value", 256).alias("digest"), fault.alias("fault"))


def market_values(body: Column) -> Column:
    """Rows (id, current_price, market_cap, circulating_supply, total_supply) of a markets reply; null if it is no list."""
    return F.from_json(body, "array<struct<id:string,current_price:double,market_cap:double,circulating_supply:double,total_supply:double>>")


def line_issues(lines: DataFrame, metrics: DataFrame, parts: DataFrame) -> DataFrame:
    """line, issue of every rule that a statement's lines (line, section, metric, level, not_measured, weight, by_metric,
    over_metric) break against the declared metrics (metric, kind, unit) and the parts of totals (total, part):
    ids are unique, each line has one source of its value, metrics are declared and flows in usd, levels are levels, a
    series is read once as revenue, weights lie in (0, 1], and lines that share a total cover its parts, each once."""
    say = lambda rows, issue: rows.select("line", F.lit(issue).alias("issue"))
    sources = sum((F.col(c).isNotNull().cast("int") for c in ("metric", "level")), F.coalesce(F.col("not_measured"), F.lit(False)).cast("int"))
    named = lines.select("line", F.explode(F.array_compact(F.array("metric", "by_metric", "over_metric"))).alias("metric")).join(metrics, "metric", "left")
    level = lines.where("level is not null").join(metrics.select(F.col("metric").alias("level"), "kind"), "level", "left")
    twice = lines.where("section = 'revenue' and metric is not null and over_metric is null").groupBy("metric").agg(F.count("*").alias("n"), F.max("line").alias("line"))
    shared = lines.where("over_metric is not null").groupBy(F.col("over_metric").alias("total"), "metric").agg(F.sort_array(F.collect_list("by_metric")).alias("given"), F.min("line").alias("line"))  # lines of a total
    whole = parts.groupBy("total").agg(F.sort_array(F.collect_list("part")).alias("due"))
    found = [
        say(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "id is not unique"),
        say(lines.where(sources != 1), "needs one source of its value"),
        say(named.where("kind is null"), "metric is not declared"),
        say(named.where("kind is not null and (kind <> 'flow' or unit <> 'usd')"), "metric is no flow in usd"),
        say(level.where("kind is null or kind <> 'level'"), "level is no level"),
        say(twice.where("n > 1"), "series is read twice"),
        say(lines.where("weight is not null and not (weight > 0 and weight <= 1)"), "weight outside (0, 1]"),
        say(shared.join(whole, "total", "left").where(~F.col("given").eqNullSafe(F.col("due"))), "parts do not make up the total"),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out.distinct()
