"""Differences of JSON reports, leaf by leaf, with a list of what may differ."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def _leaves(x: object, path: str) -> list[tuple[str, str]]:
    """Paths and values as JSON. Lists whose members all have an id of their own go by it, others by place."""
    if isinstance(x, dict) and x:
        return [y for k, v in x.items() for y in _leaves(v, f"{path}.{k}" if path else k)]
    if isinstance(x, list) and x:
        ids = [v.get("id") if isinstance(v, dict) else None for v in x]
        named = None not in ids and len(set(map(str, ids))) == len(ids)
        return [y for i, v in enumerate(x) for y in _leaves(v, f"{path}[{ids[i] if named else i}]")]
    return [(path or "$", json.dumps(x, ensure_ascii=False))]


@pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def leaves(report: pd.Series) -> pd.Series:
    """Of a JSON text: its leaves; none of a null."""
    return report.map(lambda t: [] if t is None else _leaves(json.loads(t), ""), na_action=None)


def report_differences(old: DataFrame, new: DataFrame, allowed: DataFrame, *key: str) -> DataFrame:
    """The leaves of reports (key, report) that differ, with kind (added, removed, changed) and allowed: whether some entry
    (glob, rel, abs: configuration) matches the path and each that does holds. An entry without bounds always holds; one
    with bounds holds for a change of numbers within one of them. Numbers are equal by value."""
    flat = lambda df, c: df.select(*key, F.explode(leaves("report")).alias("l")).select(*key, "l.path", F.col("l.value").alias(c))
    both = flat(old, "old").join(flat(new, "new"), [*key, "path"], "full")
    a, b = F.col("old").try_cast("double"), F.col("new").try_cast("double")
    numbers = a.isNotNull() & b.isNotNull()
    same = F.when(numbers, a == b).otherwise(F.col("old").eqNullSafe(F.col("new")))
    rows = both.where(~same).withColumns({"kind": F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"), "gap": F.when(numbers, F.abs(a - b)), "scale": F.abs(a)})
    pattern = F.concat(F.lit("^"), F.replace(F.regexp_replace("glob", r"([.\[\](){}+?^$|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    entries = F.broadcast(allowed.select(pattern.alias("pattern"), "rel", "abs"))  # configuration, a few rows
    within = (F.col("abs").isNotNull() & (F.col("gap") <= F.col("abs"))) | (F.col("rel").isNotNull() & (F.col("gap") <= F.col("rel") * F.col("scale")))
    holds = (F.col("rel").isNull() & F.col("abs").isNull()) | F.coalesce(within, F.lit(False))
    met = rows.join(entries, F.expr("path rlike pattern"), "left")
    return met.groupBy(*key, "path", "kind", "old", "new").agg(F.coalesce(F.bool_and(F.when(F.col("pattern").isNotNull(), holds)), F.lit(False)).alias("allowed"))
