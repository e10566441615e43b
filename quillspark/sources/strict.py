"""Config files read strictly: every unknown key, wrong type, missing entry and value out of bounds is reported with its path.

Files are parsed to VARIANT and walked level by level: a level's values meet the schema's rules (a table) by their place in
it, and only what the schema knows is opened further, so there are as many steps as the schema is deep, over all files
at once. Between levels a value is JSON text: as VARIANT each would carry the names of its whole file.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..streaming.flows import saved

try:
    import yaml
except ImportError:  # JSON files need none
    yaml = None


class Rule(NamedTuple):
    """What may stand at a place. place: keys with dots between, * for any key of an object, [] for an entry of a list.
    kind: object, list, string, number, integer, boolean; several with | between."""

    place: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] | None = None
    pattern: str | None = None
    fewest: int | None = None


_RULE = "place string, kind string, required boolean, low double, high double, choices array<string>, pattern string, fewest int"


def parent(place: str) -> str | None:
    """The place that holds this one; None of the whole document."""
    if not place:
        return None
    if place.endswith("[]"):
        return place[:-2]
    return place.rpartition(".")[0]


def _yaml_value(text: str, for_json: bool = False) -> object:
    """The value of a YAML text, as yaml.safe_load() gives it, built while it is read: no node of it is kept. for_json: names
    are texts, and a number that JSON has no form for is null, which no rule allows."""
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(text)
    anchors: dict[str, object] = {}

    def scalar(event: yaml.ScalarEvent, key: bool = False) -> object:
        tag = event.tag if event.tag not in (None, "!") else loader.resolve(yaml.ScalarNode, event.value, event.implicit)
        if key and tag == "tag:yaml.org,2002:merge":
            return ...
        if key and tag == "tag:yaml.org,2002:value":
            return event.value
        loader.constructed_objects.clear()
        try:
            return loader.construct_object(yaml.ScalarNode(tag, event.value))
        except (ValueError, LookupError, AttributeError, TypeError) as e:  # what PyYAML lets pass: 2024-13-45, !!bool maybe
            raise yaml.YAMLError("a value that doesn't fit its tag") from e

    def fit(value: object) -> object:
        return None if for_json and isinstance(value, float) and not math.isfinite(value) else value

    def fit_name(name: object) -> object:
        if isinstance(name, (dict, list)):
            raise yaml.YAMLError("a name that is no scalar")
        if not for_json or isinstance(name, str):
            return name
        return json.dumps(name) if name is None or isinstance(name, (int, float)) else str(name)

    def named(event: yaml.NodeEvent, value: object) -> object:
        if event.anchor is not None:
            if event.anchor in anchors:
                raise yaml.YAMLError("an anchor is given twice")
            anchors[event.anchor] = value
        return value

    def one(event: yaml.Event, key: bool = False) -> object:
        if isinstance(event, yaml.AliasEvent):
            if event.anchor not in anchors:
                raise yaml.YAMLError("an alias without its anchor")
            return anchors[event.anchor]
        if isinstance(event, yaml.ScalarEvent):
            return named(event, scalar(event, key))
        kind = "seq" if isinstance(event, yaml.SequenceStartEvent) else "map"
        if event.tag not in (None, "!", f"tag:yaml.org,2002:{kind}"):
            raise yaml.YAMLError("a tag that is not known")
        if kind == "seq":
            entries = named(event, [])
            while not isinstance(e := loader.get_event(), yaml.SequenceEndEvent):
                entries.append(fit(one(e)))
            return entries
        whole, own, merged = named(event, {}), {}, []
        while not isinstance(e := loader.get_event(), yaml.MappingEndEvent):
            name, value = one(e, True), fit(one(loader.get_event()))
            if name is not ...:
                own[fit_name(name)] = value
                continue
            each = value if isinstance(value, list) else [value]
            if not all(isinstance(x, dict) for x in each):
                raise yaml.YAMLError("only mappings can be merged")
            merged += reversed(each)  # of one name the first counts
        for x in [*merged, own]:
            whole.update(x)
        return whole

    try:
        loader.get_event()  # the stream
        if isinstance(loader.get_event(), yaml.StreamEndEvent):
            return None
        value = fit(one(loader.get_event()))
        loader.get_event()  # the document's end
        if not isinstance(loader.get_event(), yaml.StreamEndEvent):
            raise yaml.YAMLError("several documents")
        return value
    finally:
        loader.dispose()


def _unlike(pairs: list[tuple[str, object]]) -> None:
    """Of a JSON object nothing is kept; a name may be given once."""
    if len({name for name, _ in pairs}) < len(pairs):
        raise ValueError("a name is given twice")


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


@pandas_udf(StringType())
def _as_json(form: pd.Series, text: pd.Series) -> pd.Series:
    """JSON of a text of its form (json: itself, read to its end); null if it is none. Whatever else fails is an error."""

    def one(f: str, t: str | None) -> str | None:
        if f not in ("json", "yaml"):
            raise ValueError(f"files of the form {f} can't be read")
        if f == "yaml" and yaml is None:
            raise ImportError("YAML files need PyYAML where Spark's tasks run")
        if t is None:
            return None
        if f == "yaml":
            try:
                value = _yaml_value(t, for_json=True)
            except yaml.YAMLError:
                return None
            try:
                return json.dumps(value, default=str)
            except ValueError:  # a value that holds itself
                return None
        try:
            json.loads(t, object_pairs_hook=_unlike, parse_int=len, parse_float=len, parse_constant=_no_number)
            return t
        except ValueError:
            return None

    return pd.Series([one(f, t) for f, t in zip(form, text)], dtype="object")


def config_files(spark: SparkSession, path: str) -> DataFrame:
    """name (without the ending), form (json, yaml), text, digest of the files at path. Spark passes over files without a
    byte: they have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("_file"), F.col("content").cast("string").alias("value"))
    name = F.regexp_extract("_file", r"([^/]+)\.(json|ya?ml)$", 1)
    form = F.when(F.col("_file").rlike(r"\.ya?ml$"), "yaml").otherwise("json")
    return files.select(name.alias("name"), form.alias("form"), F.col("value").alias("text"), F.sha2("value", 256).alias("digest"))


def parsed(files: DataFrame) -> DataFrame:
    """name, config (VARIANT) of files (name, form: json or yaml, text); null for a text that is not of its form. A text that is, but
    that VARIANT can't hold (too long, too deep), fails, as does YAML without PyYAML. Files are dealt over all tasks, as one of them
    may be long."""
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return files.select("name", F.parse_json(_as_json("form", "text")).alias("config"))


def _kind(value: str) -> Column:
    """What a JSON text written by to_json() is; 30.0 is whole too."""
    first, number = F.substring(value, 1, 1), F.col(value).try_cast("double")
    return (
        F.when(first == "{", "object").when(first == "[", "list").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null")
        .when(number == F.floor(number), "integer").otherwise("number")
    )


def issues(configs: DataFrame, rules: list[Rule]) -> DataFrame:
    """name, path, issue of everything in configs (name, config) that the rules don't allow. A value whose own place is wrong
    isn't looked into. The rule of place "" is the document's."""
    spark = configs.sparkSession
    known = spark.createDataFrame([(*r[:3], *(None if x is None else float(x) for x in r[3:5]), list(r.choices) if r.choices else None, *r[6:]) for r in rules], _RULE)
    inside = spark.createDataFrame([(parent(r.place), r.place, r.required) for r in rules if r.place], "place string, child string, required boolean")
    known, inside = F.broadcast(known), F.broadcast(inside)  # the schema
    unread = configs.where("config is null").select("name", F.lit("").alias("path"), F.lit("cannot be read").alias("issue"))
    out, level = [unread], configs.where("config is not null").select("name", F.lit("").alias("path"), F.lit("").alias("place"), F.to_json("config").alias("value"))
    say = lambda rows, issue: rows.select("name", "path", issue.alias("issue"))
    for _ in range(1 + max(r.place.count(".") + r.place.count("[]") + bool(r.place) for r in rules)):
        level = saved(level, spark, "config-level")
        rows = level.join(known, "place", "left").withColumn("found", _kind("value"))
        out.append(say(rows.where("kind is null"), F.lit("is not known")))
        rows = rows.where("kind is not null")
        fits = F.array_contains(F.split("kind", r"\|"), F.col("found")) | (F.col("found") == "integer") & F.array_contains(F.split("kind", r"\|"), F.lit("number"))
        out.append(say(rows.where(~fits), F.concat(F.lit("is not "), F.regexp_replace("kind", r"\|", " or "))))
        rows = rows.where(fits)
        is_number, is_text = F.col("found").isin("integer", "number"), F.col("found") == "string"
        number, text = F.when(is_number, F.col("value").try_cast("double")), F.when(is_text, F.try_variant_get(F.parse_json("value"), "$", "string"))
        out.append(say(rows.where(is_number & ((number < F.col("low")) | (number > F.col("high")))), F.lit("is out of bounds")))
        out.append(say(rows.where(is_text & F.col("choices").isNotNull() & ~F.array_contains("choices", text)), F.concat(F.lit("is none of "), F.array_join("choices", ", "))))
        out.append(say(rows.where(is_text & F.col("pattern").isNotNull() & ~F.regexp_like(text, F.col("pattern"))), F.lit("has another form")))
        # entries: of objects by their keys, of lists by their places
        opened = rows.where("found in ('object', 'list')").select("name", "path", "place", "found", "value", "fewest")
        kept = ["name", "path", "place", "found"]
        of_objects = opened.where("found = 'object'").select(*kept, F.explode(F.from_json("value", "map<string,variant>")).alias("key", "value"))
        of_lists = opened.where("found = 'list'").select(*kept, F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "value"))
        entries = of_objects.unionByName(of_lists, allowMissingColumns=True).withColumn("value", F.to_json("value"))
        step = F.when(F.col("found") == "list", F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") != "", ".").otherwise(""), "key"))
        entries = entries.select("name", "path", "place", "found", "key", F.concat("path", step).alias("_path"), "value")
        own = F.when(F.col("found") == "list", F.concat("place", F.lit("[]"))).otherwise(F.concat("place", F.when(F.col("place") != "", ".").otherwise(""), "key"))
        any_key = F.concat("place", F.when(F.col("place") != "", ".").otherwise(""), F.lit("*"))
        entries = entries.withColumns({"_own": own, "_any": any_key})
        entries = entries.join(known.select(F.col("place").alias("_own"), F.lit(True).alias("_named")), "_own", "left").join(known.select(F.col("place").alias("_any"), F.lit(True).alias("_free")), "_any", "left")
        entries = saved(entries.select("name", "path", "found", "key", "_path", F.when(F.col("_named").isNotNull() | F.col("_free").isNull(), F.col("_own")).otherwise(F.col("_any")).alias("_place"), "value"), spark, "config-entries")
        there = entries.where("found = 'object'").select("name", "path", "key").distinct()
        due = opened.where("found = 'object'").join(inside.where("required and child not like '%*' and child not like '%[]'"), "place").select("name", "path", F.regexp_extract("child", r"([^.]*)$", 1).alias("key"))
        missing = due.join(there.hint("merge"), ["name", "path", "key"], "left_anti").select("name", F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "key").alias("path"), F.lit("is missing").alias("issue"))
        size = entries.groupBy("name", "path").agg(F.count("*").alias("n"))
        few = opened.where("fewest is not null").join(size.hint("merge"), ["name", "path"], "left").where("coalesce(n, 0) < fewest")
        out += [missing, say(few, F.lit("has too few entries"))]
        level = entries.select("name", F.col("_path").alias("path"), F.col("_place").alias("place"), "value")
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found


def partition_issues(lines: DataFrame, checks: DataFrame, tolerance_pct: float = 0.000001, tolerance_abs: float = 1.0) -> DataFrame:
    """asset, metric, issue of flows that lines split among them (asset, line, metric, by, total): the lines must name one
    total, each a series of its own that isn't the total, and a daily sum check (checks: asset, check, total, parts: arrays,
    window_days, tolerance_pct, tolerance_abs) must hold the total against just these series within the tolerances."""
    whole = lines.where("by = total").select("asset", "metric", F.lit("a part is its total").alias("issue"))
    sets = lines.groupBy("asset", "metric").agg(F.count_distinct("total").alias("totals"), F.count("*").alias("n"), F.array_sort(F.collect_set("by")).alias("parts"), F.min("total").alias("total"))  # a statement's lines
    several = sets.where("totals > 1").select("asset", "metric", F.lit("lines name different totals").alias("issue"))
    twice = sets.where("totals = 1 and size(parts) < n").select("asset", "metric", F.lit("a part is named twice").alias("issue"))
    good = sets.where("totals = 1 and size(parts) = n")
    tight = (F.coalesce("window_days", F.lit(1)) == 1) & (F.col("tolerance_pct") <= tolerance_pct) & (F.coalesce("tolerance_abs", F.lit(0.0)) <= tolerance_abs)
    proofs = checks.select("asset", F.col("total").alias("_total"), F.array_sort("parts").alias("parts"), tight.alias("tight")).where("size(_total) = 1").select("asset", F.col("_total")[0].alias("total"), "parts", "tight")
    proofs = proofs.groupBy("asset", "total", "parts").agg(F.bool_or("tight").alias("tight"))
    held = good.join(proofs, ["asset", "total", "parts"], "left")
    unproved = held.where("tight is null").select("asset", "metric", F.lit("needs a sum check of its parts").alias("issue"))
    loose = held.where("not tight").select("asset", "metric", F.lit("its sum check must be daily and tight").alias("issue"))
    return whole.unionByName(several).unionByName(twice).unionByName(unproved).unionByName(loose)
