"""Source adapters as tables: spark.read.format(name) over landed raw files, by Python data sources.

Raw files lie in folders day=YYYY-MM-DD/asset=... below a path, a JSON reply a line. An adapter decodes one kind of reply to
readings; its parameters are the options, checked before anything is read. With table(..., where) filters on day and asset
choose folders before files are listed to tasks; the rest of a filter stays with Spark. Files are dealt to tasks by size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
#: Most decimals of a token's units.
MAX_DECIMALS = 36
#: Readings in an Arrow batch.
BATCH = 8192
_FOLDER = re.compile(r"day=([^/]+)/asset=([^/]+)/[^/]*$")


class Parameter(NamedTuple):
    """A parameter of an adapter. check gives what is wrong with its text, or None."""

    name: str
    check: Callable[[str], str | None]
    required: bool = False
    default: str | None = None


def _matching(pattern: str, what: str) -> Callable[[str], str | None]:
    return lambda v: None if re.fullmatch(pattern, v) else f"must be {what}"


def _whole(low: int, high: int) -> Callable[[str], str | None]:
    return lambda v: None if re.fullmatch(r"\d{1,9}", v) and low <= int(v) <= high else f"must be a whole number from {low} to {high}"


def _one_of(*names: str) -> Callable[[str], str | None]:
    return lambda v: None if v in names else f"must be one of {', '.join(names)}"


_FUNCTION = r"[A-Za-z_][A-Za-z0-9_]*"


class Adapter(NamedTuple):
    """A named adapter: its parameters, the columns behind day and asset, and what a reply gives: rows of those columns."""

    name: str
    parameters: tuple[Parameter, ...]
    columns: str
    decode: Callable[[Any, dict[str, str]], Iterator[tuple]]


def _fills(reply: Any, p: dict[str, str]) -> Iterator[tuple]:
    for f in reply:
        if f["coin"] == p["pair"] and f["side"] == p["side"]:
            yield int(f["time"]), float(f["px"]), float(f["sz"])


def _units(word: str, decimals: int) -> float:
    whole, part = divmod(int(word, 16) if word.startswith("0x") else int(word), 10**decimals)
    return whole + part / 10**decimals


def _reads(reply: Any, p: dict[str, str]) -> dict[str, float]:
    return {r["function"]: _units(r["value"], int(p["decimals"])) for r in reply["results"] if r["ok"]}


def _counter(reply: Any, p: dict[str, str]) -> Iterator[tuple]:
    value = _reads(reply, p).get(p["function"])
    if value is not None and reply["contract"] == p["contract"]:
        yield int(reply["block"]), int(reply["time"]), value


def _views(reply: Any, p: dict[str, str]) -> Iterator[tuple]:
    """The sum of several reads of one block, those behind `minus` counted off; none unless all were read."""
    plus, minus = (p[k].split(",") if p[k] else [] for k in ("plus", "minus"))
    read = _reads(reply, p)
    if all(f in read for f in (*plus, *minus)):
        yield int(reply["block"]), int(reply["time"]), sum(read[f] for f in plus) - sum(read[f] for f in minus)


_DECIMALS = Parameter("decimals", _whole(0, MAX_DECIMALS), default="18")
ADAPTERS = {
    a.name: a
    for a in (
        Adapter("landed_fills", (Parameter("pair", _matching(r"\S+", "the name of a pair"), True), Parameter("side", _one_of("A", "B"), default="B")), "time long, price double, size double", _fills),
        Adapter("landed_counter", (Parameter("contract", _matching("[a-z0-9_]+", "a contract's name"), True), Parameter("function", _matching(_FUNCTION, "a function's name"), True), _DECIMALS), "block long, time long, value double", _counter),
        Adapter("landed_views", (Parameter("plus", _matching(f"{_FUNCTION}(,{_FUNCTION})*", "names of functions"), True), Parameter("minus", _matching(f"({_FUNCTION}(,{_FUNCTION})*)?", "names of functions"), default=""), _DECIMALS), "block long, time long, value double", _views),
    )
}


def problems(name: str, options: dict[str, str]) -> list[str]:
    """What is wrong with an adapter's options, a text for each; none if they are right."""
    if name not in ADAPTERS:
        return [f"unknown adapter: {name}"]
    known = {p.name: p for p in ADAPTERS[name].parameters}
    out = [f'unknown parameter "{k}"' for k in options if k not in known and k not in ("path", "pushdown")]
    out += [f"{p.name} is required" for p in known.values() if p.required and p.name not in options]
    out += [f"{k} {why}" for k, v in options.items() if k in known and (why := known[k].check(v))]
    return out if options.get("path") else [*out, "path is required"]


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files  # day, asset, path


class _Reader(DataSourceReader):
    def __init__(self, adapter: Adapter, options: dict[str, str], schema: Any):
        self.adapter, self.schema, self.filters = adapter, schema, []
        self.options = {p.name: options.get(p.name, p.default) for p in adapter.parameters} | {"path": options["path"]}

    def _wanted(self, day: str, asset: str) -> bool:
        for f in self.filters:
            have = date.fromisoformat(day) if f.attribute == ("day",) else asset
            if not (
                have == f.value if isinstance(f, EqualTo) else have in f.value if isinstance(f, In) else have > f.value if isinstance(f, GreaterThan)
                else have >= f.value if isinstance(f, GreaterThanOrEqual) else have < f.value if isinstance(f, LessThan) else have <= f.value
            ):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            m = _FOLDER.search(info.path)
            if info.type == fs.FileType.File and m and info.size and not info.base_name.startswith((".", "_")) and self._wanted(*m.groups()):
                found.append((*m.groups(), info.path, info.size))
        out, held, size = [], [], 0
        for *file, n in sorted(found):
            if held and size + n > TASK_BYTES:
                out.append(_Files(held))
                held, size = [], 0
            held.append(tuple(file))
            size += n
        return [*out, _Files(held)] if held else [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = fs.FileSystem.from_uri(self.options["path"])
        kind = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        for day, asset, path in partition.files:
            at = date.fromisoformat(day)
            with store.open_input_stream(path, compression="detect") as f:
                for line in _lines(f):
                    rows += [(at, asset, *r) for r in self.adapter.decode(json.loads(line), self.options)]
                    if len(rows) >= BATCH:
                        yield _batch(rows, kind)
                        rows = []
        if rows:
            yield _batch(rows, kind)


class _Pushed(_Reader):
    """A reader that filters on day and asset reach."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("day",), ("asset",)):
                self.filters.append(f)
            else:
                yield f


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


def _lines(stream: Any) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


def _source(adapter: Adapter) -> type[DataSource]:
    class Landed(DataSource):
        @classmethod
        def name(cls) -> str:
            return adapter.name

        def schema(self) -> str:
            return f"day date, asset string, {adapter.columns}"

        def reader(self, schema: Any) -> DataSourceReader:
            options = dict(self.options.items())
            if found := problems(adapter.name, options):
                raise ValueError(f"{adapter.name}: {'; '.join(found)}")
            return (_Pushed if options.get("pushdown") == "true" else _Reader)(adapter, options, schema)

    return Landed


def register(spark: SparkSession) -> None:
    """Makes all adapters known to the session by name. Filters reach them only with the setting that this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for adapter in ADAPTERS.values():
        spark.dataSource.register(_source(adapter))


def table(spark: SparkSession, name: str, where: str | None = None, **options: str) -> DataFrame:
    """An adapter's readings. where: a condition whose filters on day and asset (by "and") choose the folders that are read.
    Spark 4.1 keeps the filters that were last pushed with a loaded table, also for a later query without any; so they are
    pushed only here, where every query of the result has the condition."""
    register(spark)
    reader = spark.read.format(name).options(**options)
    return reader.load() if where is None else reader.option("pushdown", "true").load().where(where)


def land(rows: DataFrame, reply: Any, path: str) -> None:
    """Writes raw files of replies (a column that is turned into JSON) of rows with day and asset."""
    rows.select(F.to_json(reply).alias("value"), F.col("day").cast("string").alias("day"), "asset").write.partitionBy("day", "asset").text(path)
