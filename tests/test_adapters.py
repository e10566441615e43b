"""Adapters as table sources: parameters, pushed filters, files dealt to tasks, odd replies."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import adapters as A


def landed(path, rows):
    """Raw files of (day, asset, file, replies)."""
    for day, asset, name, replies in rows:
        folder = path / f"day={day}" / f"asset={asset}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in replies))
    return f"file://{path}"


def fill(time, px, sz, coin="@107", side="B"):
    return {"time": time, "coin": coin, "side": side, "px": px, "sz": sz}


def test_fills(spark, tmp_path):
    A.register(spark)
    rows = [(f"2024-01-0{d}", a, f"part-{k}.json", [[fill(d, "2.5", "4"), fill(d, "1", "1", side="A"), fill(d, "9", "9", coin="@1")], []]) for d in range(1, 5) for a in "xy" for k in range(2)]
    path = landed(tmp_path, [*rows, ("2024-01-01", "x", "_SUCCESS", []), ("2024-01-01", "x", ".part.crc", [[fill(1, "1", "1")]])])
    got = spark.read.format("landed_fills").options(path=path, pair="@107").load()
    assert got.columns == ["day", "asset", "time", "price", "size"] and got.count() == 16
    assert got.agg(F.sum(F.col("price") * F.col("size"))).first()[0] == 160.0
    assert spark.read.format("landed_fills").options(path=path, pair="@107", side="A").load().agg(F.sum("price")).first()[0] == 16.0
    condition = "day >= '2024-01-02' and day < '2024-01-04' and asset in ('x', 'z') and price > 1"
    for some in (got.where(condition), A.table(spark, "landed_fills", condition, path=path, pair="@107")):
        assert sorted((str(r.day), r.asset) for r in some.collect()) == [(f"2024-01-0{d}", "x") for d in (2, 2, 3, 3)]
        assert some.where("day = '2024-01-03'").count() == 2 and some.count() == 4  # a filter of one query isn't kept for the next
    assert got.where("asset = 'nobody'").count() == 0 and got.where("day = '2024-01-03' or asset = 'y'").count() == 10


def test_filters_choose_folders(tmp_path):
    from datetime import date

    path = landed(tmp_path, [(f"2024-01-0{d}", a, "part-0.json", [[]]) for d in range(1, 10) for a in "xy"])
    reader = A._Pushed(A.ADAPTERS["landed_fills"], {"path": path, "pair": "@1"}, None)
    assert sum(len(p.files) for p in reader.partitions()) == 18
    left = list(reader.pushFilters([A.GreaterThan(("day",), date(2024, 1, 7)), A.EqualTo(("asset",), "x"), A.EqualTo(("price",), 1.0)]))
    assert [f.attribute for f in left] == [("price",)]
    assert [f[:2] for p in reader.partitions() for f in p.files] == [("2024-01-08", "x"), ("2024-01-09", "x")]


def test_files_are_dealt(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "TASK_BYTES", 10)
    path = landed(tmp_path, [("2024-01-01", "x", f"part-{k}.json", [[1]]) for k in range(7)])
    parts = A._Reader(A.ADAPTERS["landed_fills"], {"path": path, "pair": "@1"}, None).partitions()
    assert sorted(len(p.files) for p in parts) == [1, 2, 2, 2]


@pytest.mark.parametrize("name,options,wrong", [
    ("landed_fills", {}, ["pair is required", "path is required"]),
    ("landed_fills", {"path": "p", "pair": "@1", "sides": "B"}, ['unknown parameter "sides"']),
    ("landed_fills", {"path": "p", "pair": "@1", "side": "C"}, ["side must be one of A, B"]),
    ("landed_counter", {"path": "p", "contract": "Not A Name", "function": "minted", "decimals": "37"}, ["contract must be a contract's name", "decimals must be a whole number from 0 to 36"]),
    ("landed_views", {"path": "p", "plus": "held,,owed"}, ["plus must be names of functions"]),
    ("landed_views", {"path": "p", "plus": "held,owed", "minus": ""}, []),
    ("landed_nothing", {}, ["unknown adapter: landed_nothing"]),
])
def test_parameters(name, options, wrong):
    assert A.problems(name, options) == wrong


def test_bad_parameters_are_refused(spark, tmp_path):
    A.register(spark)
    with pytest.raises(Exception, match="unknown parameter"):
        spark.read.format("landed_fills").options(path=f"file://{tmp_path}", pair="@1", colour="red").load().count()
    assert spark.read.format("landed_fills").options(path=f"file://{tmp_path}", pair="@1").load().count() == 0


def test_reads(spark, tmp_path):
    """Words of 256 bits, failed reads, other contracts."""
    def reply(block, results, contract="minter"):
        return {"contract": contract, "block": block, "time": block * 10, "results": [{"function": f, "value": v, "ok": ok} for f, v, ok in results]}

    huge = 2**255 + 10**18
    A.register(spark)
    path = landed(tmp_path, [("2024-01-01", "x", "part-0.json", [reply(1, [("a", hex(huge), True), ("b", "5", True)]), reply(2, [("a", "0x10", False), ("b", "5", True)]), reply(3, [("a", "0x10", True)], "other")])])
    got = spark.read.format("landed_counter").options(path=path, contract="minter", function="a").load().collect()
    assert [(r.block, r.time, r.value) for r in got] == [(1, 10, huge / 10**18)]
    got = spark.read.format("landed_views").options(path=path, plus="a", minus="b", decimals="0").load().collect()
    assert [(r.block, r.value) for r in got] == [(1, float(huge) - 5)]
