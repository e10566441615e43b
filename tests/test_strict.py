"""Strict config files and proofs of partitions."""

import json

import pandas as pd
import pytest
import yaml

from quillspark.sources import strict as S

RULES = [
    S.Rule("", "object"), S.Rule("id", "string", True, pattern="^[a-z]+$"), S.Rule("window_days", "integer", low=1, high=400), S.Rule("metrics", "object", True), S.Rule("metrics.*", "object"),
    S.Rule("metrics.*.type", "string", True, choices=("flow", "level")), S.Rule("metrics.*.source", "object"), S.Rule("metrics.*.source.url", "string", True), S.Rule("metrics.*.source.params", "object"),
    S.Rule("metrics.*.source.params.*", "string|number|boolean"), S.Rule("lines", "list", fewest=1), S.Rule("lines[]", "object"), S.Rule("lines[].share", "number", low=0, high=1), S.Rule("lines[].of", "list"), S.Rule("lines[].of[]", "string"),
]


def test_files(spark, tmp_path):
    """JSON and YAML files; each fault is reported with its path, at any depth."""
    texts = {
        "good.json": '{"id":"good","window_days":30,"metrics":{"a b":{"type":"flow","source":{"url":"u","params":{"x":1.5,"y":true,"z":"t"}}}},"lines":[{"share":1,"of":["a"]}]}',
        "good.yaml": "# a note\nid: good\nmetrics:\n  m:\n    type: level\n",
        "bad.yaml": "id: Bad\nwindow_days: 0.5\nmetrics:\n  m: {type: ratio, source: {params: {x: [1]}}, own: 2}\n  n: 3\nlines:\n  - {share: 1.5, of: [a, 2]}\n  - 7\nmore: null\n",
        "worse.json": '{"metrics":[],"lines":[],"window_days":500,"id":null}', "list.json": "[1]", "broken.json": '{"id":', "broken.yaml": "a: [1\nb: 2", "blank.yml": "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = S.config_files(spark, f"file://{tmp_path}")
    assert {(r.name, r.form) for r in files.collect()} == {(n.split(".")[0], "json" if n.endswith("json") else "yaml") for n in texts}
    named = files.selectExpr("concat(name, '.', form) as name", "form", "text")
    got = {}
    for r in S.issues(S.parsed(named), RULES).collect():
        got.setdefault(r.name, {})[r.path] = r.issue
    assert got == {
        "bad.yaml": {"id": "has another form", "window_days": "is not integer", "metrics.m.type": "is none of flow, level", "metrics.m.source.url": "is missing", "metrics.m.source.params.x": "is not string or number or boolean", "metrics.m.own": "is not known",
                     "metrics.n": "is not object", "lines[0].share": "is out of bounds", "lines[0].of[1]": "is not string", "lines[1]": "is not object", "more": "is not known"},
        "worse.json": {"metrics": "is not object", "lines": "has too few entries", "window_days": "is out of bounds", "id": "is not string"},
        "list.json": {"": "is not object"}, "broken.json": {"": "cannot be read"}, "broken.yaml": {"": "cannot be read"}, "blank.yaml": {"": "is not object"},
    }


def test_long_file(spark, monkeypatch):
    """A level's rows are as long as its values: none carries the names of its whole file, as VARIANT does."""
    names = [f"entry {i:05}" for i in range(3000)]
    text = json.dumps({"id": "a", "metrics": {n: {"type": "flow" if i % 1000 else "other", "own": i} for i, n in enumerate(names)}})
    files = spark.createDataFrame([("j", "json", text), ("y", "yaml", "# a note\n" + text)], "name string, form string, text string")
    written = []

    def saved(rows, spark, name, real=S.saved):
        written.append(real(rows, spark, name))
        return written[-1]

    monkeypatch.setattr(S, "saved", saved)
    got = [tuple(r) for r in S.issues(S.parsed(files), RULES).collect()]
    due = {(f, f"metrics.{n}.own", "is not known") for f in "jy" for n in names} | {(f, f"metrics.{n}.type", "is none of flow, level") for f in "jy" for n in names[::1000]}
    assert set(got) == due and len(got) == len(due)
    assert all(dict(w.dtypes)["value"] == "string" for w in written)


def test_yaml_values():
    """As yaml.safe_load() reads them."""
    texts = [
        "", "---\n...\n", "a: &x {b: 1, c: [1, 2.5, ~, yes, 2024-01-02, 0x1f, 1_000, '7', !!str 8]}\nd: *x\n", "x: &p {k: 1, l: 2}\ny: &q {k: 3}\nz: {<<: [*p, *q], l: 4}\nw:\n  <<: *q\n  m: |\n    text\n    more\n", "- a\n- [b, {c: d}]\n",
        "1: a\nnull: b\ntrue: c\n", "=: 1\n", "plain", "k: 'it''s'\nk: 2\n", '{"a": "\\u00e9\\n", "b": -0.0}',
    ]
    for text in texts:
        assert S._yaml_value(text) == yaml.safe_load(text), text
    for text in ("a: *no", "a: [1\nb: 2", "--- 1\n--- 2\n", "a: !own 1", "<<: 3", "a: &x 1\nb: =", "? [a]\n: 1"):
        with pytest.raises((yaml.YAMLError, TypeError)):
            S._yaml_value(text)


def test_failures(spark, monkeypatch):
    """A file is read to its end, an odd value costs no whole file, and what fails is an error, not an unreadable file."""
    one = {
        "rest.json": '{"id":"a","metrics":{}} rest', "two.json": '{"id":"a","metrics":{}}{"id":3}', "closed.json": '{"id":"a","metrics":{}}]', "twice.json": '{"id":"a","id":"b","metrics":{}}', "nan.json": '{"id":NaN,"metrics":{}}', "spaces.json": ' {"id":"a","metrics":{}}\r\n',
        "nan.yaml": "id: .nan\nwindow_days: .inf\nmetrics: {}\n", "dates.yaml": "id: a\nmetrics: {}\n2024-01-02: 1\n", "same.yaml": "id: a\nmetrics: {}\n1: a\n'1': b\n", "tag.yaml": "id: !!bool maybe\nmetrics: {}\n", "itself.yaml": "&a [*a]",
    }
    found = lambda files: {(r.name, r.path, r.issue) for r in S.issues(S.parsed(spark.createDataFrame(files, "name string, form string, text string")), RULES).collect()}
    assert found([(n, n.split(".")[1], t) for n, t in one.items()]) == {(n, "", "cannot be read") for n in ("rest.json", "two.json", "closed.json", "twice.json", "nan.json", "tag.yaml", "itself.yaml")} | {
        ("nan.yaml", "id", "is not string"), ("nan.yaml", "window_days", "is not integer"), ("dates.yaml", "2024-01-02", "is not known"), ("same.yaml", "1", "is not known"),
    }
    for form, text in (("json", '{"id":"' + "a" * 21_000_000 + '","metrics":{}}'), ("json", '{"id":' + "[" * 1001 + "]" * 1001 + "}"), ("toml", "id = 1")):
        with pytest.raises(Exception, match="MALFORMED_RECORD|can't be read"):
            found([("a", form, text)])
    monkeypatch.setattr(S, "yaml", None)  # the driver needs none, a task does
    assert found([("a", "yaml", "id: a\nmetrics: {}\n")]) == set()
    assert list(S._as_json.func(pd.Series(["json"]), pd.Series(["[]"]))) == ["[]"]
    with pytest.raises(ImportError):
        S._as_json.func(pd.Series(["yaml"]), pd.Series(["id: a"]))


def test_no_configs(spark):
    assert S.issues(S.parsed(spark.createDataFrame([], "name string, form string, text string")), RULES).count() == 0


def test_partitions(spark):
    lines = [("a", "l1", "m", "p", "t"), ("a", "l2", "m", "q", "t"), ("b", "l1", "m", "p", "t"), ("b", "l2", "m", "q", "u"), ("c", "l1", "m", "p", "t"), ("c", "l2", "m", "p", "t"), ("d", "l1", "m", "t", "t"), ("e", "l1", "m", "p", "t"), ("f", "l1", "m", "p", "t")]
    checks = [("a", "c", ["t"], ["q", "p"], None, 0.0, None), ("d", "c", ["t"], ["t"], 1, 0.0, 1.0), ("e", "c", ["t"], ["p"], 7, 0.0, 0.0), ("e", "c2", ["t", "u"], ["p"], 1, 0.0, 0.0), ("f", "c", ["t"], ["p", "q"], 1, 0.0, 0.0)]
    got = S.partition_issues(
        spark.createDataFrame(lines, "asset string, line string, metric string, by string, total string"),
        spark.createDataFrame(checks, "asset string, check string, total array<string>, parts array<string>, window_days int, tolerance_pct double, tolerance_abs double"),
    )
    assert {(r.asset, r.issue) for r in got.collect()} == {
        ("b", "lines name different totals"), ("c", "a part is named twice"), ("d", "a part is its total"), ("e", "its sum check must be daily and tight"), ("f", "needs a sum check of its parts"),
    }
