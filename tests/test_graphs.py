"""Fixpoints against plain walks, on random references, long chains and cycles."""

import random

import pytest

from quillspark.operators import graphs, pricing


def reached(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed,n,m", [(1, 12, 10), (2, 12, 16), (3, 30, 30), (4, 8, 20)])
def test_random(spark, seed, n, m):
    rng = random.Random(seed)
    edges, ranks = random_edges(seed, n, m), {i: rng.choice([None, 0, 1, 2, 5]) for i in range(n) if rng.random() < 0.9}
    df = spark.createDataFrame([*edges, *edges[:3], (n, None), (None, 3)], "node long, input long")
    ways = reached([*edges, (n, n + 1)])
    assert {r.node for r in graphs.circular(spark, df).collect()} == {x for x, s in ways.items() if x in s}
    level = {}

    def of(x):
        if x not in level:
            ins = {b for a, b in edges if a == x}
            on = x in ways.get(x, ()) or any(y in ways.get(y, ()) for y in ways.get(x, ()))
            level[x] = None if on else 1 + max((of(i) for i in ins), default=-1)
        return level[x]

    assert {r.node: r.level for r in graphs.levels(spark, df).collect()} == {x: of(x) for x in {*(y for e in edges for y in e), n, 3}}
    known = [e for e in edges if e[0] in ranks and e[1] in ranks]
    ways = reached(known)
    want = {x: min((ranks[y] for y in {x, *ways.get(x, ())} if ranks[y] is not None), default=None) for x in ranks}
    nodes = spark.createDataFrame(list(ranks.items()), "node long, rank long")
    assert {r.node: r.least for r in graphs.least_reached(spark, nodes, df).collect()} == want


def test_long_chain_and_cycle(spark):
    n = 10_000
    chain = [(i, i + 1) for i in range(n)]
    cycle = [(20_000 + i, 20_000 + (i + 1) % 999) for i in range(999)] + [(50_000, 20_500), (50_000, 0)]
    metrics = [(i, "derived") for i in range(n)] + [(n, "third_party")] + [(20_000 + i, "derived") for i in range(999)] + [(50_000, "derived")]
    got = graphs.source_rungs(spark, spark.createDataFrame(metrics, "metric long, source_type string"), spark.createDataFrame(chain + cycle, "metric long, input long")).collect()
    rungs = {r.metric: (r.rung, r.weakest) for r in got}
    assert len(got) == len(metrics) and all(rungs[i] == ("third_party", "third_party") for i in [*range(n + 1), 50_000])
    assert all(rungs[20_000 + i] == ("derived", "derived") for i in range(999))
    cores = graphs.circular(spark, spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)] + [(40, 0), (41, 40), (0, 42)], "node long, input long"))
    assert {r.node for r in cores.collect()} == set(range(30))


def test_hour_prices(spark):
    """Quotes of any depth; what a cycle of quotes can't price is refused by name."""
    rows = [(f"r{i}", 1, f"r{i - 1}" if i else None, 2.0, None) for i in range(6)] + [("x", 1, "nowhere", 3.0, None), ("r0", 2, None, None, "bad_read"), ("r1", 2, "r0", 2.0, None)]
    readings = spark.createDataFrame(rows, "ref string, hour long, quote_ref string, in_quote double, reason string")
    got = {(r.ref, r.hour): (r.price, r.reason) for r in pricing.hour_prices(readings).collect()}
    assert got == {(f"r{i}", 1): (2.0 ** (i + 1), None) for i in range(6)} | {("x", 1): (None, "quote_missing"), ("r0", 2): (None, "bad_read"), ("r1", 2): (None, "quote_missing")}
    loop = spark.createDataFrame([("a", 1, "b", 1.0, None), ("b", 1, "a", 1.0, None)], readings.schema)
    with pytest.raises(ValueError, match="a, b"):
        pricing.hour_prices(loop)


def test_rounds_send_nothing_to_the_driver(spark, monkeypatch):
    """Rounds join by shuffles: each broadcast would pass the driver, in every round."""
    plans = []

    def saved(rows, spark, name, real=graphs.saved):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return real(rows, spark, name)

    monkeypatch.setattr(graphs, "saved", saved)
    nodes = spark.createDataFrame([(i, 9 - i) for i in range(10)], "node long, rank long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 10)] + [(9, 3), (8, 2)], "node long, input long")
    assert {(r.node, r.least) for r in graphs.least_reached(spark, nodes, edges).collect()} == {(i, 9 - i) for i in range(10)}
    assert {(r.node, r.level) for r in graphs.levels(spark, edges).collect()} == {(i, i) for i in range(10)}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
