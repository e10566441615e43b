"""Clustering, SimHash and lexical search against plain versions, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import clustering, common, lexical, simhash
from test_text_operators import documents, empty, odd_table, prose, scratch

# ---- 11: clustering --------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), "x") for i, v in rows], "vec_id long, embedding array<double>, label string")


def plain_clusters(rows, k, rounds, seed=3, scale=1024):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [v for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in rows]
    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, i) in zip(rows, of) if i == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assign()
    each = collections.Counter()
    for d, j in of:
        each[j] += d
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(
        ((i, j, fit(d), fit(each[j]), fit(sum(each.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, of)), key=str
    )


def clusters(spark, rows, k, rounds, dim, **options):
    used = clustering.usable(vectors(spark, rows), dim)
    return sorted((tuple(r) for r in clustering.cluster(used, scratch(spark), k, rounds, dim=dim, **options).collect()), key=str)


@pytest.mark.parametrize("n,k,dim,grid", [(300, 8, 4, 3), (300, 40, 3, 20), (60, 60, 2, 5), (5, 8, 3, 2)])
def test_clusters(spark, n, k, dim, grid):
    """On small grids many distances are equal, and so are many vectors."""
    rng = random.Random(n + k)
    rows = [(i if i % 17 else None, [rng.randint(-grid, grid) / 8 + 0.01 for _ in range(dim)]) for i in range(n)] + [(3, [0.5] * dim)] * 3
    assert clusters(spark, rows, k, 4, dim) == plain_clusters(rows, k, 4)


def test_clusters_of_huge_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 0, 3, 9, 150]) for _ in range(3)]) for i in range(60)]
    assert clusters(spark, rows, 5, 3, 3) == plain_clusters(rows, 5, 3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 5]) for _ in range(3)]) for i in range(60)]
    got = clusters(spark, rows, 5, 3, 3)
    assert got == plain_clusters(rows, 5, 3) and all(r[2] is not None for r in got)


def test_clusters_odd(spark):
    bad = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [])]
    assert clusters(spark, bad, 8, 3, 2) == []
    assert len(clusters(spark, bad + [(None, [1.0, 2.0])], 8, 3, 2)) == 0  # no vector with an id to start from
    rows = [(7, [1.0, 2.0])] * 4 + [(None, [9.0, 2.0])]
    assert clusters(spark, bad + rows, 8, 3, 2) == plain_clusters(rows, 8, 3)


def test_tree_prunes():
    """Ties go to the smaller number though the tree meets centroids in another order, and most centroids aren't opened."""
    rng = np.random.default_rng(1)
    c = np.repeat(rng.integers(-(10**6), 10**6, (128, 3)), 2, axis=0)
    x = np.concatenate([c[::3] + rng.integers(-2000, 2000, c[::3].shape), c[::5]])
    number, least, opened = clustering.nearest(x, c, clustering.vantage_tree(c))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (least == d.min(1)).all() and (number % 2 == 0).all()
    assert opened < 0.25 * len(x) * len(c)


# ---- 12: SimHash -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(nodes, link):
    """The least reachable node of each."""
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in link:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def plain_simhash(docs, radius=2):
    f = [(d, plain_fingerprint(t)) for d, t in docs]
    ids = sorted({d for d, _ in f if d is not None})
    least = {}
    for d, x in f:
        if d is not None:
            least[x] = min(least.get(x, d), d)
    labels = joined(least, [(a, b) for a, b in itertools.combinations(least, 2) if (a ^ b).bit_count() <= radius])
    names = {}
    for x in least:
        names[labels[x]] = min(names.get(labels[x], ids[-1]), least[x])
    return sorted(((d, f"{x:016x}", None if d is None else names[labels[x]]) for d, x in f), key=str)


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    rng = random.Random(3)
    for n in [*range(12), 200]:
        for _ in range(5):
            text = "".join(rng.choice(["Ab", "c", " ", "\n", "É", "\x1c", "\x85", "9" * 70]) for _ in range(n))
            assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash(spark):
    base = prose(5, 400)
    texts = []
    for i in range(60):
        words = list(base)
        for j in range(i % 6):
            words[(i * 31 + j * 67) % 400] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(prose(100 + i, 30)) for i in range(40)] + ["", None, "one", "ONE", "one two", " one\ntwo "]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id in (3, 70)")).union(documents(spark, ["other text of a repeated id"], 5)).union(documents(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, scratch(spark)).collect()), key=str)
    assert got == plain_simhash(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})  # some links join different fingerprints


@pytest.mark.parametrize("crowd", [1, 3, 8, 256])
@pytest.mark.parametrize("radius,blocks", [(2, 4), (2, 3), (4, 7)])
def test_near_links(spark, monkeypatch, crowd, radius, blocks):
    """Fingerprints close to few centres, so that many share all their blocks but one; keys are crowded from few on."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(radius + crowd)
    found = set()
    for centre in [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(3))]:
        found |= {centre ^ sum(1 << b for b in rng.sample(range(16) if rng.random() < 0.5 else range(64), rng.randint(0, 5))) for _ in range(40)}
    signed = {x: int(np.array(x, np.uint64).view(np.int64)) for x in found}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed.values()], "f long"), scratch(spark), radius, blocks).collect()
    back = {s: x for x, s in signed.items()}
    got = joined(found, [(back[r.a], back[r.b]) for r in links])
    assert got == joined(found, [(a, b) for a, b in itertools.combinations(found, 2) if (a ^ b).bit_count() <= radius])
    assert all((back[r.a] ^ back[r.b]).bit_count() <= radius for r in links) or crowd > 1  # within a key links may go by way of others


def test_simhash_odd(spark):
    rows = [(r.doc_id, r.text) for r in odd_table(spark).collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd_table(spark), scratch(spark)).collect()), key=str) == plain_simhash(rows)
    assert simhash.near_duplicates(empty(spark), scratch(spark)).count() == 0


# ---- 13: lexical search ----------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_search(docs, items, k):
    bags = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    one = {}
    for i, t in items:
        if i is not None and t is not None:
            one[i] = min(one.get(i, t), t)
    out = []
    for i, t in one.items():
        found = []
        for d, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 12 * m)) for w in terms_of(t))
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def searched(spark, docs, items, k, width=1024):
    s = scratch(spark)
    return sorted(tuple(r) for r in lexical.search(s.save(lexical.build(docs, width), "index"), docs, items, s, k, width).collect())


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "n", "doc_id", "reach", "sketch")})


@pytest.mark.parametrize("width,first,batch_bytes", [(1024, 40, 1 << 22), (8, 2, 1 << 22), (64, 40, 300)])
def test_search(spark, monkeypatch, width, first, batch_bytes):
    """Narrow sketches merge terms, so that bounds are loose; few bytes make several batches."""
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "BATCH_BYTES", batch_bytes)
    texts = [" ".join(prose(i % 40, 5 + 13 * (i % 11), 60)) for i in range(120)] + ["Cab CAB cab! " * 200, "é漢字 x9"] + ["cab"] * 30
    items = [" ".join(prose(900 + i, 12, 60)) for i in range(8)] + [texts[7], texts[7], "cab cab", "É é漢字 nowhere", "", None, "?!", "zz9zz"]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id in (7, 122)")).union(documents(spark, ["cab fee"]).withColumn("doc_id", F.lit(None).cast("long")))
    table = bench(spark, items).union(bench(spark, ["abc fee"]).withColumn("item_id", F.lit(3).cast("long")))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in table.collect()], 20)
    assert searched(spark, docs, table, 20, width) == want
    assert searched(spark, docs, table, 3, width) == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in table.collect()], 3)


@pytest.mark.parametrize("items,terms", [(128, 4096), (3, 5)])
def test_bounds_hold(monkeypatch, items, terms):
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "TERMS", terms)
    rng = random.Random(8)
    rows = [[rng.randint(0, 10**9) % (50 if rng.random() < 0.5 else 10**6) for _ in range(rng.randint(1, 900))] for _ in range(50)]
    h = common.mix(np.concatenate([np.array(r, np.uint64) for r in rows]))
    sizes = np.array([len(r) for r in rows])
    item, term = zip(*sorted({(i, int(x)) for i in range(9) for x in rng.choices(h.view(np.int64).tolist(), k=30)}))
    batch = lexical.Batch(pa.table({"item_id": item, "term": term, "n": [1 + i % 3 for i in range(len(term))]}), {t: rng.randint(1, 20) for t in term}, 50, int(sizes.sum()))
    bounds = np.concatenate([b for _, b in batch.bounds(lexical.sketched(h, sizes), sizes)])
    exact = batch.scores(h, sizes).T
    assert (bounds >= exact).all() and np.median(bounds[exact > 0] / exact[exact > 0]) < 1.5


def test_search_rescores_few(spark):
    """Of the given documents the bounds leave few to rescore."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    s = scratch(spark)
    lexical.search(s.save(lexical.build(docs), "index"), docs, items, s).count()
    chosen = spark.read.parquet(s.path("chosen-0")).count()
    assert chosen < 0.5 * docs.count(), chosen


def test_search_odd(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert searched(spark, odd_table(spark), none, 20) == []
    assert searched(spark, empty(spark), bench(spark, ["one"]), 20) == []
    assert searched(spark, documents(spark, ["", None, " ?"]), bench(spark, ["one"]), 20) == []
    rows = [(r.doc_id, r.text) for r in odd_table(spark).collect()]
    items = ["one two three", "w", "x" * 300_000, "é ß", "copy of a text a a"]
    assert searched(spark, odd_table(spark), bench(spark, items), 20) == plain_search(rows, list(enumerate(items)), 20)


def test_jaccard_best_pairs_of_a_row():
    """A row that meets many members of another component gives its best pairs only, until all are asked for."""
    import pyarrow as pa

    from quillspark.llm import jaccard

    meets = [y for y in range(40) for _ in range(2 + (y in (7, 11, 30)))]
    row = {"x": [1000], "nx": [10], "label": [1000], "other": [5], "block": [0], "y": [meets], "ny": [[10] * len(meets)], "ly": [[5] * len(meets)]}
    batch = pa.RecordBatch.from_pydict(row)
    every = pa.Table.from_batches(jaccard._product(iter([batch]), 80)).to_pydict()
    best = pa.Table.from_batches(jaccard._product(iter([batch]), 80, 3)).to_pydict()
    assert sorted(every["y"]) == list(range(40)) and every["common"].count(3) == 3
    assert sorted(best["y"]) == [7, 11, 30] and best["common"] == [3, 3, 3]
