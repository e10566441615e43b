"""Clustering of vectors around centroids, exact in integers (Lloyd's rounds).

Each round builds a vantage-point tree over the centroids, which every task gets (k * dimension numbers). A vector goes
down the tree best first: of the nodes in its queue it opens the one with the least bound, whose vantage centroid it is
compared with exactly, in integers; the triangle inequality bounds what each child can hold. A node is passed over only if
its bound is greater than the best distance, so that equal distances are met and the smaller number wins. Sums are added
up in tasks, then by Spark; only k * dimension sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, DIM, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors that go down the tree together; the queues are arrays of so many rows and a column for each node.
STRETCH = 4096
#: Components whose squared differences, added up over 64 of them, fit into 64 bits; vectors with greater ones are compared
#: in Python's integers.
MOST = 1 << 27
#: Allowance for rounding in bounds, relative to distances. It only lets more nodes be opened.
ROUNDING = 1e-9
_LIMB = 32


class Tree(NamedTuple):
    """Nodes in order of their making, the root first. Of a node: its vantage centroid's number; of its near and its far
    child: the node (-1: none), and the least and the greatest distance of its centroids from the vantage centroid."""

    vantage: list[int]
    children: list[list[tuple[int, float, float]]]


def vantage_tree(c: np.ndarray) -> Tree:
    """The tree over the rows of c. The vantage point of a node is the one of its rows that is farthest from their first."""
    tree = Tree([], [])

    def grow(rows: np.ndarray) -> int:
        far = ((c[rows] - c[rows[0]]) ** 2).sum(1)
        v = rows[np.argmax(far)]
        rest = rows[rows != v]
        d = np.sqrt(((c[rest] - c[v]) ** 2).sum(1).astype(np.float64))
        order = np.argsort(d, kind="stable")
        node, half = len(tree.vantage), len(rest) // 2
        tree.vantage.append(int(v))
        tree.children.append([])
        for part in (order[:half], order[half:]):
            if len(part):
                tree.children[node].append((grow(rest[part]), float(d[part].min()), float(d[part].max())))
        return node

    if len(c):
        grow(np.arange(len(c)))
    return tree


def nearest(x: np.ndarray, c: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x: the number of the nearest row of c (ties: the smallest) and the squared distance, in integers; and
    how many distances were computed."""
    n, nodes = len(x), len(tree.vantage)
    number, least, opened = np.full(n, len(c), np.int64), np.full(n, np.iinfo(np.int64).max, np.int64), 0
    queue = np.full((n, nodes), np.inf)  # the bounds of a vector's nodes that wait
    queue[:, 0] = 0
    live = np.arange(n)
    while len(live):
        first = queue[live].argmin(1)
        bound = queue[live, first]
        some = bound <= np.sqrt(least[live].astype(np.float64)) * (1 + ROUNDING)  # inclusive; an empty queue is at infinity
        live, first = live[some], first[some]
        for node in np.unique(first).tolist():
            r = live[first == node]
            v = tree.vantage[node]
            above = queue[r, node]
            queue[r, node] = np.inf
            d2 = ((x[r] - c[v]) ** 2).sum(1)
            opened += len(r)
            better = (d2 < least[r]) | ((d2 == least[r]) & (v < number[r]))
            number[r[better]], least[r[better]] = v, d2[better]
            d = np.sqrt(d2.astype(np.float64))
            for child, low, high in tree.children[node]:
                queue[r, child] = np.maximum(above, np.maximum(d - high, low - d) - ROUNDING * (d + high))
    return number, least, opened


def _whole(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x]


class _Assign:
    """Assigns batches of vectors to centroids of any size."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.small = all(abs(v) <= MOST for row in centroids for v in row)
        self.c = np.array(centroids, np.int64) if self.small else None
        self.tree = vantage_tree(self.c) if self.small else None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """x: whole numbers as doubles. Of each row the number, the squared distance (0 where it's in the list), and a list
        (row, number, squared distance) of the rows that were too large for 64 bits."""
        fits = (np.abs(x) <= MOST).all(1) & self.small
        number, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        small = np.flatnonzero(fits)
        for a in range(0, len(small), STRETCH):
            r = small[a : a + STRETCH]
            number[r], least[r], _ = nearest(x[r].astype(np.int64), self.c, self.tree)
        large = []
        for r in np.flatnonzero(~fits).tolist():
            row = _whole(x[r : r + 1])[0]
            d, i = min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(self.centroids))
            number[r] = i
            large.append((r, i, d))
        return number, least, large


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)


def _limbs(v: int) -> list[int]:
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << _LIMB) - 1)))
        v >>= _LIMB
    return out


def _sums(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors: their number and the exact sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, total, extra = _Assign(centroids), np.zeros((len(centroids), dim + 1), np.int64), {}
        for batch in batches:
            x = _matrix(batch.column(0), dim, scale)
            number, _, large = assign(x)
            small = np.ones(len(x), bool)
            small[[r for r, _, _ in large]] = False
            for i in np.unique(number).tolist():
                mine = (number == i) & small
                total[i, :dim] += x[mine].astype(np.int64).sum(0)
                total[i, dim] += np.count_nonzero(number == i)
            for r, i, _ in large:
                for j, v in enumerate(_whole(x[r : r + 1])[0]):
                    for limb, part in enumerate(_limbs(v)):
                        extra[i, j, limb] = extra.get((i, j, limb), 0) + part
        i, j = np.nonzero(total)
        rows = [(*at, 0, s) for at, s in zip(zip(i.tolist(), j.tolist()), total[i, j].tolist())] + [(*at, s) for at, s in extra.items()]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["i", "j", "limb", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "i long, j long, limb long, s long")
    got = parts.groupBy("i", "j", "limb").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()  # k * (dim + 1) rows; more limbs only for huge numbers
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        n, sums = out.get(r.i, (0, [0] * dim))
        if r.j == dim:
            n += int(r.s)
        else:
            sums[r.j] += int(r.s) << (_LIMB * r.limb)
        out[r.i] = n, sums
    return out


def usable(vectors: DataFrame, dim: int = DIM, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows with exactly dim components, none of them null or non-finite."""
    e = F.col(f"`{column}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(e.isNotNull()).where(F.size(e) == dim).where(finite)
    return rows.select(F.col(f"`{id_column}`").alias("vec_id"), e.alias("embedding"))


def starts(vectors: DataFrame, k: int, seed: int, scale: int = SCALE) -> list[list[int]]:
    """The k vectors of least lower-case hexadecimal sha256 of "seed:vec_id", in that order; of equal ids the lesser vector
    first. Vectors without an id are none of them."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()  # k rows
    return _whole(np.floor(scale * np.array([r.embedding for r in first], np.float64)))


def cluster(vectors: DataFrame, scratch: C.Scratch, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row of vectors (vec_id, embedding) as
    usable() gives them; components count as floor(scale * x).

    Rows that repeat an id are vectors each; a null vec_id is given back as null. With fewer than k vectors there are as
    many centroids as vectors with an id; without any the result is empty. Centroids that lose all vectors stay. k * dim
    numbers are held by the driver and every task. A distance or sum over 2^63 - 1 is null. Extra columns are ignored.
    """
    spark = scratch.spark
    centroids = starts(vectors, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        found = _sums(vectors, centroids, dim, scale)
        moved = [[s // found[i][0] for s in found[i][1]] if i in found else c for i, c in enumerate(centroids)]
        if moved == centroids:  # all further rounds would be the same
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assign(centroids)
        for batch in batches:
            number, least, large = assign(_matrix(batch.column(1), dim, scale))
            beyond = np.zeros(len(number), bool)
            for r, _, d in large:
                beyond[r] = d > np.iinfo(np.int64).max
                least[r] = 0 if beyond[r] else d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(least, mask=beyond)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = scratch.save(vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows
    fits = lambda s, lost: None if lost or s > np.iinfo(np.int64).max else int(s)
    total = fits(sum(int(r.s or 0) for r in each), sum(r.lost for r in each))
    about = [(r.cluster, fits(int(r.s or 0), r.lost), total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in each]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(usable(C.table(spark, sf_dir, "embeddings")), C.Scratch(spark, "clustering"))


def _oracle() -> str:
    """All rounds written out; exact integers as HUGEINT."""
    assign = """a{r} AS MATERIALIZED (
  SELECT vid, arg_min(i, (d, i)) AS i, min(d) AS d FROM (
    SELECT vid, c.i, list_sum(list_transform(range(1, {dim} + 1), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS d FROM v, c{r} c)
  GROUP BY vid)"""
    move = """c{s} AS MATERIALIZED (
  SELECT c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT i, list(CASE WHEN s % n < 0 THEN (s - s % n - n) // n ELSE (s - s % n) // n END ORDER BY j) AS v FROM (
      SELECT a.i, j, sum(v.v[j]) AS s, count(*) AS n FROM a{r} a JOIN v USING (vid), (SELECT unnest(range(1, {dim} + 1)) AS j) GROUP BY a.i, j)
    GROUP BY i) m USING (i))"""
    steps = []
    for r in range(ROUNDS):
        steps += [assign.format(r=r, dim=DIM), move.format(r=r, s=r + 1, dim=DIM)]
    steps.append(assign.format(r=ROUNDS, dim=DIM))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v FROM (
    SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})),
{",\n".join(steps)}
SELECT v.vec_id, a.i::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.i))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (vid) JOIN c{ROUNDS} c ON c.i = a.i
"""


ORACLE = _oracle()
