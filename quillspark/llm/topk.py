"""Exact top-k search by inner product, over integer vectors.

Vectors are sorted by descending length over the whole table and packed into chunks in that order. They are rotated by the
eigenvectors of their Gram matrix (its size is the dimension squared, whatever the number of rows), so that the first
coordinates hold most of each product. The longest vectors give every query a first k-th best score, its floor. Queries
that need vectors of about the same length to reach their floors share a block; a block goes down the groups of chunks
only as far as the longest vector of a group can still reach one of its floors. Before any vector moves, headers are
compared: a chunk's ranges of the first coordinates and its longest residual (Cauchy-Schwarz) bound all its scores, and
only pairs of a block and a chunk within the bound are joined. There the product over the first coordinates plus the
product of the residual lengths bounds each score, and pairs within that bound are computed in integers.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 1024
#: The longest vectors, which give first thresholds.
SEEDS = 1024
#: Most queries in a block.
QUERY_BLOCK = 256
#: Candidates that are compared at once.
STRETCH = 1024
#: Bytes of a chunk's vectors, about, and chunks in a group of headers.
CHUNK_BYTES, GROUP = 4 << 20, 256
#: Share of the coordinates in the partial product.
HEAD = 4
#: Allowance for rounding in the bounds, relative to the product of lengths.
ROUNDING = 1e-9


#: Lengths whose product is under this have products, and all parts of them, within 64 bits.
MOST = 2.0**62


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v (array<double>, whole numbers), norm2 (double; infinite if it has to be). Rows with a null id, a null vector or a
    null or non-finite component are left out."""
    whole = F.expr(f"forall({column}, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))")
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull()).where(whole)
    # from 2^53 on a double is whole, and floor() would not fit into a long
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    v = F.transform(F.col(column), lambda x: floor(x.cast("double") * scale))
    rows = rows.select(F.col(id_column).alias("id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of the list column, shorter ones filled with zeros."""
    each = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (each == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(each), dim))
    row = np.repeat(np.arange(len(each)), each)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)] = flat
    return out


def _products(x: np.ndarray, q: np.ndarray, x_len: np.ndarray, q_len: float) -> np.ndarray:
    """Exact products of the rows of x, with these lengths, and q: in doubles or 64 bits where all parts fit, else in Python's
    integers."""
    small = (x_len * max(1.0, q_len) < MOST) & (q_len < MOST)
    if (x_len * q_len < 2.0**53).all():  # all partial sums are whole doubles
        return (x @ q).astype(np.int64)
    if small.all():
        return x.astype(np.int64) @ q.astype(np.int64)
    out = np.empty(len(x), object)
    with np.errstate(invalid="ignore"):
        out[small] = (x[small].astype(np.int64) @ q.astype(np.int64)).tolist() if small.any() else []
    whole = [int(b) for b in q]
    out[~small] = [sum(int(a) * b for a, b in zip(row, whole)) for row in x[~small]]
    return out


def _as_float(x: int) -> float:
    """x, or the greatest double under it where it is beyond them."""
    try:
        return float(x)
    except OverflowError:
        return sys.float_info.max if x > 0 else -math.inf


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(g.ravel())], ["i", "j", "g"])

    cells = rows.where(F.col("norm2") < MOST * MOST).select("v").mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # dim * dim
    g = np.zeros((dim, dim))
    for c in cells:
        g[c.i, c.j] = c.g
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return vectors[:, np.argsort(-values)]


class _Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if s.dtype == object:
            order = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k]
        else:
            order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]

    def worst(self, q: int) -> float:
        return _as_float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


def _search(q_ids, q, x_ids, x, rotation, floor, k) -> _Best:
    """floor: scores that k candidates of each query are known to reach, somewhere. A bound that is no number (of lengths
    beyond doubles) passes."""
    best, head = _Best(len(q), k), max(1, q.shape[1] // HEAD)
    with np.errstate(over="ignore", invalid="ignore"):
        qr, xr = q @ rotation, x @ rotation
        q_len, x_len = _lengths(q), _lengths(x)
        order = np.argsort(-x_len, kind="stable")
        q_rest, x_rest = _lengths(qr[:, head:]), _lengths(xr[:, head:])
        limit = floor.copy()
        for a in range(0, len(order), STRETCH):
            part = order[a : a + STRETCH]
            live = np.flatnonzero(~(q_len * x_len[part[0]] * (1 + ROUNDING) + 1e-6 < limit))
            if not len(live):
                break
            bound = qr[live, :head] @ xr[part, :head].T + np.outer(q_rest[live], x_rest[part]) + ROUNDING * np.outer(q_len[live], x_len[part]) + 1e-6
            at, which = np.nonzero(~(bound < limit[live, None]))
            for j, own in zip(*np.unique(at, return_index=True)):
                c = part[which[own : own + np.count_nonzero(at == j)]]
                t = live[j]
                c = c[x_ids[c] != q_ids[t]]
                best.add(t, _products(x[c], q[t], x_len[c], q_len[t]), x_ids[c])
                limit[t] = max(limit[t], best.worst(t))
    return best


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def _order(score: int) -> bytes:
    """Bytes that stand in the order of scores of one sign."""
    data = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    data = len(data).to_bytes(4, "big") + data
    return data if score > 0 else bytes(255 - b for b in data)


def _packed(batches: Iterator[pa.RecordBatch], dim: int, rotation: np.ndarray, rows: int, group: int) -> Iterator[pa.RecordBatch]:
    """Of rows (part, id, v) in descending length: chunks of so many rows with their headers. Of a chunk x: its longest length, the range
    of each head coordinate, and the longest residual."""
    head = max(1, dim // HEAD)
    held: list[pa.RecordBatch] = []
    number = 0

    def chunk(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        x = _matrix(t.column(2).combine_chunks(), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            return packed(t, x, x @ rotation)

    def packed(t: pa.Table, x: np.ndarray, xr: np.ndarray) -> pa.RecordBatch:
        part = t.column(0)[0].as_py()
        low_high = np.concatenate([xr[:, :head].min(0), xr[:, :head].max(0)])
        header = [pa.array([v], k) for v, k in ((part, pa.int64()), (number // group, pa.int64()), (number, pa.int64()), (float(_lengths(x).max()), pa.float64()), (float(_lengths(xr[:, head:]).max()), pa.float64()))]
        return pa.RecordBatch.from_arrays([*header, *_bytes(low_high, t.column(1).to_numpy(), x)], [c.split()[0] for c in CHUNKS.split(", ")])

    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= rows:
            t = pa.Table.from_batches(held)
            yield chunk(t.slice(0, rows))
            number += 1
            held = t.slice(rows).to_batches()
    if sum(map(len, held)):
        yield chunk(pa.Table.from_batches(held))


CHUNKS = "part long, band long, chunk long, longest double, residual double, ranges binary, x_ids binary, x binary"


def _meeting(batches: Iterator[pa.RecordBatch], dim: int, rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows (block, q, floor, part, chunk numbers, longest, residual, ranges), a block and a group of chunk headers
    each: the pairs of block and chunk of which some score may reach its query's floor."""
    head = max(1, dim // HEAD)
    np.seterr(over="ignore", invalid="ignore")
    for batch in batches:
        out: list[tuple] = []
        for block, q, floor, part, headers in zip(*(batch.column(c) for c in range(5))):
            q, floor = np.frombuffer(q.as_buffer(), np.float64).reshape(-1, dim), np.frombuffer(floor.as_buffer(), np.float64)
            qr, length = q @ rotation, _lengths(q)
            up, down, rest = np.maximum(qr[:, :head], 0), np.minimum(qr[:, :head], 0), _lengths(qr[:, head:])
            for h in headers.as_py():
                low, high = np.frombuffer(h["ranges"], np.float64).reshape(2, head)
                bound = up @ high + down @ low + rest * h["residual"]
                bound = np.minimum(bound, length * h["longest"]) + ROUNDING * length * h["longest"] + 1e-6
                if not (bound < floor).all():
                    out.append((block.as_py(), part.as_py(), h["chunk"]))
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["block", "part", "chunk"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scratch: C.Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k rows of vectors with the highest inner product, all
    if there are fewer; both as quantised() gives them. Rows with the query's own id are no candidates. Ties go to the
    smaller id. Of queries that repeat an id the least vector counts; repeated candidates count each. Shorter vectors
    count as filled up with zeros. Products are exact at any length; a score that doesn't fit into 64 bits takes its place
    in the order and is null."""
    spark = vectors.sparkSession
    scratch = scratch or C.Scratch(spark, "topk")
    v = F.col("v").cast("array<double>").alias("v")
    vectors = scratch.save(vectors.select("id", v, "norm2"), "vectors")
    queries = scratch.save(queries.select("id", v).groupBy("id").agg(F.min("v").alias("v")), "queries")
    dim, n = (vectors.agg(F.max(F.size("v"))).first()[0] or 0), queries.count()
    if not dim or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = _rotation(vectors, dim)
    seeds = vectors.orderBy(F.desc("norm2"), "id").limit(SEEDS).select("id", "v").collect()  # SEEDS rows
    seed_ids = np.array([r.id for r in seeds], np.int64)
    seed_rows = np.array([list(r.v) + [0] * (dim - len(r.v)) for r in seeds], np.float64)

    # the hash deals vectors of one length over several partitions
    ordered = vectors.repartitionByRange(F.desc("norm2"), F.xxhash64("id", "v")).sortWithinPartitions(F.desc("norm2"), "id")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("part"), "id", "v")
    rows, group = max(1, CHUNK_BYTES // (8 * dim)), GROUP
    chunks = scratch.save(ordered.mapInArrow(lambda it: _packed(it, dim, rotation, rows, group), CHUNKS), "chunks")
    headers = chunks.groupBy("part", "band").agg(F.max("longest").alias("longest"), F.collect_list(F.struct("chunk", "longest", "residual", "ranges")).alias("headers"))  # GROUP at most
    headers = scratch.save(headers, "headers")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            best = _search(ids, q, seed_ids, seed_rows, rotation, np.full(len(q), -np.inf), k)
            floor = np.array([best.worst(i) for i in range(len(q))])
            length = _lengths(q)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                need = np.where(floor > 0, (floor - 1e-6) / (length * (1 + 2 * ROUNDING)), 0.0)  # a candidate's least length
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(floor), pa.array(np.nan_to_num(need))], ["id", "v", "floor", "need"])

    floored = scratch.save(queries.mapInArrow(floors, "id long, v array<double>, floor double, need double"), "floors")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                some = batch.slice(at, QUERY_BLOCK)
                part, need = some.column(0)[0].as_py(), some.column(4).to_numpy().min()
                block = (part << 32) + number
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([need]), *_bytes(some.column(1).to_numpy(), _matrix(some.column(2), dim), some.column(3).to_numpy())], ["block", "need", "q_ids", "q", "floor"])

    near = floored.repartitionByRange(max(1, -(-n // QUERY_BLOCK)), F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "id")
    near = near.select(F.spark_partition_id().cast("long").alias("part"), "id", "v", "floor", "need")
    blocks = scratch.save(near.mapInArrow(blocked, "block long, need double, q_ids binary, q binary, floor binary"), "blocks")

    # one row for each block and group of GROUP chunks that may matter, by lengths alone; a group stands for GROUP *
    # CHUNK_BYTES of vectors
    reach = scratch.save(headers.select("part", "band", "longest"), "reach")
    reached = blocks.select("block", "need").join(scratch.small(reach, "reach"), F.col("longest") >= F.col("need")).select("block", "part", "band")
    facing = reached.join(blocks.select("block", "q", "floor"), "block").join(headers.select("part", "band", "headers"), ["part", "band"])
    pairs = facing.select("block", "q", "floor", "part", "headers").mapInArrow(lambda it: _meeting(it, dim, rotation), "block long, part long, chunk long")
    pairs = scratch.save(pairs, "pairs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                q_ids, q, floor, x_ids, x = (np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in enumerate((np.int64, np.float64, np.float64, np.int64, np.float64)))
                best = _search(q_ids, q.reshape(-1, dim), x_ids, x.reshape(-1, dim), rotation, floor, k)
                each = [len(s) for s in best.scores]
                scores = [int(s) for s in np.concatenate(best.scores)]
                fits = [s if -(1 << 63) <= s < 1 << 63 else None for s in scores]
                order = [None if f is not None else _order(s) for s, f in zip(scores, fits)]
                side = [0 if f is not None else 1 if s > 0 else -1 for s, f in zip(scores, fits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, each)), pa.array(np.concatenate(best.ids)), pa.array(fits, pa.int64()), pa.array(side, pa.int32()), pa.array(order, pa.binary())], ["query_id", "vec_id", "score", "side", "order"]
                )

    met = pairs.join(chunks.select("part", "chunk", "x_ids", "x"), ["part", "chunk"]).join(blocks.select("block", "q_ids", "q", "floor"), "block")
    found = met.select("q_ids", "q", "floor", "x_ids", "x").mapInArrow(search, "query_id long, vec_id long, score long, side int, order binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("order"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(C.table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("id % 100 = 0"), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] * q.v[i])) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, TRY_CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
