"""Helpers that the text operators share: scratch tables, word splitting and hashing inside tasks, connected components."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many bytes (measured on their written files) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Tables of links or labels up to this many bytes (measured likewise) are worked on in one task, without exchanges.
FEW_BYTES = 1 << 20
#: Rows in an Arrow batch of texts, where the session has Spark's own default, which is meant for short rows.
BATCH_ROWS, _DEFAULT_ROWS = 1000, "10000"
#: Bytes of text that are handled in one stretch of numpy work; a longer document makes a longer stretch.
STRETCH_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may do without that
    setting, and gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small; a size that the session was given stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == _DEFAULT_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive lost executors. drop() removes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def _fs(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def size(self, table: str) -> int:
        fs, path = self._fs(table)
        return fs.getContentSummary(path).getLength()

    def drop(self, *tables: str) -> None:
        for table in tables:
            fs, path = self._fs(table)
            fs.delete(path, True)

    def small(self, df: DataFrame, table: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """df, which was saved as table, with a broadcast hint if its files are within the limit."""
        return F.broadcast(df) if self.size(table) <= limit else df

    def few(self, df: DataFrame, table: str) -> DataFrame:
        """df, which was saved as table, in one partition if its files are within FEW_BYTES."""
        return df.coalesce(1) if self.size(table) <= FEW_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inside tasks -------------------------------------------------------------------------------------------------


_kept: dict = {}


def keep_in_worker(key: object, make):
    """What make() gives, kept by the worker process for later tasks with the same key. Tasks of another operator drop
    it, so that a worker doesn't carry caches it has no use for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k consecutive words; of all of them together if there are fewer than k; none if there are no words."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = h[: n - width + 1].copy()
    for i in range(1, width):
        out = out * _MULT + h[i : n - width + 1 + i]
    return mix(out + np.uint64(width))


def sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def as_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as UTF-8 bytes in a column named text; other columns are not read."""
    short_batches(df.sparkSession)
    return df.select(*keep, F.col(text).cast("binary").alias("text"))


#: Classes of bytes; a word is a run of one class, and class 0 separates. Here: what ASCII white space separates.
SPACES = (~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])).astype(np.uint8)
#: Letters, digits and non-ASCII bytes; all other bytes separate.
MARKS = np.isin(np.arange(256), [*b"0123456789", *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]).astype(np.uint8)
#: As MARKS, but runs of marks other than white space are words too.
PIECES = np.where(MARKS == 1, 1, np.where(SPACES == 1, 2, 0)).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_P = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _P and of its inverse, for n places at least."""
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(max(n, STRETCH_BYTES + (STRETCH_BYTES >> 2)), p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _segments(edge: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STRETCH_BYTES that begin and end at edges, so that no word is cut."""
    begin, n = 0, len(edge)
    while begin < n:
        end = begin + STRETCH_BYTES
        if end < n:
            near = np.flatnonzero(edge[begin + 1 : end + 1])
            if len(near):
                end = begin + 1 + int(near[-1])
            else:
                later = np.flatnonzero(edge[end:])
                end = end + int(later[0]) if len(later) else n
        yield begin, min(end, n)
        begin = end


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, without copying them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if column.type == pa.large_binary() else np.int32
    offsets = np.frombuffer(column.buffers()[1] or bytes(8), kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def hashed(column: pa.Array, fold: bool = False, classes: np.ndarray = SPACES, keep: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Over stretches of rows a to b of a binary column: (a, b, hashes of all their words in order, words per row).
    fold lower-cases A-Z. A word's hash is a polynomial of its bytes modulo 2^64 together with its length, scrambled;
    it is the same in every task. Null is empty. keep: what keep_in_worker() holds stays."""
    if not keep:
        _kept.clear()
    offsets, data = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STRETCH_BYTES)) - 1)
        buf = data[offsets[a] : offsets[b]]
        begin = offsets[a : b + 1] - offsets[a]
        if fold:
            buf = _FOLD[buf]
        n = len(buf)
        kind = classes[buf]
        inside = kind > 0
        edge = np.zeros(n + 1, bool)  # a word can begin here: where the class changes or a row begins
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[begin] = True
        edge[n] = True
        s, e = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
        parts = []
        for x, y in _segments(edge[:-1]) if n > 2 * STRETCH_BYTES else ((0, n),):
            power, inverse = _power_tables(y - x + 1)
            total = np.zeros(y - x + 1, np.uint64)
            np.cumsum((buf[x:y].astype(np.uint64) + np.uint64(1)) * power[: y - x], out=total[1:])
            i, j = np.searchsorted(s, (x, y))
            si, ei = s[i:j] - x, e[i:j] - x
            parts.append(mix((total[ei] - total[si]) * inverse[si] + (ei - si).astype(np.uint64) * _MULT))
        yield a, b, parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts]), np.diff(np.searchsorted(s, begin))
        a = b


def shingle_lists(h: np.ndarray, sizes: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """shingle_hashes of each row's words."""
    ends = np.cumsum(sizes)
    all_k = shingle_hashes(h, k) if len(h) >= k else h[:0]
    return [all_k[e - n : e - k + 1] if n >= k else shingle_hashes(h[e - n : e], k) for e, n in zip(ends.tolist(), sizes.tolist())]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# ---- connected components -----------------------------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label) of every id in links (a, b): label is the smallest id that is reachable. Each round takes the least
    label among neighbours and then follows that label once more; rounds are written to the shared folder, and only
    the count of changed labels comes to the driver."""
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(links.select(F.explode(turned).alias("e")).select("e.a", "e.b").distinct(), f"{name}-edges")
    both = scratch.few(both, f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    labels = scratch.few(labels, f"{name}-0")
    spark, k = scratch.spark, 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("least"))
        up = labels.select(F.col("id").alias("least"), F.col("label").alias("above"))
        new = step.join(up, "least", "left").select("id", F.least("least", F.coalesce("above", "least")).alias("label"), F.col("label").alias("was"))
        new = scratch.few(scratch.save(new, f"{name}-{k + 1}"), f"{name}-{k + 1}")
        changed = new.where("label <> was").limit(1).count()
        scratch.drop(f"{name}-{k}")
        labels, k = new.select("id", "label"), k + 1
        if not changed:
            scratch.drop(f"{name}-edges")
            return spark.read.parquet(scratch.path(f"{name}-{k}")).select("id", "label")
