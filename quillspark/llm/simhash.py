"""SimHash near-duplicates: 64-bit fingerprints that differ in few bits, found exactly.

Fingerprints are cut into blocks. Two that differ in at most RADIUS bits agree in all but RADIUS blocks at least, so for
some choice of BLOCKS - RADIUS blocks they have the same key and meet in a join on it; there their Hamming distance is
verified. Equal fingerprints are one row from the start. Keys that more than CROWD fingerprints share are found by counts
before anything is dealt: members of those don't meet in pairs. Each is put under every value within RADIUS / 2 flips of
the bits that the key leaves open; two within the radius share one of those values, and as few members as there are such
flips can share one, so the work of a crowded key is in proportion to its members, wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, SEED, RADIUS, BLOCKS = 3, 42, 2, 4
#: Fingerprints of one key that are compared with each other in one task.
CROWD = 256
#: Bytes of a text whose words are cut at once, and hashes whose bits are counted at once.
PIECE, STRETCH = 1 << 20, 1 << 16
_WHITE = (0x20, *range(0x09, 0x0E))


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of so many words of a text (fewer words: of all of them), A-Z lower-cased, joined by spaces; in
    pieces, so that long texts take little memory."""
    held: list[bytes] = []  # the last words of the piece before
    begin, done = 0, False
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        held += text[begin:end].lower().split()
        begin = end
        if len(held) >= words:
            done = True
            joined = b" ".join(held)
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist())
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(held) - words + 1)
            held = held[len(held) - words + 1 :]
    if held and not done:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), STRETCH):
        total += np.unpackbits(h[a : a + STRETCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero without words."""
    n, total = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words, seed):
        n += len(h)
        total += bit_counts(h)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long) of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t) for t in C.texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    return C.as_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, f long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of blocks - radius blocks, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(one, blocks - radius)]


def _met(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Of rows (k, key, f) sorted by k and key: the links within each key, from each fingerprint to the least one that it is
    joined with there. Holds the members of one key: CROWD at most."""

    def joined(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = f.view(np.uint64)
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
        least = np.arange(len(f))
        while True:
            new = np.where(near, least[None, :], len(f)).min(1)
            if (new == least).all():
                break
            least = new
        own = np.flatnonzero(least != np.arange(len(f)))
        return f[own], f[least[own]]

    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        k, key, f = (batch.column(c).to_numpy() for c in range(3))
        if not len(k):
            continue
        cut = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
        begins, ends = [0, *cut.tolist()], [*cut.tolist(), len(k)]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(begins, ends):
            if last != (k[a], key[a]):
                if sum(map(len, held)) > 1:
                    out.append(joined(np.concatenate(held)))
                held, last = [], (k[a], key[a])
            held.append(f[a:b])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])
    if sum(map(len, held)) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(np.concatenate(held))], ["a", "b"])


def near_links(found: DataFrame, scratch: C.Scratch, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) of a table of different fingerprints f whose components are those of all pairs that differ in at most
    radius bits."""
    if radius % 2 or not 0 < radius < blocks:
        raise ValueError("radius must be even and less than blocks")
    masks = block_masks(blocks, radius)
    keyed = found.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(F.lit(m)) for m in masks)))).withColumnsRenamed({"pos": "k", "col": "key"})
    counts = keyed.groupBy("k", "key").agg(F.count("*").alias("n"))
    crowded = scratch.save(counts.where(F.col("n") > CROWD).select("k", "key"), "crowded")
    hot = scratch.small(crowded, "crowded")
    near = keyed.join(hot, ["k", "key"], "left_anti").select("k", "key", "f")
    near = near.repartition("k", "key").sortWithinPartitions("k", "key")
    links = scratch.save(near.mapInArrow(lambda it: _met(it, radius), "a long, b long"), "near")
    if crowded.limit(1).count():
        open_bits = [[1 << i for i in range(64) if not m >> i & 1] for m in masks]
        flips = [sorted(int(np.array(sum(c), np.uint64).view(np.int64)) for n in range(radius // 2 + 1) for c in combinations(bits, n)) for bits in open_bits]
        by_key = F.array(*(F.array(*(F.lit(x) for x in each)) for each in flips))
        spread = keyed.join(hot, ["k", "key"], "left_semi").select("k", "f", F.explode(by_key[F.col("k")]).alias("flip"))
        spread = spread.select("k", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("value"))
        least = F.min("f").over(Window.partitionBy("k", "value"))  # as many rows as there are flips, at most
        stars = spread.select(F.col("f").alias("a"), least.alias("b")).where("a <> b").distinct()
        links = links.union(scratch.save(stars, "stars"))
    return links


def near_duplicates(docs: DataFrame, scratch: C.Scratch, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id: the smallest doc_id reachable by links between
    fingerprints that differ in at most radius bits.

    Null and empty texts have fingerprint zero and are linked like others. Rows that repeat a doc_id each have their own
    fingerprint and are joined by fingerprints only. Rows with a null doc_id get a fingerprint, take no part in links and
    have a null component_id. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = scratch.save(fingerprints(docs), "fingerprints")
    classes = scratch.save(rows.where("doc_id is not null").groupBy("f").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(classes.select("f"), scratch, radius, blocks)
    labels = C.components(links, scratch, "fingerprints-joined")
    named = classes.join(labels.withColumnRenamed("id", "f"), "f", "left").select("f", "least", F.coalesce("label", "f").alias("label"))
    named = scratch.save(named, "named")
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    first = scratch.save(first, "first")
    ids = scratch.save(named.join(scratch.small(first, "first"), "label").select("f", "component_id"), "ids")
    out = rows.join(scratch.small(ids, "ids"), "f", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), C.Scratch(spark, "simhash"))
