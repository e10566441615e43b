"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks, verified exactly.

Words are runs of 0-9, a-z and non-ASCII bytes after lower-casing A-Z. A window that shares no 5-word shingle with any
item has similarity 0, so only windows around a shared shingle, laid as an item lies around it, are looked at, and of
these only those in which enough shingles are some item's. Each gets a fingerprint of BITS bits, cut into BANDS blocks: two
that differ in at most RADIUS bits differ in at most NEAR bits in some block, since BANDS * (NEAR + 1) > RADIUS. So looking
up, in each block's index, all values within NEAR bits finds all items within the radius. The weighted Jaccard similarity
(shingles counted with their number) of each such item and window is then computed exactly.

Items come in blocks of bounded size; each block is one pass over the documents, in which no row needs another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 128
BANDS, NEAR = 8, 3
RADIUS = BANDS * (NEAR + 1) - 1
#: A window this little below the similarity is tried with its ends moved by up to SLACK words.
NEARLY, SLACK = 0.15, 3
#: Bytes of item text that a pass over the documents takes.
ITEM_BYTES = 16 << 20
#: Windows that are looked up at once, and windows laid around shared shingles at once.
LOOKED_UP, LAID = 256, 1 << 20

_WIDTH = BITS // BANDS
#: All values of a block with at most NEAR bits.
_MASKS = np.array([sum(1 << i for i in bits) for n in range(NEAR + 1) for bits in combinations(range(_WIDTH), n)], np.int64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of the shingles' hashes, each as often as it is there: BITS // 64 numbers."""
    words = np.stack([C.mix(shingles ^ np.uint64(i + 1)) for i in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles), bitorder="little").view(np.uint64)


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags: sorted hashes and their numbers."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    least = np.minimum(x[1][i], y[1][j]).sum()
    return float(least / (x[1].sum() + y[1].sum() - least))


def _bag(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(shingles)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo to hi - 1: the range of each number, and the numbers."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(len(of)) + np.repeat(lo - (np.cumsum(n) - n), n)


class Index:
    """Items by shingle and by fingerprint block."""

    def __init__(self, ids: list[int], texts: list[bytes], k: int = SHINGLE_WORDS, similarity: float = SIMILARITY):
        self.ids, self.k, self.least = ids, k, similarity - NEARLY
        lists: list[np.ndarray] = []
        words: list[int] = []
        for a, b, h, sizes in C.hashed(pa.array(texts, pa.binary()), True, C.MARKS, keep=True):
            lists += [x.copy() for x in C.shingle_lists(h, sizes, k)]
            words += sizes.tolist()
        self.widths = sorted({min(k, n) for n in words if n})
        self.full = np.array([i for i, x in enumerate(lists) if len(x)], np.int64)
        full = [lists[i] for i in self.full]
        self.bags = [_bag(x) for x in full]
        self.sizes = np.array([len(x) for x in full], np.int64)
        self.prints = np.array([fingerprint(x) for x in full], np.uint64).reshape(-1, BITS // 64)
        # where in an item of how many words a shingle stands; many items may have it in the same place
        flat = np.concatenate([np.empty(0, np.uint64), *full])
        offset = np.concatenate([np.empty(0, np.int64), *map(np.arange, self.sizes)])
        length = np.repeat(np.array(words, np.int64)[self.full], self.sizes)
        order = np.lexsort((length, offset, flat))
        flat, offset, length = flat[order], offset[order], length[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (offset[1:] != offset[:-1]) | (length[1:] != length[:-1])]) if len(flat) else np.empty(0, bool)
        self.shingles, self.offset, self.length = flat[new], offset[new], length[new]
        self.maybe = np.zeros(1 << 20, bool)  # by the upper bits of a shingle
        self.maybe[(flat >> np.uint64(44)).astype(np.int64)] = True
        self.blocks = []  # of each block: items by value, and where each value begins
        for values in self._cut(self.prints):
            order = np.argsort(values, kind="stable")
            self.blocks.append((order, np.searchsorted(values[order], np.arange((1 << _WIDTH) + 1))))

    @staticmethod
    def _cut(prints: np.ndarray) -> list[np.ndarray]:
        each = 64 // _WIDTH
        return [(prints[:, b // each] >> np.uint64(_WIDTH * (b % each))).astype(np.int64) & ((1 << _WIDTH) - 1) for b in range(BANDS)]

    def candidates(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, place of the item) that differ in at most NEAR bits in some block, and of which neither has so
        many shingles that they can't be alike."""
        pairs = [np.empty(0, np.int64)]
        for values, (order, begin) in zip(self._cut(prints), self.blocks):
            near = values[:, None] ^ _MASKS
            of, at = _runs(begin[near].ravel(), begin[near + 1].ravel())
            window, item = of // len(_MASKS), order[at]
            fit = np.minimum(sizes[window], self.sizes[item]) >= self.least * np.maximum(sizes[window], self.sizes[item])
            pairs.append(window[fit] * len(self.sizes) + item[fit])
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.sizes)))

    def within(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates whose fingerprints differ in RADIUS bits at most: all such, among items of fitting sizes."""
        window, item = self.candidates(prints, sizes)
        close = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[close], item[close]

    def _known(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the shingles that some item has: their places, and where in self.shingles they begin and end."""
        place = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.shingles, shingles[place])
        hi = np.searchsorted(self.shingles, shingles[place], side="right")
        return place[hi > lo], lo[hi > lo], hi[hi > lo]

    def windows(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(row, from word, to word) of item-sized windows around shared shingles, cut at the row's ends, in which enough
        of the shingles are some item's for the window to be like one."""
        ends = np.cumsum(sizes)
        begins, out = ends - sizes, [np.empty((0, 3), np.int64)]
        for width in self.widths:
            if len(h) < width:
                continue
            place, lo, hi = self._known(C.shingle_hashes(h, width))
            row = np.searchsorted(ends, place, side="right")
            whole = place + width <= ends[row]  # else it reaches into the next row
            place, lo, hi, row = place[whole], lo[whole], hi[whole], row[whole]
            hits = np.zeros(len(h) + 1, np.int64)
            hits[place + 1] = 1
            hits = np.cumsum(hits)
            total = np.cumsum(hi - lo)
            a = 0
            while a < len(place):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LAID)))
                of, at = _runs(lo[a:b], hi[a:b])
                of += a
                start = place[of] - self.offset[at]
                first, last = np.maximum(start, begins[row[of]]), np.minimum(start + self.length[at], ends[row[of]])
                n = last - first - self.k + 1
                # shorter items are one shingle, which the window shares
                fine = (n < 1) | (hits[np.maximum(last - self.k + 1, first)] - hits[first] >= self.least * n) if width == self.k else n < 1
                out.append(np.unique(np.stack([row[of], first, last], axis=1)[fine], axis=0))
                a = b
        return np.unique(np.concatenate(out), axis=0)


def _shifted(h: np.ndarray, lo: int, hi: int, begin: int, end: int, bag: tuple, k: int) -> tuple[float, int, int]:
    """The best of the windows whose ends lie up to SLACK words beside lo and hi: where words were left out or put in."""
    near = [(a, b) for a in range(max(begin, lo - SLACK), lo + SLACK + 1) for b in range(hi - SLACK, min(end, hi + SLACK) + 1) if b > a]
    return max((weighted_jaccard(_bag(C.shingle_hashes(h[a:b], k)), bag), -a, b - a) for a, b in near)


def _scan(docs: DataFrame, ids: list[int], texts: list[bytes], similarity: float, k: int) -> DataFrame:
    name = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = C.keep_in_worker(name, lambda: Index(ids, texts, k, similarity))
        for batch in batches:
            doc_ids = batch.column(0)
            out: list[tuple] = []
            for a, b, h, sizes in C.hashed(batch.column(1), True, C.MARKS, keep=True):
                ends = np.cumsum(sizes)
                found: dict[tuple[int, int], tuple] = {}
                spans = index.windows(h, sizes)
                for at in range(0, len(spans), LOOKED_UP):
                    some = spans[at : at + LOOKED_UP].tolist()
                    shingles = [C.shingle_hashes(h[lo:hi], k) for _, lo, hi in some]
                    bags = [_bag(x) for x in shingles]
                    for w, i in zip(*(x.tolist() for x in index.within(np.array([fingerprint(x) for x in shingles]), np.array([len(x) for x in shingles])))):
                        r, lo, hi = some[w]
                        best = (weighted_jaccard(bags[w], index.bags[i]), -lo, hi - lo)
                        if similarity - NEARLY <= best[0] < similarity:
                            best = max(best, _shifted(h, lo, hi, int(ends[r] - sizes[r]), int(ends[r]), index.bags[i], k))
                        if best[0] >= similarity:
                            found[r, i] = max(found.get((r, i), best), best)
                out += [(doc_ids[a + r].as_py(), ids[index.full[i]], v, -lo - int(ends[r] - sizes[r]), n) for (r, i), (v, lo, n) in sorted(found.items())]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], [c.split()[0] for c in FOUND.split(", ")])

    return C.as_bytes(docs, "doc_id").mapInArrow(run, FOUND)


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each document that holds a window like an item, with the best
    window (the first of equal ones).

    Items and documents without words match nothing; an item of fewer than k words is one shingle. Rows with a null
    doc_id are given out with it; items with a null item_id take no part. Rows that repeat a doc_id are given out each.
    Extra columns are ignored. Of the items only one block of about item_bytes is on the driver at a time.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // item_bytes) or 1
    scratch = C.Scratch(spark, "contaminated")
    for block in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        found = _scan(docs, [r.item_id for r in rows], [bytes(r.text) for r in rows], similarity, k)
        if blocks == 1:
            return found
        found.write.mode("append").parquet(scratch.path("found"))
    return spark.read.schema(FOUND).parquet(scratch.path("found"))


def keep_clean(docs: DataFrame, items: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The documents that hold no item. Rows go by their own text, also those that share a doc_id or have none: a document is
    told by a hash of both."""
    own = F.xxhash64(docs["doc_id"], docs["text"])
    found = contaminated(docs.select(own.alias("doc_id"), docs["text"].alias("text")), items)
    found = scratch.save(found.select(F.col("doc_id").alias("found")).distinct(), "found")
    return docs.join(scratch.small(found, "found"), own == found["found"], "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
