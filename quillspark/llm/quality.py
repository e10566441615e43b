"""Importance resampling of documents towards a target text.

Two generative models of hashed word and word-pair counts are fitted: one of the target (labelled documents of quality
that are not toxic), one of all documents. A document's log weight is the least log ratio of their likelihoods over
its windows of consecutive words, so that a few words that the target lacks are not outweighed by a long ordinary text.
Documents are sampled without replacement with probabilities that grow with the weight by Gumbel top-k: each key is the
weight over the temperature plus Gumbel noise from a hash, and the k highest keys stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Hashed features of the models: words, then word pairs. Words have so many buckets that a rare one is seldom merged with
#: a common one.
WORDS, PAIRS = 1 << 20, 1 << 16
BUCKETS = WORDS + PAIRS
#: Added to each bucket's count in the target, and to the count that all documents make one expect there: what the
#: target has hardly had a chance to show doesn't speak against a document. Most pairs of a text are new to any target.
WORD_SMOOTHING, PAIR_SMOOTHING = 5.0, 200.0
#: Words of a window; a shorter text is one window.
WINDOW = 50
#: Keys are weight / TEMPERATURE + noise. Weights are in nats (natural logarithms of likelihood ratios), so at 1 each draw
#: takes a document with a probability in proportion to its likelihood ratio, at 0.5 to the ratio's square.
TEMPERATURE = 0.5
#: k counts the documents whose weight is at least this quantile of the target's weights. For that, the weight of a
#: target document is taken without its own counts in the target, as for a document that has no label.
TARGET_QUANTILE = 0.01
#: The k-th key is found by histograms of so many bins; that many keys of the last bin are read.
BINS = 1024


def _features(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of all rows: the buckets of the word and of the pair that it ends (BUCKETS: none, it begins its row),
    and its row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    f = np.full((2, len(h)), BUCKETS, np.int64)
    f[0] = C.mix(h) % np.uint64(WORDS)
    if len(h) > 1:
        pair = row[1:] == row[:-1]
        f[1, 1:][pair] = WORDS + (C.shingle_hashes(h, 2)[pair] % np.uint64(PAIRS)).astype(np.int64)
    return f, row


def _worst(w: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least sum of w over WINDOW consecutive words of each row; of all its words if there are fewer."""
    total = np.concatenate([[0.0], np.cumsum(w)])
    end = np.cumsum(sizes)
    least = total[np.minimum(end - sizes + WINDOW, end)] - total[end - sizes]
    begin = np.flatnonzero(np.arange(len(w)) + WINDOW <= end[row])
    np.minimum.at(least, row[begin], total[begin + WINDOW] - total[begin])
    return least


def models(docs: DataFrame, target: Column) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: its count in the target, and what its count in all documents makes one expect there. target tells
    a document of the target (null: no). Counts are over all documents; BUCKETS sums at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            chosen = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, h, sizes in C.hashed(batch.column(1), classes=C.PIECES):
                f, row = _features(h, sizes)
                np.add.at(total[0], f, 1)
                np.add.at(total[1], f[:, chosen[a:b][row]], 1)
        some = np.flatnonzero(total[0, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in total)], ["f", "raw", "target"])

    chosen = docs.select(F.coalesce(target, F.lit(False)).alias("chosen"), F.col("text").cast("binary").alias("text"))
    sums = chosen.mapInArrow(count, "f long, raw long, target long").groupBy("f").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    f = sums.column("f").to_numpy()
    raw[f], wanted[f] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    share = [wanted[x].sum() / max(1.0, raw[x].sum()) for x in (slice(WORDS), slice(WORDS, None))]
    return wanted, raw * np.repeat(share, (WORDS, PAIRS))


def weights(docs: DataFrame, target: np.ndarray, expected: np.ndarray) -> DataFrame:
    """doc_id, good, whole, n_features, log_weight (0 without words) and unseen_weight of each row of (doc_id, good, whole,
    text): of target documents (good) the weight without their own counts, else null. n_features counts words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smoothing = np.repeat([WORD_SMOOTHING, PAIR_SMOOTHING], (WORDS, PAIRS))
        ratios = np.append(np.log((target + smoothing) / (expected + smoothing)), 0.0)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, h, sizes in C.hashed(batch.column(3), classes=C.PIECES):
                f, row = _features(h, sizes)
                n = np.bincount(row[np.newaxis].repeat(2, 0)[f < BUCKETS], minlength=b - a)
                own = f < BUCKETS
                own &= chosen[a:b][row]
                key, place, count = np.unique((row * BUCKETS + f)[own], return_inverse=True, return_counts=True)
                bucket = key % BUCKETS
                without = ratios[f]
                without[own] = np.log((target[bucket] - count + smoothing[bucket]) / (expected[bucket] + smoothing[bucket]))[place]
                w, unseen = _worst(ratios[f].sum(0), row, sizes), _worst(without.sum(0), row, sizes)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:3]), pa.array(n), pa.array(w), pa.array(unseen, mask=~chosen[a:b])], ["doc_id", "good", "whole", "n_features", "log_weight", "unseen_weight"]
                )

    return C.as_bytes(docs, "doc_id", "good", "whole").mapInArrow(run, "doc_id long, good boolean, whole long, n_features long, log_weight double, unseen_weight double")


def gumbel(*by: str | Column) -> Column:
    """Standard Gumbel noise, the same for the same values."""
    unit = (F.shiftrightunsigned(F.xxhash64(*by), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(unit))


def kth_highest(keys: DataFrame, k: int, column: str = "key") -> float | None:
    """The k-th highest value of the column, null if there are fewer rows; by histograms between narrowing bounds."""
    x = F.col(column)
    low, high, n = keys.agg(F.min(x), F.max(x), F.count(x)).first()
    if k <= 0 or n < k:
        return None
    above = 0  # rows over the upper bound
    while low < high:
        inside = keys.where((x >= low) & (x <= high))
        width = (high - low) / BINS
        place = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect(), key=lambda r: -r.bin)
        for r in bins:
            if above + r.n >= k:
                if (low, high) == (r.low, r.high):  # two neighbouring numbers
                    return high if above + keys.where(x == high).count() >= k else low
                low, high = r.low, r.high
                break
            above += r.n
    return low


def sampling_key(temperature: float = TEMPERATURE, seed: Column | int = 0) -> Column:
    """Of rows with doc_id, n_features and log_weight: the k rows with the highest keys are a sample without replacement,
    drawn one by one with probabilities in proportion to exp(log_weight / temperature)."""
    return F.col("log_weight") / temperature + gumbel(F.lit(seed) if isinstance(seed, int) else seed, "doc_id", "n_features")


def resample(docs: DataFrame, labels: DataFrame, scratch: C.Scratch, k: int | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, key of the documents that stay: the k highest keys; equal ones at the end stay together. whole, a
    hash of the text, tells rows that share a doc_id apart.

    labels: doc_id, quality, toxic; where rows repeat a doc_id, any bad label counts. k: None counts the documents whose
    weight is at least that of all but TARGET_QUANTILE of the target; without a target all stay. Null and
    empty texts have weight 0. Another seed draws another sample. Rows that repeat a doc_id and text have equal keys and stay or go together. Extra columns
    are ignored.
    """
    good = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    good = scratch.save(good.where("doc_id is not null"), "labels")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("whole")).join(scratch.small(good, "labels"), "doc_id", "left")
    rows = weights(marked, *models(marked, F.col("good"))).withColumn("key", sampling_key(temperature, seed))
    rows = scratch.save(rows, "weights")
    if k is None:
        least = rows.where("good").agg(F.percentile_approx("unseen_weight", TARGET_QUANTILE, 10_000)).first()[0]
        k = rows.count() if least is None else rows.where(F.col("log_weight") >= least).count()
    bar = kth_highest(rows, k)
    if bar is not None:
        rows = rows.where(F.col("key") >= bar)
    elif k <= 0:
        rows = rows.limit(0)
    return rows.select("doc_id", "log_weight", "key", "whole")


def keep_good(docs: DataFrame, labels: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The documents that resample() keeps, with their own columns. A document is a doc_id, null or not, and a text: rows that
    repeat both stay or go together, rows that share only the doc_id each by their own key."""
    kept = resample(docs, labels, scratch).select(F.col("doc_id").alias("kept"), "whole").distinct()
    kept = scratch.save(kept, "kept")
    same = docs["doc_id"].eqNullSafe(kept["kept"]) & (F.xxhash64(docs["text"]) == kept["whole"])
    return docs.join(scratch.small(kept, "kept"), same, "left_semi")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), C.Scratch(spark, "quality")).drop("whole")
