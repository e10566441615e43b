"""Ranked lexical search over hashed max-sketches.

The index has a row for each document: its number of terms and a sketch of two rows of WIDTH coordinates, each the greatest
number of times that a term hashed to it occurs. A term's impact in a document only grows with its occurrences, so a
coordinate stands for the greatest impact folded into it, and the lesser of a term's two coordinates bounds its impact.

A batch of items is looked up in all sketches at once, which bounds every score from above. The documents of each item's
highest bounds are rescored exactly, which gives the item a threshold: the k-th best exact score. All documents whose
bounds reach it are then rescored in descending order of bounds, as long as they reach the threshold, which rises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Coordinates in each of a sketch's two rows. More coordinates merge fewer terms and give closer bounds.
WIDTH = 1024
TOP = 20
#: Documents of the highest bounds that are rescored first, for each item and task.
FIRST = 2 * TOP
#: Bytes of item terms in a batch; more items take more batches, each a pass over sketches and texts.
BATCH_BYTES = 4 << 20
#: Items that are looked up together, sketches that they are looked up in, and terms that are looked up at once.
ITEMS, SKETCHES, TERMS = 128, 512, 4096
#: A coordinate of so many occurrences or more.
MANY = 255
#: Bounds are computed in single precision: relative allowance, far over their rounding.
ROUNDING = 1e-4


def _occurrences(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the hashes of all rows' terms: row, term and occurrences of each row's different terms."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def places(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A term's coordinates in the two rows of a sketch."""
    return (h % np.uint64(width)).astype(np.int64), width + (h // np.uint64(width) % np.uint64(width)).astype(np.int64)


def sketched(h: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sketches of rows of terms."""
    out = np.zeros((len(sizes), 2 * width), np.uint8)
    row, term, tf = _occurrences(h, sizes)
    tf = np.minimum(tf, MANY).astype(np.uint8)
    for at in places(term, width):
        np.maximum.at(out, (row, at), tf)
    return out


def build(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The index of docs: doc_id, n (terms) and sketch, a row for each document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, sizes in C.hashed(batch.column(1), fold=True, classes=C.MARKS):
                some = np.flatnonzero(sizes)
                if len(some):
                    s = sketched(h, sizes[some], width)
                    data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(len(some) + 1, dtype=np.int32) * 2 * width), pa.py_buffer(s)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(sizes[some]), data], ["doc_id", "n", "sketch"])

    return C.as_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, n long, sketch binary")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (its hash), n: the different terms of each item and how often it has them. Of rows that repeat an
    item_id the one of least text counts; rows without id or terms give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, sizes in C.hashed(batch.column(1), fold=True, classes=C.MARKS):
                row, term, n = _occurrences(h, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(n)], ["item_id", "term", "n"])

    one = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return C.as_bytes(one, "item_id").mapInArrow(run, "item_id long, term long, n long")


def norm(n: int, docs: int, total: int) -> int:
    """A document's m, of its terms, all documents and all terms."""
    return 75 + (25 * n * docs) // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Batch:
    """Some items: their terms in order of hash with weights, and which items have them how often."""

    def __init__(self, table: pa.Table, df: dict[int, int], docs: int, total: int, width: int = WIDTH):
        self.docs, self.total = docs, total
        ids, terms, n = (table.column(c).to_numpy() for c in ("item_id", "term", "n"))
        self.items, item = np.unique(ids, return_inverse=True)
        self.terms, place = np.unique(terms.view(np.uint64), return_inverse=True)
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(int(t), 0) + 1))) for t in self.terms.view(np.int64)]
        value = np.array(weight, np.int64)[place] * n
        order = np.argsort(place, kind="stable")
        self.by_term, self.value = item[order], value[order]  # of each term: items, and weight times occurrences
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.terms)))])
        order = np.lexsort((place, item))
        cut = np.cumsum(np.bincount(item, minlength=len(self.items)))[:-1]
        self.of_item = list(zip(np.split(place[order], cut), np.split(value[order].astype(np.float32), cut)))
        self.low, self.high = places(self.terms, width)

    def norms(self, n: np.ndarray) -> np.ndarray:
        return np.array([norm(int(x), self.docs, self.total) for x in n], np.int64)

    def bounds(self, sketches: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of ITEMS items at a time, from the first: no score of a document (column) is over its bound for an item (row)."""
        t = np.ascontiguousarray(sketches.T)
        m = (0.012 * self.norms(n)).astype(np.float32)
        for a in range(0, len(self.items), ITEMS):
            some = self.of_item[a : a + ITEMS]
            need = np.unique(np.concatenate([p for p, _ in some]))
            out = np.zeros((len(some), len(n)), np.float32)
            for c in range(0, len(need), TERMS):
                part = need[c : c + TERMS]
                tf = np.minimum(t[self.low[part]], t[self.high[part]]).astype(np.float32)
                with np.errstate(divide="ignore", invalid="ignore"):
                    most = np.where(tf == MANY, np.float32(1e6), 1e6 * tf / (tf + m))
                for i, (p, v) in enumerate(some):
                    x, y = np.searchsorted(p, (part[0], part[-1] + 1))
                    out[i] += v[x:y] @ most[np.searchsorted(part, p[x:y])]
            yield a, out * np.float32(1 + ROUNDING)

    def scores(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Exact scores: a row for each row of terms, a column for each item."""
        row, term, tf = _occurrences(h, sizes)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        row, at, tf = row[known], at[known], tf[known]
        each = impact(tf, self.norms(sizes)[row])
        times = self.begin[at + 1] - self.begin[at]
        which = np.repeat(self.begin[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = np.zeros((len(sizes), len(self.items)), np.int64)
        np.add.at(out, (np.repeat(row, times), self.by_term[which]), self.value[which] * np.repeat(each, times))
        return out


class _Top:
    """The k highest (score, doc_id) of each item so far, ties to the smaller doc_id."""

    def __init__(self, items: int, k: int, kind: type = np.int64):
        self.k, self.scores, self.ids = k, [np.empty(0, kind)] * items, [np.empty(0, np.int64)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[item], self.ids[item] = s[order], i[order]

    def rows(self, items: np.ndarray) -> pa.RecordBatch:
        each = [len(x) for x in self.scores]
        cols = [np.repeat(items, each), np.concatenate(self.ids), np.concatenate(self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["item_id", "doc_id", "score"])


def _sketches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, terms and sketches of SKETCHES rows at a time."""
    offsets, data = C.buffers(batch.column(2))
    ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for a in range(0, len(batch), SKETCHES):
        b = min(a + SKETCHES, len(batch))
        yield ids[a:b], n[a:b], data[offsets[a] : offsets[b]].reshape(b - a, -1)


def _frequencies(docs: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Of each of these terms (sorted hashes): the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for _, _, h, sizes in C.hashed(batch.column(0), fold=True, classes=C.MARKS):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                known = terms[at] == h
                row = np.repeat(np.arange(len(sizes)), sizes)[known]
                total += np.bincount(np.unique(row * len(terms) + at[known]) % len(terms), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    counts = C.as_bytes(docs).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counts.collect()}  # a batch's terms at most


def _best(rows: DataFrame, value: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(value), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def _rescored(docs: DataFrame, chosen: DataFrame, batch: Batch, limits: np.ndarray, k: int) -> DataFrame:
    """item_id, doc_id, score: of each task's documents the k best of each item, of those whose score reaches its limit.
    chosen: doc_id, reach: the greatest of a document's bounds, each as a share of its item's limit. A task goes on in
    descending order of reach until the k-th best scores that it has found leave no item within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, least = _Top(len(batch.items), k), limits.copy()
        for rows in batches:
            ids, reach = rows.column(0).to_numpy(), rows.column(2).to_numpy()
            for a, b, h, sizes in C.hashed(rows.column(1), fold=True, classes=C.MARKS):
                if (reach[a] * limits < least).all():
                    break
                scores = batch.scores(h, sizes)
                for item in np.flatnonzero((scores >= least).any(0)).tolist():
                    good = np.flatnonzero(scores[:, item] >= least[item])
                    top.add(item, scores[good, item], ids[a:b][good])
                    if len(top.scores[item]) == k:
                        least[item] = max(least[item], top.scores[item][-1])
        yield top.rows(batch.items)

    rows = C.as_bytes(docs, "doc_id").join(chosen, "doc_id").select("doc_id", "text", "reach").sortWithinPartitions(F.desc("reach"))
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, docs: DataFrame, items: DataFrame, scratch: C.Scratch, k: int = TOP, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of highest score, of those with a score over 0, equal scores
    by ascending doc_id. index: what build() gives for docs and this width, saved.

    Of items that repeat an item_id the one of least text counts; items without id or terms have no rows. Rows of docs that
    repeat a doc_id are documents each; rows with a null doc_id count in the corpus' figures and aren't ranked. Null and
    empty texts, and empty tables, give no rows. Terms are told apart by 64-bit hashes. Items come in batches of
    BATCH_BYTES, each a pass over the texts and two over the sketches. Extra columns are ignored.
    """
    spark = scratch.spark
    n_docs, total = index.agg(F.count("*"), F.sum("n")).first()
    terms = scratch.save(item_terms(items), "items")
    batches = -(-scratch.size("items") // BATCH_BYTES)
    found = []
    for number in range(batches if total else 0):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == number).orderBy("item_id", "term").toArrow()  # a batch
        if len(mine):
            df = _frequencies(docs, np.unique(mine.column("term").to_numpy().view(np.uint64)))
            found.append(_searched(index.where("doc_id is not null"), docs, Batch(mine, df, n_docs, total, width), scratch, k, number))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _searched(index: DataFrame, docs: DataFrame, batch: Batch, scratch: C.Scratch, k: int, number: int) -> DataFrame:
    first = FIRST

    def highest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(len(batch.items), first, np.float64)
        for some in rows:
            for ids, n, sketches in _sketches(some):
                for a, bounds in batch.bounds(sketches, n):
                    for item, b in enumerate(bounds.astype(np.float64), a):
                        least = top.scores[item][-1] if len(top.scores[item]) == first else 0.0
                        good = np.flatnonzero((b >= least) & (b > 0))
                        if len(good):
                            top.add(item, b[good], ids[good])
        yield top.rows(batch.items)

    bounds = index.mapInArrow(highest, "item_id long, doc_id long, score double")
    seeds = _best(bounds, "score", first).select("doc_id", F.lit(float("inf")).alias("reach")).distinct()
    seeds = scratch.save(seeds, f"seeds-{number}")
    known = _rescored(docs, scratch.small(seeds, f"seeds-{number}"), batch, np.ones(len(batch.items), np.int64), k)
    known = {r.item_id: r.score for r in _best(known, "score", k).where(F.col("rank") == k).collect()}  # a row for each item of the batch
    limits = np.array([max(1, known.get(int(i), 1)) for i in batch.items], np.int64)

    def reaching(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for ids, n, sketches in _sketches(some):
                reach = np.max([(b / limits[a : a + len(b), None]).max(0) for a, b in batch.bounds(sketches, n)], axis=0)
                good = np.flatnonzero(reach >= 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(reach[good].astype(np.float64))], ["doc_id", "reach"])

    chosen = index.mapInArrow(reaching, "doc_id long, reach double").groupBy("doc_id").agg(F.max("reach").alias("reach"))
    chosen = scratch.save(chosen, f"chosen-{number}")
    rows = _rescored(docs, scratch.small(chosen, f"chosen-{number}"), batch, limits, k)
    return _best(scratch.save(rows, f"scores-{number}"), "score", k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = C.Scratch(spark, "lexical"), C.table(spark, sf_dir, "documents")
    return search(scratch.save(build(docs), "index"), docs, C.table(spark, sf_dir, "benchmark"), scratch)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM t WHERE len(ts) > 0),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(min(text), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
  GROUP BY item_id, term),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT row_number() OVER () AS r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w, n_docs, total FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))) AS part FROM tf JOIN w USING (term)),
s AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM q JOIN i USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
