"""Substring dedup by recompression.

Each document is a string of words. Rounds replace each maximal run of one symbol, or each pair of a left and a right
symbol, by a new symbol; neither has a bound on words. A symbol's name is a hash of what it replaces
and its side in a round is a bit of its name, so both hold for the whole corpus: every task gives equal strings equal
names, and no dictionary has to be shuffled. Whether two neighbours merge depends on these two alone.

So the symbols inside a window are the same wherever it lies, but for those at its ends, which what is beside the window
may change. Rounds go on until no window has an inner symbol left, WINDOW_WORDS / 2 rounds at most. After REVEALING
rounds the inner symbol of highest rank reveals a window, together with BESIDE symbols to both sides; of a window with too
few symbols by then (long runs) its longest symbol in the last round does. Spark groups these by name, and windows go on
whose symbols two documents have. What each round leaves at a window's ends, with what is left in the last round, spells
the window in a few symbols (a run counts as one with its length); Spark groups windows by that spelling, which verifies
the repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW_WORDS = 50
#: Every so many rounds one is of runs, beginning with the first; the others are of pairs.
RUN_ROUNDS = 4
#: Rounds before a symbol reveals its window, and the symbols to each side of it that must agree as well.
REVEALING, BESIDE = 4, 4
#: Windows that are parsed at once, so that a round's arrays stay in the cache, and a long document takes no more memory.
PIECE_WINDOWS = 1 << 14

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def rounds(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Over word hashes h, where first tells the first word of each document: before each round the symbols' names, their
    lengths in words, and whether the round begins a symbol with each."""
    sym, length, number = h, np.ones(len(h), np.int64), 0
    while True:
        number += 1
        if number % RUN_ROUNDS == 1:
            merge = sym[1:] == sym[:-1]
        else:
            left = (C.mix(sym + np.uint64(number * int(_C) % (1 << 64))) & np.uint64(1)).astype(bool)
            merge = ~left[:-1] & left[1:]
        keep = np.concatenate([[True], ~merge | first[1:]])
        yield sym, length, keep
        begin = np.flatnonzero(keep)
        last = np.append(begin[1:], len(sym)) - 1
        several = last > begin
        name = sym[begin]
        name[several] = C.mix(name[several] * _A + sym[last[several]] * _B + (last - begin)[several].astype(np.uint64) * _C + np.uint64(number))
        sym, length, first = name, np.add.reduceat(length, begin), first[begin]


def _highest(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest of rank[lo] to rank[hi - 1]."""
    out, size, block = np.empty(len(lo), np.uint64), 1, rank
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=-1)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.maximum(block[lo[own]], block[hi[own] - size])
        block = np.maximum(block[:-size], block[size:])
        size *= 2
    return out


def _revealed(sym: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of windows with inner symbols a to b - 1, more than 2 * BESIDE: the name of the revealing symbols."""
    place = np.arange(len(sym), dtype=np.uint64)
    rank = (C.mix(sym ^ _B) & ~_LOW) | (_LOW - place)  # of equal symbols the first
    at = (_LOW - (_highest(rank, a + BESIDE, b - BESIDE) & _LOW)).astype(np.int64)
    name = np.zeros(len(sym), np.uint64)
    inside = slice(BESIDE, len(sym) - BESIDE)
    for j in range(2 * BESIDE + 1):
        name[inside] = name[inside] * _A + sym[j : len(sym) - 2 * BESIDE + j]
    return C.mix(name[at])


def spell(h: np.ndarray, first: np.ndarray, begin: np.ndarray, window: int, spelling: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of h that start at begin, each within one document: the name of the symbols that reveal the window,
    and two independent hashes of its spelling, unless that is not wanted."""
    a, b, live = begin, begin + window, np.arange(len(begin))  # the window's inner symbols are a to b - 1
    top, one, two = (np.zeros(len(begin), np.uint64) for _ in range(3))
    late = np.ones(len(begin), bool)  # not revealed by the symbols after REVEALING rounds
    for number, (sym, length, keep) in enumerate(rounds(h, first)):
        if number == REVEALING:
            many = b - a > 2 * BESIDE
            if many.any():
                top[live[many]] = _revealed(sym, a[many], b[many])
                late[live[many]] = False
            if not spelling:
                a, b, live = a[~many], b[~many], live[~many]
        if not len(live):
            break
        n, i = len(sym), np.arange(len(sym))
        later = np.append(np.minimum.accumulate(np.where(keep, i, n)[::-1])[::-1], n)
        x, y = later[a + 1], np.maximum.accumulate(np.where(keep, i, 0))[b - 1]
        whole = x >= b  # the round makes one symbol of all
        x, y = np.where(whole, b, x), np.where(whole, a, y)
        if spelling:
            # a to x - 1 and y to b - 1 are parts of symbols that reach to the window's ends or beyond: one, a pair or a run
            left = C.mix(sym[a] * _A + sym[x - 1] * _B + (x - a).astype(np.uint64) * _C)
            right = C.mix(sym[y] * _B + sym[b - 1] * _A + (b - y).astype(np.uint64) * _C)
            one[live] = C.mix(one[live] * _A + left + right * _C)
            two[live] = (two[live] ^ (left * _B + right)) * _C
        place = np.cumsum(keep) - 1
        next_a, next_b = place[np.minimum(x, n - 1)], place[y]
        on = ~whole & (next_a < next_b)
        end = ~on & late[live]
        if end.any():
            ends = np.stack([a[end], x[end] - 1, y[end], b[end] - 1])
            rank = (length[ends] << 40) | (C.mix(sym[ends]) >> np.uint64(24)).astype(np.int64)
            longest = ends[rank.argmax(0), np.arange(ends.shape[1])]
            run = np.where(whole[end], (b - a)[end], 0)  # the window may be one run
            top[live[end]] = C.mix(sym[longest] * _A + length[longest].astype(np.uint64) * _B + run.astype(np.uint64))
        a, b, live = next_a[on], next_b[on], live[on]
    return top, one, two


def windows(h: np.ndarray, sizes: np.ndarray, window: int, spelling: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Of documents laid end to end in h, piece by piece: document and first word of each window, and what spell() gives."""
    if len(h) < window:
        return
    ends = np.cumsum(sizes)
    first = np.zeros(len(h), bool)
    first[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(ends, sizes))
    for k in range(0, len(starts), PIECE_WINDOWS):
        some = starts[k : k + PIECE_WINDOWS]
        lo, hi = some[0], some[-1] + window
        of = np.searchsorted(ends, some, side="right")
        yield of, some - (ends - sizes)[of], *spell(h[lo:hi], first[lo:hi], some - lo, window, spelling)


def _symbol_rows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, part, a digest of all words, and the distinct symbols that reveal windows, of each row with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, sizes in C.hashed(batch.column(2)):
                ends = np.cumsum(sizes)
                sig = [C.digest16(h[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for of, _, top, _, _ in windows(h, sizes, window, False):
                    change = np.concatenate([[True], (top[1:] != top[:-1]) | (of[1:] != of[:-1])])
                    rows.append(of[change])
                    keys.append(top[change])
                row, key = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else row.astype(bool)
                lists = C.list_column(key[new].view(np.int64), np.bincount(row[new], minlength=len(sizes)), pa.int64())
                out = pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(sig, pa.binary()), lists], ["doc_id", "part", "sig", "key"])
                yield out.filter(pa.array(sizes >= window))

    return docs.mapInArrow(run, "doc_id long, part long, sig binary, key array<long>")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, part, pos, h1, h2 of each window that one of the row's shared symbols (column keys) reveals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b, h, sizes in C.hashed(batch.column(2)):
                some = shared.slice(a, b - a)
                row = np.repeat(np.arange(b - a), some.value_lengths().to_numpy(zero_copy_only=False))
                wanted = np.unique(C.mix(some.flatten().to_numpy().view(np.uint64) + row.astype(np.uint64) * _A))
                for of, pos, top, one, two in windows(h, sizes, window):
                    pair = C.mix(top + of.astype(np.uint64) * _A)  # by chance a window more may go on
                    i = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair)
                    columns = (ids[a:b][of[i]], parts[a:b][of[i]], pos[i].astype(np.int32), one[i].view(np.int64), two[i].astype(np.uint32).view(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "part", "pos", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, part long, pos int, h1 long, h2 int")


def _cut(docs: DataFrame, window: int, rest: str = "") -> DataFrame:
    """Of (doc_id, text, whole, starts) and a column rest of any type: removes the words that windows at `starts` cover,
    or all words if `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, whole, starts in zip(C.texts(batch), batch.column(2).to_pylist(), batch.column(3)):
                words = text.split()
                n.append(len(words))
                if whole:
                    words = []
                elif starts.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    s = starts.values.to_numpy()
                    s = np.unique(s[s + window <= len(words)])
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                    out = np.cumsum(cover[:-1]) > 0
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out + batch.columns[4:], ["doc_id", "n_words", "n_removed", "kept", "rest"][: len(out) + bool(rest)])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary" + f", rest {rest}" * bool(rest))


def _part(text: Column) -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(text.cast("binary"))


def repeated_windows(docs: DataFrame, scratch: C.Scratch, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, part, whole, starts: texts of which words go (part: _part() of the text). whole: a smaller doc_id has the
    same words (at least a window of them), so all go; else starts has the windows that also start in a document of
    smaller doc_id."""
    valid = docs.where("doc_id is not null and text is not null").select("doc_id", _part(F.col("text")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = scratch.save(_symbol_rows(valid, window), "symbols")
    first = scratch.save(rows.groupBy("sig").agg(F.min("doc_id").alias("first")), "first")
    # one document of each class of equal word sequences stays; the others lose all words and add no window of their own
    marked = rows.select("doc_id", "part", "sig").join(first, "sig")
    copies = marked.where("doc_id <> first").select("doc_id", "part").distinct()
    own = rows.join(first.select(F.col("first").alias("doc_id"), F.col("sig").alias("own")), "doc_id").where("sig = own")
    flat = own.select("doc_id", "part", F.explode("key").alias("key"))
    keys = flat.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    keys = scratch.save(keys, "keys")
    shared = scratch.save(flat.join(keys, "key").groupBy("doc_id", "part").agg(F.collect_set("key").alias("keys")), "shared")
    wanted = valid.join(scratch.small(shared, "shared"), ["doc_id", "part"]).select("doc_id", "part", "text", "keys")
    found = scratch.save(_window_rows(wanted, window), "windows")
    scratch.drop("keys", "shared")
    firsts = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    firsts = scratch.save(firsts, "firsts")
    gone = found.join(firsts, ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id", "part").agg(F.collect_set("pos").alias("starts"))
    out = copies.select("doc_id", "part", F.lit(True).alias("whole")).join(gone, ["doc_id", "part"], "full").select("doc_id", "part", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")
    out = scratch.save(out, "gone")
    scratch.drop("symbols", "first", "windows", "firsts")
    return out


def remove_repeats(docs: DataFrame, scratch: C.Scratch, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row.

    Words are what ASCII white space separates. Null texts have none; texts shorter than a window lose nothing. Rows
    with a null doc_id neither lose words nor make others lose any. Rows that repeat a doc_id are parts of one document:
    each makes documents of larger doc_ids lose words, none another row of its own doc_id, and each loses words by its
    own windows only. Extra columns are ignored.
    """
    gone = repeated_windows(docs, scratch, window)
    rows = C.as_bytes(docs, "doc_id").withColumn("part", _part(F.col("text")))
    both = rows.join(scratch.small(gone, "gone"), ["doc_id", "part"], "left").select("doc_id", "text", "whole", "starts")
    return _cut(both, window).select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def without_repeats(docs: DataFrame, scratch: C.Scratch, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows with their own columns: text is what remove_repeats() keeps where it removes words, else unchanged;
    n_chars, if there is one, follows a changed text."""
    gone = repeated_windows(docs, scratch, window)
    gone = scratch.small(gone, "gone")
    mine = (docs["doc_id"] == gone["doc_id"]) & (_part(docs["text"]) == gone["part"])
    same = docs.join(gone, mine, "left_anti")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"c{i}" for i in range(len(rest))]  # columns of the table may have the names of ours
    packed = F.struct(*(docs[f"`{c}`"].alias(n) for c, n in zip(rest, names))) if rest else F.lit(None).cast("int")
    hit = docs.join(gone, mine).select(docs["doc_id"], docs["text"].cast("binary").alias("text"), gone["whole"], gone["starts"], packed.alias("rest"))
    cut = _cut(hit, window, hit.schema["rest"].dataType.simpleString()).withColumn("text", F.col("kept").cast("string"))
    length = F.char_length("text").cast("long")
    columns = [F.col(c) if c in ("doc_id", "text") else (length if c == "n_chars" else F.col(f"rest.{names[rest.index(c)]}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return same.unionByName(cut.select(columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(C.table(spark, sf_dir, "documents"), C.Scratch(spark, "substrings"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM p GROUP BY h),
g AS (SELECT p.doc_id, list(p.i ORDER BY p.i) AS st FROM p JOIN f USING (h) WHERE p.doc_id > f.lo GROUP BY p.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(st, lambda s: range(s, s + 50)))) AS gone FROM g),
r AS (SELECT doc_id, map_from_entries(list_transform(gone, lambda x: struct_pack(k := x, v := true))) AS m, len(gone) AS n FROM c)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN r.n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT coalesce(m[i], false)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
