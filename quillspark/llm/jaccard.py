"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence is cut to what size bounds leave: two sets with Jaccard t or more share an n-gram among the first
size - ceil(t * size) + 1 of each, in any order that both follow. Documents with equal sets are one row of the
matrix. N-grams are dealt into blocks by hash; a block yields candidate pairs whose sizes allow a link, and the
product is accumulated exactly for those pairs only. Of an n-gram's group of SMALL documents or fewer all pairs are
counted where the group is read. Larger groups are first compared with a few of their members, a group of more than PART
documents in parts; all pairs of them are then taken only between components that a shared n-gram still leaves apart, so
that no link that could join two components is lost. All links are then found by exact products of all sets of a
component, as links never leave one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
#: Frequent n-grams come last in the common order. The list is bounded; it only steers speed, any list gives the same links.
FREQUENT = 100_000
#: An n-gram is counted as frequent where one stretch of work meets it in this many documents.
FREQUENT_IN_STRETCH = 2


#: Members of an n-gram's group of which all pairs are counted at once; text of few different words shares most of its
#: n-grams by chance, with few other documents each.
SMALL = 64
#: Members of a larger group, least by a hash of the id, that all of the group are first compared with.
PIVOTS = 5

#: Members of a component in a block of the product's columns; smaller components share blocks.
COLUMN_BLOCK = 256
#: Columns that one row of the product meets at once in blocks of small components, about.
POOL = 1 << 16
#: Entries of the product's rows that are counted together.
PRODUCT_ENTRIES = 400_000
#: Pairs of two components that are compared before all of them.
BEST_PAIRS = 6
#: Pairs that a row of the product gives for another component before all of them are asked for: the best ones, some of which
#: may have been compared with pivots.
ROW_PAIRS = BEST_PAIRS + PIVOTS
#: Sets in a block of the products within components.
SET_BLOCK = 256
#: N-grams whose products are added up at once.
NGRAM_SLICE = 8192
#: An n-gram of more documents is hot: two documents that both have it so late in their order that it can't be the first one
#: that they share, given equal sizes, aren't multiplied by it.
HOT = 1 << 16
#: Most documents, about, of an n-gram's group that are one part of it.
PART = 1 << 16

# An entry of the incidence carries in one number its set's size, how many hot late n-grams the set's prefix has, and
# whether the entry is one of those.
_SIZE, _LATE_ONES, _LATE = (1 << 30) - 1, 30, 60


def _least_overlap(n, percent: int):
    """ceil(percent / 100 * n) in integers."""
    return -(-percent * n // 100)


def frequent_ngrams(docs: DataFrame, k: int = SHINGLE_WORDS, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams in most documents and their counts, ascending; at most `most`. Counts come from all documents."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, sizes in C.hashed(batch.column(0), fold=True):
                sets = [C.sorted_set(x) for x in C.shingle_lists(h, sizes, k)]
                s = np.sort(np.concatenate(sets))
                if len(s):
                    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    n = np.diff(np.append(first, len(s)))
                    m = n >= FREQUENT_IN_STRETCH
                    yield pa.RecordBatch.from_arrays([pa.array(s[first[m]].view(np.int64)), pa.array(n[m])], ["g", "n"])

    counts = C.as_bytes(docs).mapInArrow(local, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "g").limit(most).collect()  # bounded by `most`
    return np.array([r.g for r in reversed(top)], np.int64).view(np.uint64), np.array([r.n for r in reversed(top)], np.int64)


def _prefixes(docs: DataFrame, frequent: np.ndarray, hot: int, k: int, percent: int) -> DataFrame:
    """doc_id, n, sig (of the set), prefix: the n-grams of which any linked document shares one, and entry: of each the
    number that it carries. Of the frequent n-grams those from place hot on are hot."""
    place = np.argsort(frequent)
    ordered = frequent[place]

    def cut(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(s)
        p = n - _least_overlap(n, percent) + 1
        if not len(ordered):
            return s[:p], np.full(p, n)
        often = ordered[np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)] == s
        prefix = s[~often][:p]
        late = np.zeros(p, np.int64)
        if len(prefix) < p:
            last = s[often]
            rank = place[np.searchsorted(ordered, last)]
            order = np.argsort(rank)[: p - len(prefix)]
            # of two sets of one size that share this n-gram and none before it, neither can have so many in common
            beyond = (100 + percent) * (n - np.arange(len(prefix), p)) < 2 * percent * n
            late[len(prefix) :] = (rank[order] >= hot) & beyond
            prefix = np.concatenate([prefix, last[order]])
        return prefix, n + (late.sum() << _LATE_ONES) + (late << _LATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, sizes in C.hashed(batch.column(1), fold=True):
                sets = [C.sorted_set(x) for x in C.shingle_lists(h, sizes, k)]
                sigs = [C.digest16(s.tobytes()) if len(s) else None for s in sets]
                cuts = [cut(s) if len(s) else (s, s.view(np.int64)) for s in sets]
                each = np.array([len(c) for c, _ in cuts])
                lists = [C.list_column(np.concatenate(x).view(np.int64), each, pa.int64()) for x in zip(*cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), *lists], ["doc_id", "n", "sig", "prefix", "entry"])

    return C.as_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, n int, sig binary, prefix array<long>, entry array<long>")


def _shared(batches: Iterator[pa.RecordBatch], percent: int, small: int = SMALL) -> Iterator[pa.RecordBatch]:
    """Of rows (g, part, n, id) sorted by g and part: those whose n-gram two ids or more have or may have, with partners
    of a size that allows a link: in a group of up to small ids all those before the row, in a larger one those of the
    first PIVOTS ids. part is 0 but for parts of a larger group. Holds small rows or PIVOTS between batches at most, however
    large a group is."""

    def given_out(cols: list[np.ndarray], begin: np.ndarray, large: np.ndarray, skip: int) -> pa.RecordBatch:
        """The groups that begin at begin, without the first skip rows, which were given out before."""
        g, _, n, i = cols
        n_rows, size = len(g), n & _SIZE
        count = np.diff(np.append(begin, n_rows))
        of = np.repeat(np.arange(len(begin)), count)
        rank = np.arange(n_rows) - begin[of]
        rows, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def fit(row: np.ndarray, other: np.ndarray) -> None:
            ok = 100 * np.minimum(size[row], size[other]) >= percent * np.maximum(size[row], size[other])
            rows.append(row[ok])
            others.append(other[ok])

        row = np.flatnonzero(~large[of] & (rank > 0))
        for d in range(1, small):
            row = row[rank[row] >= d]
            if not len(row):
                break
            fit(row, row - d)
        for p in range(PIVOTS):
            row = np.flatnonzero(large[of] & (rank > p))
            fit(row, begin[of[row]] + p)
        row, other = np.concatenate(rows), np.concatenate(others)
        order = np.lexsort((other, row))
        row, other = row[order], other[order]
        out = np.flatnonzero((large | (count > 1))[of] & (np.arange(n_rows) >= skip))
        new = row >= skip
        row, other = row[new], other[new]
        each = np.bincount(row, minlength=n_rows)[out]
        lists = [C.list_column(i[other], each, pa.int64()), C.list_column(size[other].astype(np.int32), each, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(g[out]), pa.array(n[out]), pa.array(i[out]), *lists, pa.array(large[of[out]])], ["g", "n", "id", "partners", "partner_ns", "large"])

    held = [np.empty(0, np.int64)] * 4  # of the last group: all rows while it may be small, else the pivots
    skip = 0  # those of them that were given out
    for batch in batches:
        if not len(batch):
            continue
        cols = [np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate(held)]
        g, part = cols[:2]
        begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
        large = (np.diff(np.append(begin, len(g))) > small) | (part[begin] > 0)
        large[0] |= skip > 0
        last = int(begin[-1])
        if large[-1]:
            yield given_out(cols, begin, large, skip)
            held = [x[last : last + PIVOTS] for x in cols]
            skip = len(held[0])
        else:
            if last:
                yield given_out([x[:last] for x in cols], begin[:-1], large[:-1], skip)
            held, skip = [x[last:] for x in cols], 0
    if len(held[0]) and not skip:
        yield given_out(held, np.zeros(1, np.int64), np.zeros(1, bool), 0)


def _product(batches: Iterator[pa.RecordBatch], percent: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of rows (x, nx, label, other, block, y, ny, ly) sorted by x, other and block, y, ny and ly being lists, nx and ny what
    their entries carry, ly the labels: how often each pair (x, y) whose sizes allow a link comes, if it is often enough. A
    pair in a block of small components (block under 0) counts in the row of the lesser label. Rows of about
    PRODUCT_ENTRIES entries are held, and those of one x and block: a list for each of its n-grams at most. most: of an x, a
    block and another component only so many pairs, those with most in common."""

    def counted(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
        each = t.column("y").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(t)), each)
        x, y, label, other = t.column("x").to_numpy()[row], flat("y"), t.column("label").to_numpy()[row], flat("ly")
        nx, ny = t.column("nx").to_numpy()[row], flat("ny")
        unmet = np.minimum(*(v >> _LATE_ONES & _SIZE for v in (nx, ny)))  # n-grams that may be common but weren't multiplied
        nx, ny = nx & _SIZE, ny & _SIZE
        mine = (t.column("block").to_numpy()[row] >= 0) | (label < other)
        fits = np.flatnonzero(mine & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)))
        order = fits[np.lexsort((y[fits], x[fits]))]
        xs, ys = x[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])])) if len(xs) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(xs))).astype(np.int32)
        at = order[first]
        rest = np.maximum(percent * nx[at].astype(np.int64) + 99, percent * ny[at].astype(np.int64) + 99) // 100 - 1
        some = (100 + percent) * (n + rest + unmet[at]) >= percent * (nx[at].astype(np.int64) + ny[at])  # as _enough()
        at, n = at[some], n[some]
        if most is not None and len(at):
            best = np.lexsort((y[at], -n, other[at], x[at]))
            xs, ls = x[at][best], other[at][best]
            first = np.flatnonzero(np.concatenate([[True], (xs[1:] != xs[:-1]) | (ls[1:] != ls[:-1])]))
            best = best[np.arange(len(best)) - np.repeat(first, np.diff(np.append(first, len(best)))) < most]
            at, n = at[best], n[best]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[at], y[at], label[at], other[at], n)], ["x", "y", "label", "other", "common"])

    held: list[pa.RecordBatch] = []  # whole rows of the keys not counted yet
    entries = 0
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("x", "other", "block")])
        begins = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]).tolist()
        size = np.concatenate([[0], np.cumsum(batch.column("y").value_lengths().to_numpy(zero_copy_only=False))])
        again = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("x", "other", "block"))
        at = 0
        for begin in begins:
            if entries + size[begin] - size[at] >= PRODUCT_ENTRIES and not (begin == 0 and again):
                yield counted(pa.Table.from_batches([*held, batch.slice(at, begin - at)]))
                held, entries, at = [], 0, begin
        held.append(batch.slice(at))
        entries += int(size[-1] - size[at])
    if held:
        yield counted(pa.Table.from_batches(held))


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Exact products of candidate rows (a, b, set_a, set_b): pairs that link, with their overlap."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep, both = [], []
        for j, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(j)
                both.append(common)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(both, pa.int32())], ["a", "b", "common"])


def _enough(common: str, n_a: str, n_b: str, percent: int) -> Column:
    """Whether a pair with so many n-grams common to both prefixes can still link. Of the n-grams that both have, those
    up to the earlier of the two prefixes' ends are in both prefixes; what is left of a set is ceil(t * n) - 1."""
    rest = lambda n: f"(({percent} * {n} + 99) div 100 - 1)"
    return F.expr(f"{100 + percent} * ({common} + greatest({rest(n_a)}, {rest(n_b)})) >= {percent} * ({n_a} + {n_b})")


def _link(docs: DataFrame, pairs: DataFrame, scratch: C.Scratch, name: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), which were saved, that link."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, h, sizes in C.hashed(batch.column(1), fold=True):
                sets = [C.sorted_set(s).tobytes() for s in C.shingle_lists(h, sizes, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(sets, pa.binary())], ["id", "s"])

    wanted = C.as_bytes(docs, "doc_id").join(scratch.small(ids, f"{name}-ids"), "doc_id", "left_semi")
    sets = scratch.save(wanted.mapInArrow(run, "id long, s binary"), f"{name}-sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("set_a")), "a")
    links = scratch.save(both.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _overlaps(it, percent), "a long, b long, common int").distinct(), f"{name}-links")
    scratch.drop(f"{name}-ids", f"{name}-sets")
    return scratch.few(links, f"{name}-links")


def _joined(labels: DataFrame, links: DataFrame, scratch: C.Scratch, name: str) -> DataFrame:
    """The labels (id, label) after the links (a, b), which were saved; an id without a label is its own."""
    across = scratch.save(_ends(links, labels).select("of_a", "of_b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), f"{name}-across")
    if not across.limit(1).count():
        return labels
    up = C.components(scratch.few(across, f"{name}-across"), scratch, name).withColumnRenamed("label", "least")
    both = labels.join(up.select(F.col("id").alias("label"), "least"), "label", "left").select("id", F.coalesce("least", "label").alias("label"))
    new = both.union(up.join(labels, "id", "left_anti").select("id", "least"))
    return scratch.few(scratch.save(new, f"{name}-labels"), f"{name}-labels")


def _ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) with the labels of both."""
    at = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({f"of_{c}": F.coalesce(f"of_{c}", c) for c in "ab"})


def _apart(shared: DataFrame, labels: DataFrame, scratch: C.Scratch, name: str) -> DataFrame:
    """(g, n, id, label) of the n-grams whose group has more than one label; an id without one is its own."""
    marked = shared.join(labels, "id", "left").select("g", "n", "id", F.coalesce("label", "id").alias("label"))
    marked = scratch.save(marked, f"labelled{name}")
    mixed = marked.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g")
    out = scratch.save(marked.join(mixed, "g"), f"marked{name}")
    scratch.drop(f"labelled{name}")
    return out


def _blocked_product(marked: DataFrame, sizes: DataFrame, one_block: bool, most: int | None, percent: int, hot: DataFrame | None, scratch: C.Scratch, name: str) -> DataFrame:
    """x, y, label, other, common of pairs with different labels that can link. Rows of the smaller component meet the
    members of the larger one in blocks of about COLUMN_BLOCK, so that a large component costs a row of the join for a
    block. Components of no more members share blocks, so that many small ones in one n-gram's group cost no more. Entries
    that are late for a hot n-gram (hot: these, if any) don't meet each other. one_block: of components larger than a block
    only their first one, and no others. most: as _product() has it."""
    rows = marked.select("g", "n", "id", "label").join(sizes, "label")
    # groups with more members of small components than a block holds
    crowded = rows.where(F.col("size") <= COLUMN_BLOCK).groupBy("g").agg(F.count("*").alias("members")).where(F.col("members") > COLUMN_BLOCK)
    crowded = scratch.save(crowded, f"crowded-{name}")
    pools = -(-(crowded.agg(F.max("members")).first()[0] or 1) // POOL)
    late = lambda n: F.shiftright(n, _LATE) == 1
    pooled = F.col("size") <= COLUMN_BLOCK
    block = F.when(pooled, -1 - F.pmod(F.xxhash64("id", F.lit(1)), F.lit(pools))).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / COLUMN_BLOCK)))
    columns = rows.join(scratch.small(crowded, f"crowded-{name}"), "g", "left")
    slice_ = F.when(pooled, F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("members", F.lit(1)) / COLUMN_BLOCK))).otherwise(0)
    columns = columns.select("g", F.when(pooled, 0).otherwise(F.col("label")).alias("other"), F.when(pooled, 0).otherwise(F.col("size")).alias("other_size"), block.cast("int").alias("block"), slice_.cast("int").alias("slice"), "id", "n", F.col("label").alias("l"), late("n").alias("late"))
    if one_block:
        columns = columns.where("block = 0")

    def meet(rows: DataFrame, columns: DataFrame) -> DataFrame:
        columns = columns.groupBy("g", "other", "other_size", "block", "slice").agg(F.collect_list(F.struct("id", "n", "l")).alias("y"))  # about COLUMN_BLOCK
        larger = F.expr("block >= 0 and (size < other_size or (size = other_size and label < other))")
        return rows.join(columns, "g").where(larger | ((F.col("block") < 0) & pooled))

    if hot is None:
        met = meet(rows, columns)
    else:
        met = meet(rows, columns.where(~F.col("late"))).unionByName(meet(rows.where(~late("n")).join(hot, "g", "left_semi"), columns.where("late")))
    met = met.select(F.col("id").alias("x"), F.col("n").alias("nx"), "label", "other", "block", F.col("y.id").alias("y"), F.col("y.n").alias("ny"), F.col("y.l").alias("ly"))
    met = met.repartition("x", "other", "block").sortWithinPartitions("x", "other", "block")
    return met.mapInArrow(lambda it: _product(it, percent, most), "x long, y long, label long, other long, common int")


def _degrees(t: pa.Table, percent: int) -> pa.Table:
    """Of sets (component, block, sig, copies, s) of one pair of blocks (i, j): sig and the copies of the sets that link
    with it, each pair of sets in one such table only."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    component, block, copies = (t.column(c).to_numpy() for c in ("component", "block", "copies"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s").combine_chunks()]
    n = np.array([len(x) for x in sets])
    grams, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = often[at] > 1  # by the others no two sets meet
    place = (np.cumsum(often > 1) - 1)[at[shared]]
    row = row[shared]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, NGRAM_SLICE):
        x, y = np.searchsorted(place, (begin, begin + NGRAM_SLICE))
        part = np.zeros((len(sets), NGRAM_SLICE), np.float32)
        part[row[x:y], place[x:y] - begin] = 1
        common += (part @ part.T).astype(np.int64)
    link = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (component[:, None] == component[None, :])
    if i != j:
        link &= block[:, None] != block[None, :]
    np.fill_diagonal(link, False)
    return pa.table({"sig": t.column("sig"), "n_links": pa.array(link @ copies)})


def jaccard_links(docs: DataFrame, scratch: C.Scratch, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: as jaccard_components(), with the exact number of other rows that each
    row is linked with. All sets of a component are compared, in pairs of blocks of about SET_BLOCK; small components
    share a block. Work and shuffled sets grow with the square of a component's number of different sets."""
    valid = docs.where(F.col("doc_id").isNotNull())
    rows = scratch.save(_with_components(docs, scratch, k, percent), "components")
    classes = rows.where("sig is not null and doc_id is not null").groupBy("component_id", "sig").agg(F.count("*").alias("copies"), F.min("doc_id").alias("id"))
    classes = scratch.save(classes, "classes")
    size = scratch.save(classes.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1"), "component-sizes")
    some = scratch.save(classes.join(scratch.small(size, "component-sizes"), "component_id"), "several")
    total = some.where(F.col("size") <= SET_BLOCK).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, sizes in C.hashed(batch.column(1), fold=True):
                sets = [C.sorted_set(x).tobytes() for x in C.shingle_lists(h, sizes, k)]
                yield pa.RecordBatch.from_arrays([pa.array([C.digest16(x) if x else None for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["sig", "s"])

    ids = scratch.save(some.select(F.col("id").alias("doc_id")).distinct(), "several-ids")
    sets = C.as_bytes(valid, "doc_id").join(scratch.small(ids, "several-ids"), "doc_id", "left_semi").mapInArrow(run, "sig binary, s binary")
    sets = scratch.save(sets.groupBy("sig").agg(F.first("s").alias("s")), "several-sets")
    blocks = F.ceil(F.col("size") / SET_BLOCK)
    # key: the component, or a number that small components share
    small = F.col("size") <= SET_BLOCK
    key = F.when(small, F.pmod(F.xxhash64("component_id"), F.lit(-(-total // SET_BLOCK) or 1))).otherwise(F.col("component_id"))
    dealt = some.select(F.col("component_id").alias("component"), "sig", "copies", small.alias("small"), key.alias("key"), blocks.alias("blocks"), F.pmod(F.xxhash64("sig"), blocks).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.join(sets, "sig").withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select("small", "key", "i", "j", "component", "block", "sig", "copies", "s")
    found = dealt.groupBy("small", "key", "i", "j").applyInArrow(lambda t: _degrees(t, percent), "sig binary, n_links long")
    degree = scratch.save(found.groupBy("sig").agg(F.sum("n_links").alias("n_links")), "degrees")
    counted = classes.join(degree, "sig", "left").select("sig", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    counted = scratch.save(counted, "counted")
    out = rows.join(counted, "sig", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def jaccard_components(docs: DataFrame, scratch: C.Scratch, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links); for the links' number see
    jaccard_links().

    Rows without words are linked with nothing. Documents of one to k-1 words have one shingle. doc_id is the key: rows
    that repeat a doc_id are given out again each, and should have equal texts. A null doc_id takes no part in links
    and has a null component. Extra columns are ignored.
    """
    return _with_components(docs, scratch, k, percent).drop("sig")


def _with_components(docs: DataFrame, scratch: C.Scratch, k: int, percent: int) -> DataFrame:
    """What jaccard_components() gives, and sig, a digest of the row's set (null without words)."""
    valid = docs.where(F.col("doc_id").isNotNull())
    frequent, counts = frequent_ngrams(valid, k)
    first_hot = int(np.searchsorted(counts, HOT, side="right"))
    rows = scratch.save(_prefixes(docs, frequent, first_hot, k, percent), "rows")
    classes = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("prefix", "entry"), "doc_id").alias("p"))
    incidence = classes.select(F.explode(F.arrays_zip("p.prefix", "p.entry")).alias("e"), "id").select(F.col("e.prefix").alias("g"), F.col("e.entry").alias("n"), "id")
    hot, part = None, F.lit(0)
    if first_hot < len(frequent):
        hot = F.broadcast(scratch.spark.createDataFrame([(g,) for g in frequent[first_hot:].view(np.int64).tolist()], "g long"))  # FREQUENT rows at most
    if counts.max(initial=0) > PART:
        large = counts > PART
        parts = scratch.spark.createDataFrame([(g, -(-n // PART)) for g, n in zip(frequent[large].view(np.int64).tolist(), counts[large].tolist())], "g long, parts long")
        incidence, part = incidence.join(F.broadcast(parts), "g", "left"), F.coalesce(F.pmod(F.xxhash64("id"), "parts") + 1, F.lit(0))  # FREQUENT rows at most
    blocks = incidence.select("g", part.cast("long").alias("part"), "n", "id").repartition("g", "part")
    ordered = blocks.sortWithinPartitions("g", "part", F.xxhash64("id"), "id")
    small = SMALL
    met = ordered.mapInArrow(lambda it: _shared(it, percent, small), "g long, n long, id long, partners array<long>, partner_ns array<int>, large boolean")
    met = scratch.save(met.where("large or size(partners) > 0"), "shared")
    shared = met.where("large").select("g", "n", "id")
    # a pair that meets in small groups has common what it has there, and no more than either has in large groups; other
    # pairs are found by the few that come first in every large group, or by the product
    over = scratch.save(shared.groupBy("id").agg(F.count("*").alias("over")), "over")
    over = scratch.small(over, "over")
    met = met.select("id", F.col("n").bitwiseAND(_SIZE).alias("n"), "large", F.explode(F.arrays_zip("partners", "partner_ns")).alias("p")).select("id", "n", F.col("p.partners").alias("other"), F.col("p.partner_ns").alias("other_n"), "large")
    met = met.groupBy("id", "n", "other", "other_n").agg(F.count("*").alias("all"), F.count_if(~F.col("large")).alias("small"))
    met = met.join(over, "id", "left").join(over.select(F.col("id").alias("other"), F.col("over").alias("other_over")), "other", "left")
    most = F.when(F.col("small") > 0, F.col("small") + F.least(F.coalesce("over", F.lit(0)), F.coalesce("other_over", F.lit(0)))).otherwise(F.col("all"))
    met = met.withColumn("common", most).where(_enough("common", "n", "other_n", percent))
    # likely links, each id's best ones; then those of the others that join components still apart
    done = scratch.save(met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "id", "common"), "pairs")
    done = scratch.few(done, "pairs")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("common"), "a", "b"))
    near = scratch.save(done.withColumn("place", place).where(F.col("place") <= BEST_PAIRS).select("a", "b"), "near")
    near, done = scratch.few(near, "near"), done.select("a", "b")
    labels = C.components(_link(valid, near, scratch, "near", k, percent), scratch, "near")
    rest = scratch.save(_ends(done, labels).where("of_a <> of_b").select("a", "b").join(near, ["a", "b"], "left_anti"), "others")
    rest = scratch.few(rest, "others")
    if rest.limit(1).count():
        labels = _joined(labels, _link(valid, rest, scratch, "others", k, percent), scratch, "with-others")
    marked = _apart(shared, labels, scratch, "")
    scratch.drop("shared", "over", "near", "others")

    # the product itself, for pairs in components still apart: first with one block of each large component, which
    # finds most of the links that join something to it, then with all, but only the best pairs of each row, which join most
    # of the rest; so all pairs are given only for what stays apart
    last_step = ""
    for step in ("one", "best", "all"):
        members = scratch.few(marked, f"marked{last_step}").select("id", "label").distinct()
        sizes = scratch.save(members.groupBy("label").agg(F.count("*").alias("size")), f"sizes-{step}")
        if step != "all" and not sizes.where(F.col("size") > COLUMN_BLOCK).limit(1).count():
            continue
        product = _blocked_product(marked, scratch.small(sizes, f"sizes-{step}"), step == "one", None if step == "all" else ROW_PAIRS, percent, hot, scratch, step)
        rest = product.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "label", "other", "common").join(done, ["a", "b"], "left_anti")
        rest = scratch.few(scratch.save(rest, f"rest-{step}"), f"rest-{step}")
        if not rest.limit(1).count():
            continue
        # the best pairs of every two components first
        place = F.row_number().over(Window.partitionBy("label", "other").orderBy(F.desc("common"), "a", "b"))
        best = scratch.save(rest.select("a", "b", place.alias("place")).where(F.col("place") <= BEST_PAIRS).select("a", "b"), f"best-{step}")
        best = scratch.few(best, f"best-{step}")
        done = done.union(best)
        closer = _joined(labels, _link(valid, best, scratch, f"best-{step}", k, percent), scratch, f"closer-{step}")
        if step != "all":
            if closer is not labels:
                marked, last_step = _apart(marked.select("g", "n", "id"), closer, scratch, step), step
            labels = closer
            continue
        # then all pairs in components still apart
        labels = closer
        apart = _ends(rest.select("a", "b"), labels).where("of_a <> of_b")
        last = scratch.few(scratch.save(apart.select("a", "b").join(best, ["a", "b"], "left_anti"), "last"), "last")
        if last.limit(1).count():
            labels = _joined(labels, _link(valid, last, scratch, "last", k, percent), scratch, "final")
    scratch.drop("pairs", "marked", "markedone", "markedbest", "rest-one", "rest-best", "rest-all", "last")

    names = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"))
    names = names.join(labels, "id", "left").select("sig", F.coalesce("label", "id").alias("component"))
    names = scratch.save(names, "names")
    out = rows.select("doc_id", "n", "sig").join(names, "sig", "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        "sig",
    )


def keep_one(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays. Rows with a null
    doc_id stay. Where rows repeat a doc_id with other texts, each text is a document of its own (the text of least hash
    goes by the doc_id, the others count as later than all doc_ids); of rows that repeat doc_id and text the least by
    all columns stays."""
    hashed = F.xxhash64(F.col("text"))
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(hashed).alias("first"))
    again = scratch.save(texts.where("n > 1").select(F.col("doc_id").alias("again"), "first"), "again")
    several = scratch.small(again, "again")
    single = docs.join(several, docs["doc_id"] == several["again"], "left_anti").where(docs["doc_id"].isNotNull())
    later = F.shiftrightunsigned(F.xxhash64(docs["doc_id"], docs["text"]), 2) + F.lit(1 << 62)
    node = F.when(F.xxhash64(docs["text"]) == several["first"], docs["doc_id"]).otherwise(later)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    repeated = docs.join(several, docs["doc_id"] == several["again"]).select(node.alias("node"), docs["text"].alias("text"), row.alias("row"))
    nodes = single.select(single["doc_id"], single["text"]).union(repeated.select("node", "text"))
    # what goes is the shorter list; while it can be broadcast, no text is shuffled
    kept = jaccard_components(nodes, scratch).groupBy(F.col("doc_id").alias("copy")).agg(F.bool_or(F.expr("doc_id = component_id")).alias("kept"))
    copies = scratch.small(scratch.save(kept.where("not kept").select("copy"), "copies"), "copies")
    one = single.join(copies, single["doc_id"] == copies["copy"], "left_anti")
    rest = repeated.join(copies, F.col("node") == F.col("copy"), "left_anti").groupBy("node").agg(F.min("row").alias("row"))
    return one.unionByName(rest.select("row.*")).unionByName(docs.where("doc_id is null"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"), C.Scratch(spark, "jaccard"))


def op9_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(C.table(spark, sf_dir, "documents"), C.Scratch(spark, "jaccard"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.* FROM s JOIN shared USING (g)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
