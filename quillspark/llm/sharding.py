"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A document's key is its doc_id. The ring is cut into RING_CELLS equal cells; each virtual node of a shard sits at the
start of a cell, and a cell belongs to the next virtual node clockwise. Loads are bounded exactly: with n rows and k
shards, n mod k shards hold one row more than the others. A shard takes its own keys in ring order up to its bound;
keys beyond it go on clockwise to the next virtual node whose shard has room. The law kept is `rows`.

Only counts of cells (RING_CELLS rows) are looked at together. Rows get their numbers within cells from one sort of the
whole table by ranges, so that a cell with a third of all rows (one doc_id, or none) is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 8
VIRTUAL_NODES = 32
RING_CELLS = 1 << 14


def _place(key: str) -> str:
    """SQL for the key's cell: the top bits of an MD5."""
    return f"cast(conv(substr(md5({key}), 1, 4), 16, 10) as long) div {65536 // RING_CELLS}"


def ring(spark: SparkSession, shards: int, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """node (0.. clockwise), cell, shard: one row for each virtual node; of two in a cell the smaller shard stays."""
    every = spark.sql(
        f"select shard, explode(sequence(0, {nodes - 1})) as v from (select explode(sequence(0, {shards - 1})) as shard)"
    )
    at = every.select(F.expr(_place("concat('shard ', shard, ' node ', v)")).alias("cell"), "shard")
    at = at.groupBy("cell").agg(F.min("shard").alias("shard"))
    return at.select((F.row_number().over(Window.orderBy("cell")) - 1).alias("node"), "cell", "shard")


def _walk(node_rows: DataFrame, shards: int) -> DataFrame:
    """start, end, shard of runs of overflowing rows, numbered in ring order: they walk clockwise, twice around at most,
    and each virtual node takes of them what its shard has room for. node_rows: node, shard, over (rows that start their
    walk there), room (of the shard, the same for all its nodes)."""
    return node_rows.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("node", "shard", "over"))).alias("nodes"),  # one row a virtual node
        F.array_sort(F.collect_set(F.struct("shard", "room"))).alias("rooms"),
    ).select(F.expr(f"""
        aggregate(
          concat(nodes, transform(nodes, x -> named_struct('node', x.node, 'shard', x.shard, 'over', 0L))),
          named_struct('room', transform(sequence(0, {shards - 1}), s -> coalesce(element_at(filter(rooms, r -> r.shard = s), 1).room, 0L)),
                       'waiting', 0L, 'done', 0L, 'runs', cast(array() as array<struct<start: bigint, end: bigint, shard: int>>)),
          (acc, x) -> named_struct(
            'room', transform(acc.room, (r, s) -> if(s = x.shard, r - least(r, acc.waiting + x.over), r)),
            'waiting', acc.waiting + x.over - least(acc.room[x.shard], acc.waiting + x.over),
            'done', acc.done + least(acc.room[x.shard], acc.waiting + x.over),
            'runs', if(least(acc.room[x.shard], acc.waiting + x.over) = 0, acc.runs,
                       concat(acc.runs, array(named_struct('start', acc.done, 'end', acc.done + least(acc.room[x.shard], acc.waiting + x.over), 'shard', x.shard))))
          )).runs as runs""")).select(F.inline("runs"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, nodes: int = VIRTUAL_NODES, scratch: C.Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row; sizes of shards differ by one row at most.

    A null text has size 1 and the checksum of no bytes; a null doc_id has a place on the ring like any other. Rows that
    repeat a doc_id are told apart by checksum and size; equal rows are interchangeable. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or C.Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn("k", F.md5(key)).withColumn("cell", F.expr(_place("coalesce(cast(doc_id as string), '')")))
    rows = scratch.save(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    # equal rows are told apart by where they were read, so that ranges can part them too
    order = ("cell", "k", "doc_id", "text_crc32", "size", "tie")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "cell", F.monotonically_increasing_id().alias("at"))
    ordered = scratch.save(ordered, "ordered")  # at: the partition's number, then the row's place in it
    part = F.shiftright("at", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    ranked = ordered.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    firsts = ranked.groupBy("cell").agg(F.min("rank").alias("first"))  # RING_CELLS rows at most
    numbered = ranked.join(F.broadcast(firsts), "cell").select("doc_id", "size", "text_crc32", "cell", (F.col("rank") - F.col("first")).alias("rn"))

    # from here on a row is a cell: RING_CELLS at most
    counts = ordered.groupBy("cell").agg(F.count("*").alias("n"))
    points = ring(spark, shards, nodes).withColumn("half", F.lit(0))
    onward = Window.orderBy(F.desc("cell"), F.desc("half")).rowsBetween(Window.unboundedPreceding, 0)
    first = points.groupBy().agg(F.min_by(F.struct("node", "shard"), "node").alias("first"))
    marks = points.select("cell", F.lit(0).alias("half"), "node", "shard", F.lit(0).cast("long").alias("n"), F.lit(False).alias("real"))
    cells = counts.select("cell", F.lit(-1).alias("half"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("shard"), "n", F.lit(True).alias("real"))
    near = marks.unionByName(cells).withColumn("next", F.last(F.when(F.col("node").isNotNull(), F.struct("node", "shard")), ignorenulls=True).over(onward))
    own = near.where("real").join(F.broadcast(first)).select("cell", "n", F.coalesce("next", "first").alias("next")).select("cell", "n", "next.node", "next.shard")
    # keys past the last virtual node belong to the first, one turn on
    order = [F.when(F.col("cell") > F.col("top"), 0).otherwise(1), F.col("cell")]
    own = own.join(F.broadcast(points.groupBy().agg(F.max("cell").alias("top"))))
    total = counts.groupBy().agg(F.sum("n").alias("total"))
    own = own.join(F.broadcast(total)).withColumn("bound", (F.col("total") / shards).cast("long") + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0))
    own = own.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy(*order)) - F.col("n"))
    own = own.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.expr("bound - base")))).withColumn("over", F.expr("n - kept"))
    own = own.withColumn("over_from", F.sum("over").over(Window.orderBy(*order)) - F.col("over"))
    own = scratch.save(own.select("cell", "n", "node", "shard", "base", "kept", "over", "over_from"), "cells")

    taken = own.groupBy("shard").agg(F.sum("kept").alias("taken"))
    waiting = own.groupBy("node").agg(F.sum("over").alias("over"))
    bounds = points.select("node", "shard").join(F.broadcast(total)).join(taken, "shard", "left").join(waiting, "node", "left").select(
        "node", "shard", F.coalesce("over", F.lit(0)).alias("over"),
        ((F.col("total") / shards).cast("long") + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0) - F.coalesce("taken", F.lit(0))).alias("room"),
    )
    runs = _walk(bounds, shards)
    runs = runs.withColumn("before", F.sum(F.expr("end - start")).over(Window.partitionBy("shard").orderBy("start")) - F.expr("end - start"))
    runs = scratch.save(runs.join(taken, "shard", "left").select("start", "end", "shard", (F.col("before") + F.coalesce("taken", F.lit(0))).alias("slot")), "runs")
    moved = own.where("over > 0").alias("o").join(F.broadcast(runs.alias("r")), F.expr("o.over_from < r.end and o.over_from + o.over > r.start"))
    moved = moved.groupBy("o.cell").agg(F.collect_list(F.struct(  # runs that meet one cell: a virtual node gives one
        F.expr("greatest(r.start - o.over_from, 0) + o.kept").alias("from_rn"), F.expr("least(r.end - o.over_from, o.over) + o.kept").alias("to_rn"),
        F.col("r.shard").alias("shard"), F.expr("r.slot + greatest(o.over_from - r.start, 0)").alias("slot"))).alias("moves"))
    plan = scratch.save(own.select("cell", "shard", "base", "kept").join(moved, "cell", "left"), "plan")

    placed = numbered.join(F.broadcast(plan), "cell")  # at most RING_CELLS rows
    move = F.expr("element_at(filter(moves, m -> m.from_rn <= rn and rn < m.to_rn), 1)")
    placed = placed.withColumn("m", F.when(F.col("rn") >= F.col("kept"), move))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.coalesce("m.shard", "shard").cast("int").alias("shard"),
        F.when(F.col("m").isNotNull(), F.expr("m.slot + rn - m.from_rn")).otherwise(F.expr("base + rn")).alias("slot"),
    )


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(C.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same ring: CRC-32 by its table of bytes, and the walk of the overflowing rows step by step.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
b AS (SELECT doc_id, strlen(t) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
  CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295], list_transform(string_split(trim(regexp_replace(hex(encode(t)), '(..)', '\1 ', 'g')), ' '), lambda x: ('0x' || x)::BIGINT)),
    lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255)::INTEGER + 1])), 4294967295) END AS crc FROM d, c),
p AS (SELECT cell, min(shard) AS shard, row_number() OVER (ORDER BY cell) - 1 AS node FROM (SELECT s AS shard, ('0x' || substr(md5(concat('shard ', s, ' node ', v)), 1, 4))::INTEGER // 4 AS cell FROM range(8) x(s), range(32) y(v)) GROUP BY cell),
n AS (SELECT count(*) AS n FROM b),
r AS (SELECT b.*, ('0x' || substr(k, 1, 4))::INTEGER // 4 AS cell FROM b),
o AS (SELECT r.*, coalesce(q.shard, f.shard) AS own, coalesce(q.node, f.node) AS node, CASE WHEN q.node IS NULL THEN 0 ELSE 1 END AS lap FROM r ASOF LEFT JOIN p q ON r.cell <= q.cell, (SELECT * FROM p WHERE node = 0) f),
i AS (SELECT o.*, row_number() OVER (PARTITION BY own ORDER BY lap, cell, k, doc_id, crc, size) - 1 AS idx, n // 8 + CASE WHEN own < n % 8 THEN 1 ELSE 0 END AS bound FROM o, n),
v AS (SELECT *, row_number() OVER (ORDER BY lap, cell, k, doc_id, crc, size) - 1 AS waiting FROM i WHERE idx >= bound),
a AS (SELECT s AS shard, n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END - coalesce(taken, 0) AS room, coalesce(taken, 0) AS taken FROM range(8) x(s), n LEFT JOIN (SELECT own, count(*) AS taken FROM i WHERE idx < bound GROUP BY own) ON own = s),
w AS (SELECT p.node, p.shard, coalesce(x.n, 0) AS new FROM p LEFT JOIN (SELECT node, count(*) AS n FROM v GROUP BY node) x USING (node)),
m AS (SELECT max(node) + 1 AS nodes FROM p),
g AS (SELECT -1::BIGINT AS t, (SELECT list(room ORDER BY shard) FROM a)::BIGINT[] AS rooms, 0::BIGINT AS waiting, 0::BIGINT AS done, 0::BIGINT AS took, 0::BIGINT AS shard
  UNION ALL
  SELECT g.t + 1, list_transform(rooms, lambda x, j: CASE WHEN j = w.shard + 1 THEN x - least(x, g.waiting + z.new) ELSE x END), g.waiting + z.new - least(rooms[w.shard + 1], g.waiting + z.new), g.done + least(rooms[w.shard + 1], g.waiting + z.new), least(rooms[w.shard + 1], g.waiting + z.new), w.shard
  FROM g, m JOIN w ON w.node = (g.t + 1) % nodes, LATERAL (SELECT CASE WHEN g.t + 1 < nodes THEN w.new ELSE 0 END AS new) z WHERE g.t + 1 < 2 * nodes),
h AS (SELECT done - took AS lo, done AS hi, g.shard, a.taken + sum(took) OVER (PARTITION BY g.shard ORDER BY t) - took AS slot FROM g JOIN a USING (shard) WHERE took > 0)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, own::INTEGER AS shard, idx::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM i WHERE idx < bound
UNION ALL SELECT doc_id, size::BIGINT, crc::BIGINT, 'rows', h.shard::INTEGER, (h.slot + waiting - lo)::BIGINT, NULL FROM v JOIN h ON waiting >= lo AND waiting < hi
"""
