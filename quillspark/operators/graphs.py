"""Fixpoints over tables of references (node, input): levels in the order of inputs, cycles, and what a node takes over from
all that it leans on. Rounds are Spark jobs whose rows are written to the shared folder; only counts come to the driver: joins of
rounds are shuffles by hint, as a broadcast would go through the driver once a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.flows import saved
from .config import closure


#: The ladder of sources, from the weakest rung on.
RUNGS = ("third_party", "market_data", "constant", "derived", "disclosure", "pool_scan", "first_party_api", "log_scan", "contract_state")


def _edges(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return saved(edges.where("node is not null and input is not null").select("node", "input").distinct(), spark, "edges")


def levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, level of every node of edges (node, input; null input: none): 0 without inputs, else one more than the highest
    level of its inputs; null on a cycle and for what leans on one. Nodes all of whose inputs have levels are taken away
    again and again, so each reference is used up once, and there are as many rounds as levels."""
    every = saved(edges.select("node").union(edges.select("input")).where("node is not null").distinct(), spark, "nodes")
    rest = _edges(spark, edges)
    found = saved(every.join(rest.hint("merge"), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), spark, "level")
    done, level = [found], 0
    while rest.limit(1).count():
        used = rest.join(found.select(F.col("node").alias("input")).hint("merge"), "input", "left_anti")
        free = rest.select("node").distinct().join(used.hint("merge"), "node", "left_anti")
        level += 1
        found = saved(free.select("node", F.lit(level).cast("long").alias("level")), spark, "level")
        if not found.limit(1).count():
            done.append(rest.select("node", F.lit(None).cast("long").alias("level")).distinct())
            break
        rest = saved(used, spark, "edges")
        done.append(found)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _core(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The references that are left when nodes without inputs and nodes that nobody leans on are taken away again and again:
    those of cycles and of ways from one cycle to another."""
    rest, n = edges, edges.count()
    while n:
        inner = rest.join(rest.select(F.col("node").alias("input")).distinct().hint("merge"), "input", "left_semi").join(rest.select(F.col("input").alias("node")).distinct().hint("merge"), "node", "left_semi")
        inner = saved(inner.select("node", "input"), spark, "core")
        left = inner.count()
        if left == n:
            break
        rest, n = inner, left
    return rest


def circular(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node: the nodes that are computed from themselves, over any number of inputs. Only what trimming leaves (_core) is
    followed from node to node."""
    core = _core(spark, _edges(spark, edges))
    start = core.select(F.col("node").alias("origin"), F.col("input").alias("node"))
    return closure(spark, start, core).where("origin = node").select("node")


def least_reached(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, least: of nodes (node, rank) the least rank among a node's own and all that it reaches by edges; null ranks
    count as none. Inputs that are no nodes don't count. Cycles of any kind and chains of any length are allowed.

    Chains (nodes with one input) are followed by doubling: after k rounds a node knows the least rank of its next 2^k
    nodes and what stands behind them, so a chain or cycle of n nodes takes log2(n) rounds. Between the nodes with several
    inputs, ranks that fell are handed on until none falls: as many rounds as such nodes stand behind each other at most.
    """
    ranks = saved(nodes.where("node is not null").groupBy("node").agg(F.min("rank").alias("rank")), spark, "ranks")
    edges = saved(_edges(spark, edges).join(ranks.select("node").hint("merge"), "node", "left_semi").join(ranks.select(F.col("node").alias("input")).hint("merge"), "input", "left_semi").select("node", "input"), spark, "edges")
    single = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("input").alias("next"))
    # of a chain's node: the least rank of the nodes from it up to, not including, next
    chain = saved(single.where("n = 1").join(ranks.hint("merge"), "node").select("node", "next", F.col("rank").alias("least")), spark, "chain")
    reach, most = 1, chain.count()
    while reach < most:
        ahead = chain.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("least").alias("more"))
        joined = chain.join(ahead.hint("merge"), "next", "left")
        chain = saved(joined.select("node", F.coalesce("then", "next").alias("next"), F.least("least", "more").alias("least"), F.col("then").isNotNull().alias("moved")), spark, "chain")
        moved = chain.where("moved").limit(1).count()
        chain = chain.drop("moved")
        reach *= 2
        if not moved:
            break
    # nodes with several inputs, or none: their references, over chains
    ends = ranks.join(chain.select("node").hint("merge"), "node", "left_anti")
    hops = edges.join(single.where("n > 1").select("node").hint("merge"), "node", "left_semi").join(chain.withColumnsRenamed({"node": "input", "next": "end", "least": "on_way"}).hint("merge"), "input", "left")
    hops = saved(hops.select("node", F.coalesce("end", "input").alias("end"), "on_way"), spark, "hops")
    least = ends.join(hops.groupBy("node").agg(F.min("on_way").alias("on_way")).hint("merge"), "node", "left").select("node", F.least("rank", "on_way").alias("least"))
    least = saved(least, spark, "least")
    fell = least.where("least is not null")
    while fell.limit(1).count():
        handed = fell.select(F.col("node").alias("end"), F.col("least").alias("new")).join(hops.hint("merge"), "end").groupBy("node").agg(F.min("new").alias("new"))
        now = least.join(handed.hint("merge"), "node", "left").select("node", F.least("least", "new").alias("least"), (F.col("new") < F.coalesce("least", F.col("new") + 1)).alias("fell"))
        now = saved(now, spark, "least")
        fell, least = now.where("fell").select("node", "least"), now.select("node", "least")
    behind = least.select(F.col("node").alias("next"), F.col("least").alias("behind"))
    through = chain.join(behind.hint("merge"), "next", "left").select("node", F.least("least", "behind").alias("least"))
    return least.unionByName(through)


def source_rungs(spark: SparkSession, metrics: DataFrame, inputs: DataFrame) -> DataFrame:
    """metric, rung, weakest of metrics (metric, source_type) that read others (metric, input): a derived metric is third-party
    if anything it reads is, through any number of derived ones; weakest is the lowest rung of all it leans on, its own
    included. A metric without a known source has no rung; what isn't declared isn't read."""
    place = F.when(F.col("source_type").isNotNull(), F.array_position(F.array(*map(F.lit, RUNGS)), F.col("source_type")))
    rank = F.when(place > 0, place - 1)
    nodes = metrics.select(F.col("metric").alias("node"), rank.alias("rank"))
    derived = metrics.where("source_type = 'derived'").select("metric")
    found = least_reached(spark, nodes, inputs.join(derived.hint("merge"), "metric", "left_semi").select(F.col("metric").alias("node"), "input"))
    rows = metrics.join(found.withColumnRenamed("node", "metric").hint("merge"), "metric", "left")
    name = F.get(F.array(*map(F.lit, RUNGS)), F.col("least").cast("int"))
    return rows.select("metric", F.when((F.col("source_type") == "derived") & (F.col("least") == 0), RUNGS[0]).otherwise(F.col("source_type")).alias("rung"), name.alias("weakest"))
