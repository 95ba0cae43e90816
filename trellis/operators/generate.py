"""Random graph generators and stage splitters; every draw is a hash of its keys, so reruns agree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.scalars import uniform
from trellis.operators import canon
from trellis.session import materialize, release

# Quadrant chances of the recursive generator.
RMAT = (0.57, 0.19, 0.19)


def rmat(spark: SparkSession, scale: int, edge_factor: int, seed: int = 1, quadrants: tuple[float, float, float] = RMAT, shuffle: bool = True) -> DataFrame:
    """edge_factor * 2**scale directed edges (src, dst) over 2**scale vertices from 0."""
    a, b, c = quadrants
    rows_low = a + b  # chance of the upper half
    e = spark.range(edge_factor << scale)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        down = uniform(seed + 2 * bit, F.col("id")) > rows_low
        chance = F.when(down, c / (1 - rows_low)).otherwise(a / rows_low)
        right = uniform(seed + 2 * bit + 1, F.col("id")) > chance
        src = src + down.cast("long") * (1 << bit)
        dst = dst + right.cast("long") * (1 << bit)
    g = e.select("id", src.alias("src"), dst.alias("dst"))
    if not shuffle:
        return g.select("src", "dst")
    names = canon.dense_index(spark.range(1 << scale).select("id", F.xxhash64(F.lit(seed + 977), "id").alias("h")), ["h", "id"], "at")
    s, d = names.select(F.col("id").alias("src"), F.col("at").alias("s")), names.select(F.col("id").alias("dst"), F.col("at").alias("d"))
    return g.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def sbm(spark: SparkSession, n: int, seed: int = 1, overlap: float = 5.0, heterogeneity: float = 3.0, exponent: float = -2.5, lowest: int = 10, highest: int | None = None, n_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A degree-corrected block graph: (edges (src, dst, weight), truth (node, block)).

    floor(n**0.35) blocks with Dirichlet sizes; degrees follow a clipped power law; a stub meets its own
    block ``overlap`` times as often as another.  Only per-block numbers are drawn on the driver.
    """
    blocks = n_blocks or max(1, int(n**0.35))
    rng = np.random.default_rng(seed)
    share = np.cumsum(rng.dirichlet(np.full(blocks, 10.0 / heterogeneity)))
    steps = F.array(*[F.lit(float(x)) for x in share])
    top = highest or max(lowest + 1, int(n**0.5) * 2)
    node = spark.range(1, n + 1).withColumnRenamed("id", "node")
    u = uniform(seed + 11, F.col("node"))
    at = F.least(F.size(F.filter(steps, lambda x: x <= u)), F.lit(blocks - 1)).cast("long")
    node = node.select("node", at.alias("block"))
    # the power law's inverse distribution function
    p = exponent + 1
    d = F.pow(uniform(seed + 12, F.col("node")) * (top**p - lowest**p) + lowest**p, 1 / p)
    node = node.withColumn("degree", F.floor(d).cast("long"))
    node = materialize(node, "sbm-nodes")
    stubs = node.select("node", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree"))).alias("k"))
    own = overlap / (overlap + blocks - 1)
    other = F.floor(uniform(seed + 14, F.col("node"), F.col("k")) * max(blocks - 1, 1)).cast("long")
    other = F.when(other >= F.col("block"), other + 1).otherwise(other)
    to = F.when((uniform(seed + 13, F.col("node"), F.col("k")) < own) | F.lit(blocks == 1), F.col("block")).otherwise(other)
    # a partner within the target block, in proportion to its degree: the stub's place among the block's stubs
    places = stubs.select(F.col("block").alias("to"), F.col("node").alias("dst"), F.col("k").alias("k2"))
    ranked = canon.dense_index(places, ["to", "dst", "k2"], "at")
    spans = ranked.groupBy("to").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    wanted = stubs.select(F.col("node").alias("src"), "k", to.alias("to")).join(F.broadcast(spans), "to")
    wanted = wanted.withColumn("at", F.col("first") + F.floor(uniform(seed + 15, F.col("src"), F.col("k")) * F.col("size")).cast("long"))
    e = wanted.join(ranked.select("at", "dst"), "at").where("src <> dst").select("src", "dst").distinct()
    return e.withColumn("weight", F.lit(1.0)), node.select("node", "block")


def emerging_stages(edges: DataFrame, stages: int = 10, seed: int = 1) -> DataFrame:
    """Each edge goes to one of the stages 1 .. n, uniformly and repeatably."""
    return edges.withColumn("stage", F.floor(uniform(seed, F.col("src"), F.col("dst")) * stages).cast("int") + 1)


def snowball_stages(edges: DataFrame, stages: int = 10, seed: int = 1) -> DataFrame:
    """(src, dst, .., stage): nodes are met by breadth-first growth from the node of highest degree.

    Each stage meets an equal share of the nodes; an edge arrives with the later of its ends.  Where the
    frontier runs dry, growth starts again at the unmet node of highest degree.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("x", "y").where("x <> y").distinct(), "snowball")
    every = materialize(edges.select(F.explode(F.array("src", "dst")).alias("x")).groupBy("x").agg(F.count("*").alias("d")), "snowball")
    n = every.count()
    met = None
    for stage in range(1, stages + 1):
        goal = n * stage // stages
        while (have := 0 if met is None else met.count()) < goal:
            if met is None:
                fresh = every.orderBy(F.col("d").desc(), "x").limit(1).select("x")
            else:
                near = both.join(met.select("x"), "x", "left_semi").select(F.col("y").alias("x")).distinct().join(met.select("x"), "x", "left_anti")
                fresh = near.orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(goal - have)
                if fresh.isEmpty():
                    fresh = every.join(met.select("x"), "x", "left_anti").orderBy(F.col("d").desc(), "x").limit(1).select("x")
            fresh = fresh.select("x", F.lit(stage).alias("stage"))
            before, met = met, materialize(fresh if met is None else met.unionByName(fresh), "snowball")
            if before is not None:
                release(before)
    release(both, every)
    if met is None:
        return edges.withColumn("stage", F.lit(1))
    s, d = met.toDF("src", "_s"), met.toDF("dst", "_d")
    return edges.join(s, "src").join(d, "dst").withColumn("stage", F.greatest("_s", "_d")).drop("_s", "_d").select(*edges.columns, "stage")


def arrival_index(staged: DataFrame) -> DataFrame:
    """(node, first_stage, at): nodes numbered from 1 by first arrival, then id."""
    first = staged.select(F.explode(F.array("src", "dst")).alias("node"), "stage").groupBy("node").agg(F.min("stage").alias("first_stage"))
    return canon.dense_index(first, ["first_stage", "node"], "at", start=1)


def reindexed(staged: DataFrame) -> DataFrame:
    """Edges with nodes renamed in order of arrival, so the nodes of any prefix are consecutive."""
    names = arrival_index(staged)
    s, d = names.select(F.col("node").alias("src"), F.col("at").alias("s")), names.select(F.col("node").alias("dst"), F.col("at").alias("d"))
    return staged.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *[c for c in staged.columns if c not in ("src", "dst")])
