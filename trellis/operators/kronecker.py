"""Exact Kronecker graph design: properties of a product graph from its star factors, without building it.

A design is a list of leaf counts m.  Its factors are stars with m+1 vertices; type 1 gives every hub a
loop, type 2 every last leaf, and the product's one loop is removed again.  Every property of the
product is the product of the factors' properties, so designs of 1e30 edges cost nothing.  Counts are
exact integers on the driver (a design has a handful of factors) and DECIMAL(38, 0) in tables.
"""

from __future__ import annotations

from collections import Counter
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import canon, linalg, triangles, truss

SAVE_BELOW = 100_000_000


def bipartite(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Adjacency (i, j, v) of the complete bipartite graph; parts 1..n and n+1..n+m."""
    one = spark.range(1, n + 1).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(n + 1).cast("long"), F.lit(n + m).cast("long"))).alias("y"))
    return one.select("x", "y").union(one.select("y", "x")).toDF("i", "j").withColumn("v", F.lit(1.0))


def star(spark: SparkSession, m: int, kind: int = 0) -> DataFrame:
    """The factor of m leaves; kind 1 has a loop at the hub, kind 2 at the last leaf."""
    a = bipartite(spark, 1, m)
    return a if kind == 0 else linalg.assign(a, *((1, 1) if kind == 1 else (m + 1, m + 1)), 1.0)


def factor_properties(m: int, kind: int) -> dict[str, int]:
    """vertices, nonzeros, sum(B^2 .* B), rows of the 3-truss, of one factor."""
    return {"vertices": m + 1, "nonzeros": 2 * m + (kind > 0), "closed": (0, 3 * m + 1, 4)[kind], "truss_rows": (0, 2 * m + 1, 3)[kind]}


def theory(leaves: list[int], kind: int) -> dict[str, int | None]:
    """vertices, edges (directed nonzeros), triangles and 3-truss edges of the design.

    Removing the product's loop takes away the wrong closed walks through it: the loop itself, and two
    per nonzero of its vertex.  Type 1 has no valid formula for the truss: None; build and peel it.
    """
    p = [factor_properties(m, kind) for m in leaves]
    v, e, c, t = (prod(x[k] for x in p) for k in ("vertices", "nonzeros", "closed", "truss_rows"))
    if kind == 0:
        return {"vertices": v, "edges": e, "triangles": 0, "truss_edges": 0}
    hub = v if kind == 1 else 2 ** len(leaves)  # nonzeros in the loop's row
    triangles_ = (c - 3 * hub + 2) // 6
    return {"vertices": v, "edges": e - 1, "triangles": triangles_, "truss_edges": None if kind == 1 else (t - 3) // 2}


def degree_counts(leaves: list[int], kind: int) -> dict[int, int]:
    """degree -> number of vertices: the factors' distributions multiplied, then corrected for the loop."""
    out = Counter({1: 1})
    for m in leaves:
        own = Counter({1: m, m: 1}) if m > 1 else Counter({1: 2})
        if kind == 1:
            own = Counter({1: m}) + Counter({m + 1: 1})
        elif kind == 2:
            own = Counter({1: m - 1, 2: 1}) + Counter({m: 1})
        nxt: Counter[int] = Counter()
        for d, n in out.items():
            for e, k in own.items():
                if k:
                    nxt[d * e] += n * k
        out = nxt
    if kind:
        loop = prod(m + 1 for m in leaves) if kind == 1 else 2 ** len(leaves)
        out[loop] -= 1
        out[loop - 1] += 1
    return {d: n for d, n in sorted(out.items()) if n}


def theory_table(spark: SparkSession, designs: list[list[int]], kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One row per design and kind, counts as decimals."""
    rows = []
    for d in designs:
        for k in kinds:
            t = theory(d, k)
            rows.append(("-".join(map(str, d)), k, *(None if t[c] is None else str(t[c]) for c in ("vertices", "edges", "triangles", "truss_edges"))))
    raw = spark.createDataFrame(rows, "design string, kind int, vertices string, edges string, triangles string, truss_edges string")
    exact = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("vertices", "edges", "triangles", "truss_edges")]
    return raw.select("design", "kind", *exact).withColumn("edges_per_vertex", F.col("edges").cast("double") / F.col("vertices").cast("double"))


def degree_table(spark: SparkSession, leaves: list[int], kind: int) -> DataFrame:
    raw = spark.createDataFrame([(str(d), str(n)) for d, n in degree_counts(leaves, kind).items()], "degree string, n string")
    return raw.select(F.col("degree").cast("decimal(38,0)").alias("degree"), F.col("n").cast("decimal(38,0)").alias("n"))


def sub_designs(leaves: list[int]) -> list[list[int]]:
    """All prefixes and suffixes, each once, in order of first appearance."""
    n = len(leaves)
    every = [leaves[:k] for k in range(1, n + 1)] + [leaves[k:] for k in range(n)]
    return [list(x) for x in dict.fromkeys(map(tuple, every))]


def _sizes(leaves: list[int]) -> int:
    return prod(m + 1 for m in leaves)


def product(spark: SparkSession, leaves: list[int], kind: int) -> DataFrame:
    """The product of all factors, its loop still there."""
    out = star(spark, leaves[0], kind)
    for m in leaves[1:]:
        out = linalg.kron(out, star(spark, m, kind), m + 1, m + 1)
    return out


def generate(spark: SparkSession, left: list[int], right: list[int], kind: int, workers: int = 0) -> DataFrame:
    """The graph (i, j, v) of the design left + right.

    Nonzeros of the left product are dealt evenly over ``workers`` tasks and each meets the right
    product, so vertex numbers are global and no message passes between tasks.
    """
    a = product(spark, left, kind)
    a = a.repartition(workers or int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = _sizes(right)
    g = linalg.kron(a, product(spark, right, kind), n, n) if right else a
    if not kind:
        return g
    loop = 1 if kind == 1 else _sizes(left) * (n if right else 1)
    return g.where(~((F.col("i") == loop) & (F.col("j") == loop)))


def measured_degrees(graph: DataFrame) -> DataFrame:
    d = graph.groupBy("j").agg(F.count("*").alias("degree"))
    return d.groupBy("degree").agg(F.count("*").alias("n"))


def check_degrees(graph: DataFrame, leaves: list[int], kind: int) -> DataFrame:
    """(degree, measured, theory) where they differ: empty if the graph is exact."""
    t = degree_table(graph.sparkSession, leaves, kind).select(F.col("degree").cast("long").alias("degree"), F.col("n").cast("long").alias("theory"))
    m = measured_degrees(graph).withColumnRenamed("n", "measured")
    both = m.join(t, "degree", "full_outer").fillna(0, ["measured", "theory"])
    return both.where("measured <> theory")


def check_counts(graph: DataFrame, leaves: list[int], kind: int) -> DataFrame:
    """One row: measured vertices, edges, triangles and 3-truss edges beside the theory's."""
    t = theory(leaves, kind)
    und = canon.undirected(graph, "i", "j")
    vertices = graph.select(F.explode(F.array("i", "j")).alias("x")).agg(F.countDistinct("x").alias("vertices"))
    edges = graph.agg(F.count("*").alias("edges"))
    got = vertices.join(edges).join(triangles.count(und)).join(truss.ktruss_count(und, 3).withColumnRenamed("edges", "truss_edges"))
    return got.select("*", *[F.lit(t[c]).cast("long").alias(f"theory_{c}") for c in ("vertices", "edges", "triangles", "truss_edges")])


def save_small(spark: SparkSession, designs: list[list[int]], kind: int, folder: str, below: int = SAVE_BELOW) -> list[str]:
    """Write the designs with fewer edges than ``below`` as tab-separated triples; returns their folders."""
    out = []
    for d in designs:
        if theory(d, kind)["edges"] < below:
            path = f"{folder.rstrip('/')}/{'-'.join(map(str, d))}-type{kind}"
            generate(spark, d, [], kind).select("i", "j", F.col("v").cast("long").alias("v")).write.mode("overwrite").csv(path, sep="\t")
            out.append(path)
    return out
