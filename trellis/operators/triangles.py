"""Triangle counting, enumeration, degrees and k-counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators import linalg, tiles
from trellis.session import materialize, release

#: Edges that are broadcast at most: 32 MB at 64 bytes each once hashed.
BROADCAST_EDGES = (32 << 20) // 64


def choose2(k: Column) -> Column:
    return (k * (k - 1) / 2).cast("long")


def enumerate_triangles(und: DataFrame) -> DataFrame:
    """(v1, v2, v3) with v1 < v2 < v3, each triangle once; an edge may be given repeatedly.

    Edges are dealt as tiles (see ``tiles``): neither a wedge nor a product of the whole matrix is ever held.
    """
    return tiles.listed(tiles.packed(und))


def count_by_trace(adjacency: DataFrame | tiles.Packed) -> DataFrame:
    """sum(A^2 .* A) / 6 of a symmetric matrix; weights multiply.  One three-way join: A^2 is never formed.

    Ones without loops (checked as they are packed, or given packed) are searched in tiles: each triangle holds six of the
    products.
    """
    if isinstance(adjacency, DataFrame):
        unfit = F.coalesce(F.col("v") != 1, F.lit(True)) | F.coalesce(F.col("i") == F.col("j"), F.lit(False))
        rows = adjacency.where(unfit | (F.col("i") < F.col("j")))
        rows = rows.select(F.when(unfit, 0).otherwise(F.col("i")).alias("a"), F.when(unfit, 0).otherwise(F.col("j")).alias("b"), unfit.cast("long").alias("w"))
        g = tiles.packed(rows, number=F.col("w"))
        odd = g.cells.agg(F.max("hit")).first()[0]
    else:
        g, odd = adjacency, 0
    if not odd:
        return tiles.counted(g).select(F.col("triangles").cast("double").alias("triangles"))
    release(g.cells)
    a = adjacency.select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("v").alias("v1"))
    b = adjacency.select(F.col("i").alias("y"), F.col("j").alias("z"), F.col("v").alias("v2"))
    c = adjacency.select(F.col("i").alias("z"), F.col("j").alias("x"), F.col("v").alias("v3"))
    t = a.join(b, "y").join(c, ["z", "x"])
    return t.agg((F.coalesce(F.sum(F.col("v1") * F.col("v2") * F.col("v3")), F.lit(0.0)) / 6).alias("triangles"))


def count_by_incidence(adjacency: DataFrame, incidence: DataFrame) -> DataFrame:
    """nnz(A * B == 2) / 3.

    A cell of the product is 2 where a vertex is next to both ends of an edge.  If A is symmetric with ones and no
    loops, and each column of B has two ones (all checked), these are counted in tiles, and the product is not formed.
    """
    pair = [F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")]
    near = adjacency.where("v is null or v <> 0").groupBy(*pair).agg(F.count("*").alias("m"), F.min(F.coalesce(F.col("v") == 1, F.lit(False)) & (F.col("i") != F.col("j"))).alias("fit"), F.countDistinct("i").alias("ways"))
    ends = incidence.where("v is null or v <> 0").groupBy("j").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("m"), F.min(F.coalesce(F.col("v") == 1, F.lit(False))).alias("fit"))
    near = near.select("a", "b", F.lit(1).alias("w"), (F.col("fit") & (F.col("m") == 2) & (F.col("ways") == 2)).alias("fit"))
    ends = ends.select("a", "b", F.lit(2).alias("w"), (F.col("fit") & (F.col("m") == 2) & (F.col("a") != F.col("b"))).alias("fit"))
    both = near.unionByName(ends).groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("fit").alias("fit"))
    both = materialize(both, "incidence-edges")
    if both.where("not fit").isEmpty():
        hits = tiles.opposite(tiles.packed(both, number=F.col("w"), distinct=True)).withColumnRenamed("n", "hits")
    else:
        hits = linalg.where_equal(linalg.spgemm(adjacency, incidence), 2.0).agg(F.count("*").alias("hits"))
    return hits.select(F.floor(F.col("hits") / 3).cast("long").alias("triangles"))


def count(und: DataFrame) -> DataFrame:
    return tiles.counted(tiles.packed(und))


def listing(tri: DataFrame) -> DataFrame:
    """Triangles largest vertex first."""
    return tri.select(F.col("v3").alias("v1"), F.col("v2").alias("v2"), F.col("v1").alias("v3"))


def vertex_degrees(tri: DataFrame) -> DataFrame:
    return tri.select(F.explode(F.array("v1", "v2", "v3")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("triangles"))


def edges_of(tri: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v1", "v2"), ("v1", "v3"), ("v2", "v3"))])
    return tri.select(F.explode(sides).alias("e")).select("e.*")


def edge_support(und: DataFrame, tri: DataFrame) -> DataFrame:
    """(a, b, triangles), edges without any included."""
    n = edges_of(tri).groupBy("a", "b").agg(F.count("*").alias("triangles"))
    return und.select("a", "b").join(n, ["a", "b"], "left").select("a", "b", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def k_cap(n_vertices: int) -> int:
    """The largest k that is told apart; the last bin takes all above."""
    return max(10, math.isqrt(n_vertices)) - 1


def k_of_triangles(tri: DataFrame, cap: int | None) -> DataFrame:
    """(v1, v2, v3, k): the largest k with C(k-1, 2) triangles at each vertex and k-2 at each edge.

    The bounds of vertices go into those of their edges, so each triangle looks up its three edges only.
    """
    vd = vertex_degrees(tri).select("vertex", F.floor((3 + F.sqrt(1 + 8 * F.col("triangles"))) / 2).alias("most"))
    es = edges_of(tri).groupBy("a", "b").agg((F.count("*") + 2).alias("most"))
    bound = es.join(vd.toDF("a", "ma"), "a").join(vd.toDF("b", "mb"), "b").select("a", "b", F.least("most", "ma", "mb").cast("long").alias("most"))
    bound = materialize(bound, "edge-bounds")
    few = bound.count() <= BROADCAST_EDGES
    t = tri
    for k, (a, b) in enumerate((("v1", "v2"), ("v1", "v3"), ("v2", "v3"))):
        side = bound.toDF(a, b, f"m{k}")
        t = t.join(F.broadcast(side) if few else side, [a, b])
    k = F.least("m0", "m1", "m2")
    return t.select("v1", "v2", "v3", (F.least(k, F.lit(cap)) if cap is not None else k).cast("long").alias("k"))


def k_counts(tri: DataFrame, cap: int | None) -> DataFrame:
    return k_of_triangles(tri, cap).groupBy("k").agg(F.count("*").alias("n"))


def k_counts_of_graph(g: tiles.Packed, capped: bool = True) -> tuple[DataFrame, int]:
    """``k_counts`` and the cap without a list of triangles: one search finds the supports, a second the least bounds."""
    cap = k_cap(tiles.vertex_sums(g).count())
    s = tiles.supported(g, 1)
    most = tiles.vertex_sums(s).select("vertex", (F.floor((3 + F.sqrt(1 + 4 * F.col("total"))) / 2) - 2).alias("most"))  # a triangle counts at two edges of its vertex
    n = tiles.histogram(s, cap=cap - 2 if capped else None, vertices=most)
    return n.select((F.col("k") + 2).alias("k"), "n"), cap


def k_table(counts: DataFrame, cap: int) -> DataFrame:
    """All k from 3 to the cap, zeros included."""
    ks = counts.sparkSession.range(3, cap + 1).toDF("k")
    return ks.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def clique_bound(counts: DataFrame) -> DataFrame:
    """The largest k such that at least C(k, 3) triangles have a value of k or more.

    The histogram has at most one row per k, so a single task holds it.
    """
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("k")
    enough = counts.withColumn("above", F.sum("n").over(w)).where(F.col("above") >= k * (k - 1) * (k - 2) / 6)
    return enough.agg(F.coalesce(F.max("k"), F.lit(0)).cast("long").alias("bound"))
