"""Canonical graph tables: edges, undirected edges, orientation, incidence, dense indices.

A directed graph is (src, dst, weight); an undirected simple one (a, b) with a < b; a matrix (i, j, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import materialize


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct pairs a < b; loops go, directions and parallel edges collapse."""
    a, b = F.col(src), F.col(dst)
    return edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def loop_count(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The number of self-loop rows that ``undirected`` strips."""
    return edges.agg(F.sum((F.col(src) == F.col(dst)).cast("long")).alias("loops"))


def symmetric(und: DataFrame) -> DataFrame:
    """Both directions of every edge, as (i, j, v = 1)."""
    both = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    return und.select(both.alias("e")).select("e.i", "e.j", F.lit(1.0).alias("v"))


def degrees(und: DataFrame) -> DataFrame:
    return und.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))


def oriented(und: DataFrame) -> DataFrame:
    """(u, v, du, dv): every edge from its end of lower (degree, id), which bounds the wedges at O(m^1.5)."""
    d = degrees(und)
    da, db = d.toDF("a", "da"), d.toDF("b", "db")
    e = und.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    low, high = F.struct(F.col("a").alias("x"), F.col("da").alias("d")), F.struct(F.col("b").alias("x"), F.col("db").alias("d"))
    e = e.select(F.when(up, low).otherwise(high).alias("p"), F.when(up, high).otherwise(low).alias("q"))
    return e.select(F.col("p.x").alias("u"), F.col("q.x").alias("v"), F.col("p.d").alias("du"), F.col("q.d").alias("dv"))


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``order``, without a global window.

    Rows are range-partitioned and sorted; each partition counts its own, and only one offset per
    partition passes through the driver.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = local.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = materialize(local, "index")
    counts = local.groupBy("_p").agg(F.count("*").alias("c")).orderBy("_p").collect()
    offsets, total = [], start
    for r in counts:
        offsets.append((r["_p"], total))
        total += r["c"]
    table = df.sparkSession.createDataFrame(offsets or [(-1, 0)], "_p int, _o long")
    return local.join(F.broadcast(table), "_p").withColumn(name, F.col("_n") + F.col("_o")).drop("_p", "_n", "_o")


def edge_index(und: DataFrame) -> DataFrame:
    """(a, b, edge_id) with ids from 0 in row-major order."""
    return dense_index(und.select("a", "b"), ["a", "b"], "edge_id")


def incidence(indexed: DataFrame) -> DataFrame:
    """Vertex x edge incidence (i = vertex, j = edge_id, v = 1) of indexed edges."""
    return indexed.select(F.explode(F.array("a", "b")).alias("i"), F.col("edge_id").alias("j"), F.lit(1.0).alias("v"))


def edges_of_incidence(inc: DataFrame, edge: str = "i", vertex: str = "j") -> DataFrame:
    """Edge x vertex incidence back to (edge_id, a, b)."""
    return inc.where("v <> 0").groupBy(F.col(edge).alias("edge_id")).agg(F.min(vertex).alias("a"), F.max(vertex).alias("b"))


def degree_rank(und: DataFrame) -> DataFrame:
    """(vertex, degree, rank): ranks from 0 by ascending degree, then id."""
    return dense_index(degrees(und), ["degree", "vertex"], "rank")


def relabel(und: DataFrame, ranks: DataFrame) -> DataFrame:
    """The symmetric permutation of a graph by new vertex numbers."""
    ra = ranks.select(F.col("vertex").alias("a"), F.col("rank").alias("ra"))
    rb = ranks.select(F.col("vertex").alias("b"), F.col("rank").alias("rb"))
    e = und.join(ra, "a").join(rb, "b")
    return e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def row_blocks(rows: DataFrame, row: str, parts: int) -> DataFrame:
    """(row, part): contiguous blocks of rows; the first (count mod parts) blocks get one more."""
    at = dense_index(rows.select(row).distinct(), [row], "at")
    n = at.count()
    size, extra = divmod(n, parts)
    p = F.when(F.col("at") < extra * (size + 1), F.floor(F.col("at") / (size + 1))).otherwise(extra + F.floor((F.col("at") - extra * (size + 1)) / max(size, 1)))
    return at.select(row, p.cast("long").alias("part"))


def incidence_pair(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Ei, Ej): nonzero x row and nonzero x column incidence of a 0/1 matrix, so that Ei' Ej is the matrix."""
    at = dense_index(matrix.where("v <> 0").select("i", "j"), ["i", "j"], "e", start=1)
    one = F.lit(1.0).alias("v")
    return at.select(F.col("e").alias("i"), F.col("i").alias("j"), one), at.select(F.col("e").alias("i"), F.col("j"), one)
