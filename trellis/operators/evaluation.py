"""Quality of a partition against another: contingency, pair counts, information, optimal matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.scalars import xlogx


def contingency(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(t, a, n) over nodes that both partitions know."""
    t, a = truth.toDF("node", "t").where("t is not null"), found.toDF("node", "a").where("a is not null")
    return t.join(a, "node").groupBy("t", "a").agg(F.count("*").alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    """One row: n, and the pairs within cells, truth blocks and found blocks."""

    def pairs(c):
        return c * (c - 1) / 2

    cells = table.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("cell"))
    t = table.groupBy("t").agg(F.sum("n").alias("x")).agg(F.sum(pairs(F.col("x"))).alias("row"))
    a = table.groupBy("a").agg(F.sum("n").alias("x")).agg(F.sum(pairs(F.col("x"))).alias("col"))
    return cells.join(t).join(a).withColumn("all", pairs(F.col("n")))


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: rand_index, adjusted_rand, recall, precision."""
    s = _sums(table)
    expected = F.col("row") * F.col("col") / F.col("all")
    same, other = F.col("cell"), F.col("all") - F.col("row") - F.col("col") + F.col("cell")
    return s.select(
        ((same + other) / F.col("all")).alias("rand_index"),
        ((F.col("cell") - expected) / ((F.col("row") + F.col("col")) / 2 - expected)).alias("adjusted_rand"),
        (F.col("cell") / F.col("row")).alias("recall"),
        (F.col("cell") / F.col("col")).alias("precision"),
    )


def probabilities(table: DataFrame) -> DataFrame:
    """(t, a, p, p_t, p_a, p_a_given_t, p_t_given_a)."""
    w = table.select("t", "a", "n").join(table.groupBy("t").agg(F.sum("n").alias("nt")), "t").join(table.groupBy("a").agg(F.sum("n").alias("na")), "a")
    w = w.join(F.broadcast(table.agg(F.sum("n").alias("all"))))
    return w.select("t", "a", (F.col("n") / F.col("all")).alias("p"), (F.col("nt") / F.col("all")).alias("p_t"), (F.col("na") / F.col("all")).alias("p_a"), (F.col("n") / F.col("nt")).alias("p_a_given_t"), (F.col("n") / F.col("na")).alias("p_t_given_a"))


def information(table: DataFrame) -> DataFrame:
    """One row: entropies, conditional entropies, mutual information, missed and erroneous shares."""

    def plogp(groups: DataFrame, name: str) -> DataFrame:
        return groups.agg(F.sum(xlogx(F.col("x").cast("double"))).alias(name))

    total = table.agg(F.sum("n").cast("double").alias("n"))
    joint = plogp(table.select(F.col("n").alias("x")), "j")
    t = plogp(table.groupBy("t").agg(F.sum("n").alias("x")), "ft")
    a = plogp(table.groupBy("a").agg(F.sum("n").alias("x")), "fa")
    s = total.join(joint).join(t).join(a)
    n = F.col("n")

    def h(c):
        return F.ln(n) - F.col(c) / n

    s = s.select(h("ft").alias("h_truth"), h("fa").alias("h_found"), h("j").alias("h_joint"))
    s = s.withColumn("h_found_given_truth", F.col("h_joint") - F.col("h_truth")).withColumn("h_truth_given_found", F.col("h_joint") - F.col("h_found"))
    s = s.withColumn("mutual_information", F.col("h_truth") + F.col("h_found") - F.col("h_joint"))

    def share(x, y):
        return F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))

    return s.drop("h_joint").withColumn("missed", share("h_truth_given_found", "h_truth")).withColumn("erroneous", share("h_found_given_truth", "h_found"))


def counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: nodes, blocks of the truth, and found blocks as the largest label (from 0) plus one."""
    both = truth.toDF("node", "t").join(found.toDF("node", "a"), "node")
    return both.agg(F.count("*").alias("nodes"), F.countDistinct("t").alias("truth_blocks"), (F.max("a") + 1).cast("long").alias("found_blocks"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row its column in a matching of least total cost (rows <= columns).

    Shortest augmenting paths with potentials; the scan over columns is vectorised, so n rows and m columns
    take n * n steps of m at most.
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        dist, before = np.full(m, np.inf), np.full(m, -1)
        used = np.zeros(m, bool)
        row, last, base = i, -1, 0.0
        while True:
            reach = base + cost[row] - u[row] - v
            nearer = ~used & (reach < dist)
            dist[nearer], before[nearer] = reach[nearer], last
            last = int(np.argmin(np.where(used, np.inf, dist)))
            base, used[last] = dist[last], True
            if row_of[last] < 0:
                break
            row = row_of[last]
        # potentials keep reduced costs non-negative along the tree
        tree = np.flatnonzero(used)
        tree = tree[tree != last]
        u[i] += base
        u[row_of[tree]] += base - dist[tree]
        v[tree] += dist[tree] - base
        while last >= 0:
            k = before[last]
            row_of[last] = row_of[k] if k >= 0 else i
            last = k
    out = np.full(n, -1)
    taken = np.flatnonzero(row_of >= 0)
    out[row_of[taken]] = taken
    return out


MAX_BLOCKS = 5000


def matched(table: DataFrame) -> DataFrame:
    """(t, a): found blocks matched to truth blocks so that most nodes agree.

    Blocks, not nodes, go to the driver, as a matrix of at most MAX_BLOCKS squared; more blocks on a side raise
    an error, since an exact matching of them takes their cube of steps.
    """
    t = [r[0] for r in table.select("t").distinct().orderBy("t").limit(MAX_BLOCKS + 1).collect()]
    a = [r[0] for r in table.select("a").distinct().orderBy("a").limit(MAX_BLOCKS + 1).collect()]
    if max(len(t), len(a), 0) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks to match")
    flip = len(t) > len(a)
    rows, cols = (a, t) if flip else (t, a)
    ri, ci = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
    cost = np.zeros((len(rows), len(cols)))
    for r in table.toLocalIterator():
        cost[ri[r["a"] if flip else r["t"]], ci[r["t"] if flip else r["a"]]] = -float(r["n"])
    pairs = [(rows[i], cols[j]) for i, j in enumerate(assignment(cost).tolist())]
    pairs = [(y, x) if flip else (x, y) for x, y in pairs]
    kinds = dict(table.dtypes)
    return table.sparkSession.createDataFrame(pairs, f"t {kinds['t']}, a {kinds['a']}")


def accuracy(table: DataFrame) -> DataFrame:
    """Share of nodes in matched blocks."""
    right = table.join(F.broadcast(matched(table)), ["t", "a"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("right"))
    return right.join(table.agg(F.sum("n").alias("n"))).select((F.col("right") / F.col("n")).alias("accuracy"))
