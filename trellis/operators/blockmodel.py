"""Stochastic block partition: block matrices, description length, move and merge costs, search.

A graph is (src, dst, weight), a partition (node, block), a block matrix (r, s, m).  With
f(x) = x ln x the data part of the description length is -sum f(m) + sum f(d_out) + sum f(d_in), so the
cost of a change is the sum of f over the changed cells and degrees alone: every cost below is a table of
cell changes, summed and joined with the matrix once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.scalars import uniform, xlogx
from trellis.operators import canon
from trellis.session import materialize, release

BETA = 3.0
PROPOSALS = 10
SWEEPS = 100
WINDOW = 3
THRESHOLD_OPEN, THRESHOLD_BRACKETED = 5e-4, 1e-4
SHRINK = 0.5
GOLDEN = 0.618


def block_matrix(edges: DataFrame, part: DataFrame) -> DataFrame:
    r, s = part.toDF("src", "r"), part.toDF("dst", "s")
    return edges.join(r, "src").join(s, "dst").groupBy("r", "s").agg(F.sum("weight").alias("m"))


def block_degrees(matrix: DataFrame) -> DataFrame:
    """(block, d_out, d_in, d)."""
    ends = matrix.select(F.explode(F.array(F.struct(F.col("r").alias("block"), F.col("m").alias("o"), F.lit(0).cast("double").alias("i")), F.struct(F.col("s").alias("block"), F.lit(0).cast("double").alias("o"), F.col("m").alias("i")))).alias("e"))
    d = ends.groupBy("e.block").agg(F.sum("e.o").alias("d_out"), F.sum("e.i").alias("d_in"))
    return d.withColumn("d", F.col("d_out") + F.col("d_in"))


def data_entropy(matrix: DataFrame, deg: DataFrame) -> DataFrame:
    m = matrix.agg(F.coalesce(F.sum(xlogx(F.col("m").cast("double"))), F.lit(0.0)).alias("x"))
    d = deg.agg(F.coalesce(F.sum(xlogx(F.col("d_out").cast("double")) + xlogx(F.col("d_in").cast("double"))), F.lit(0.0)).alias("y"))
    return m.join(d).select((F.col("y") - F.col("x")).alias("data_entropy"))


def model_entropy(n_blocks: int, n_nodes: int, n_edges: int, formula: str = "coded") -> float:
    """The model's part; formula 'paper' multiplies both terms of h by the number of edges."""
    x = n_blocks * n_blocks / n_edges
    minus = x * math.log(x) if x > 0 else 0.0
    h = n_edges * ((1 + x) * math.log(1 + x) - minus) if formula == "paper" else n_edges * (1 + x) * math.log(1 + x) - minus
    return h + n_nodes * math.log(n_blocks)


def overall_entropy(edges: DataFrame, part: DataFrame, formula: str = "coded") -> DataFrame:
    """One row: entropy, with blocks, nodes and edge rows counted from the tables."""
    m = block_matrix(edges, part)
    sizes = part.agg(F.countDistinct("block").alias("b"), F.count("*").alias("n")).join(edges.agg(F.count("*").alias("e")))
    x = F.col("b") * F.col("b") / F.col("e")
    first, second = (1 + x) * F.log1p(x), xlogx(x)
    h = F.col("e") * (first - second) if formula == "paper" else F.col("e") * first - second
    return data_entropy(m, block_degrees(m)).join(sizes).select((F.col("data_entropy") + h + F.col("n") * F.ln("b")).alias("entropy"))


def _cost(changes: DataFrame, keys: list[str], matrix: DataFrame, deg: DataFrame) -> DataFrame:
    """(keys, ds) from changes (keys, i, j, dm): the change of the data entropy."""
    cells = changes.groupBy(*keys, "i", "j").agg(F.sum("dm").cast("double").alias("dm")).where("dm <> 0")
    known = matrix.select(F.col("r").alias("i"), F.col("s").alias("j"), F.col("m").cast("double").alias("m"))
    cells = cells.join(known, ["i", "j"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    by_cell = cells.groupBy(*keys).agg(F.sum(xlogx(F.col("m")) - xlogx(F.col("m") + F.col("dm"))).alias("x"))
    ends = cells.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(True).alias("out")), F.struct(F.col("j").alias("block"), F.lit(False).alias("out")))).alias("e"), "dm")
    moved = ends.groupBy(*keys, F.col("e.block").alias("block"), F.col("e.out").alias("out")).agg(F.sum("dm").alias("dd")).where("dd <> 0")
    moved = moved.join(deg.select("block", F.col("d_out").cast("double").alias("d_out"), F.col("d_in").cast("double").alias("d_in")), "block", "left")
    old = F.coalesce(F.when(F.col("out"), F.col("d_out")).otherwise(F.col("d_in")), F.lit(0.0))
    by_degree = moved.groupBy(*keys).agg(F.sum(xlogx(old + F.col("dd")) - xlogx(old)).alias("y"))
    both = by_cell.join(by_degree, keys, "full_outer")
    return both.select(*keys, (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("ds"))


def merge_candidates(matrix: DataFrame) -> DataFrame:
    """(r, s): every block with each of its neighbours in the block graph."""
    e = matrix.where("r <> s")
    return e.select("r", "s").union(e.select("s", "r")).toDF("r", "s").distinct()


def merge_costs(matrix: DataFrame, deg: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(r, s, ds): the cost of merging r into s, for all candidates."""
    pairs = candidates if candidates is not None else merge_candidates(matrix)
    m = matrix.select(F.col("r").alias("x"), F.col("s").alias("y"), "m")
    rows = pairs.join(m, pairs["r"] == m["x"]).select("r", "s", "x", "y", "m")
    cols = pairs.join(m.where("x <> y"), pairs["r"] == F.col("y")).select("r", "s", "x", "y", "m")
    touched = rows.unionByName(cols)

    def to(c):
        return F.when(F.col(c) == F.col("r"), F.col("s")).otherwise(F.col(c))

    change = F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j"), (-F.col("m")).alias("dm")), F.struct(to("x").alias("i"), to("y").alias("j"), F.col("m").alias("dm")))
    return _cost(touched.select("r", "s", F.explode(change).alias("c")).select("r", "s", "c.*"), ["r", "s"], matrix, deg)


def best_merges(costs: DataFrame) -> DataFrame:
    """(r, s, ds): the cheapest merge of each block; ties go to the smaller partner."""
    best = costs.groupBy("r").agg(F.min(F.struct("ds", "s")).alias("b"))
    return best.select("r", F.col("b.s").alias("s"), F.col("b.ds").alias("ds"))


def compact_labels(part: DataFrame) -> DataFrame:
    """Blocks renumbered 0 .. B-1 in order; the distinct labels are numbered without a global window."""
    from trellis.operators.canon import dense_index

    names = dense_index(part.select("block").distinct(), ["block"], "at")
    return part.join(names, "block").select("node", F.col("at").cast("long").alias("block"))


DRIVER_BLOCKS = 100_000


def apply_merges(part: DataFrame, best: DataFrame, wanted: int, most: int = DRIVER_BLOCKS) -> DataFrame:
    """Carry out the ``wanted`` cheapest merges (r, s, ds), one per r, following blocks that already moved.

    In order of cost each block moves to where its partner is by then, unless that is the block itself.  At
    most ``most`` blocks (counted) are followed in the driver; more are by ``followed_merges``, to the same end.
    """
    best = materialize(best.select("r", "s", "ds"), "merges")
    if best.count() > most:
        table = followed_merges(best, wanted)
    else:
        moves = {}

        def root(b):
            while b in moves:
                b = moves[b]
            return b

        for row in best.orderBy("ds", "r").collect():
            if len(moves) == wanted:
                break
            if row["r"] != (to := root(row["s"])):
                moves[row["r"]] = to
        if not moves:
            return compact_labels(part)
        table = part.sparkSession.createDataFrame([(b, root(b)) for b in moves], "block long, to long")
    return compact_labels(part.join(table, "block", "left").select("node", F.coalesce("to", "block").alias("block")))


def followed_merges(best: DataFrame, wanted: int) -> DataFrame:
    """(block, to): the same as jobs.

    A block has one merge, so following merges leads to a cycle at most, and of a cycle only the last merge in
    order fails: its block is by then where it would move to.  Paths are followed in doubled strides.
    """
    ranked = materialize(canon.dense_index(best, ["ds", "r"], "at"), "merges-ranked")
    strides = max(1, math.ceil(math.log2(max(ranked.count(), 2))))
    # after 2**strides steps every path is on its cycle or has ended; top is the last merge met on the way
    path = ranked.select(F.col("r").alias("b"), F.col("s").alias("to"), F.col("at").alias("top"))
    for _ in range(strides):
        on = path.select(F.col("b").alias("to"), F.col("to").alias("next"), F.col("top").alias("further"))
        path = materialize(path.join(on, "to").select("b", F.col("next").alias("to"), F.greatest("top", "further").alias("top")), "merges-path")
    cycles = path.select(F.col("to").alias("b")).distinct()
    last = path.join(cycles, "b").select(F.col("b").alias("r"), F.col("top").alias("at"))
    good = ranked.join(last, ["r", "at"], "left_anti")
    moves = canon.dense_index(good, ["at"], "nth").where(F.col("nth") < wanted).select(F.col("r").alias("block"), F.col("s").alias("to"))
    moves = materialize(moves, "merges-moves")
    while True:
        on = moves.select(F.col("block").alias("to"), F.col("to").alias("next"))
        if moves.join(on, "to").isEmpty():
            return moves
        moves = materialize(moves.join(on, "to", "left").select("block", F.coalesce("next", "to").alias("to")), "merges-moves")


def node_block_histogram(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(node, block, k_out, k_in, own): weights to and from each neighbouring block, loops apart in own."""
    p = part.toDF("other", "block")
    one = edges.where("src <> dst")
    out = one.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").cast("double").alias("k_out"), F.lit(0.0).alias("k_in"))
    into = one.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0.0).alias("k_out"), F.col("weight").cast("double").alias("k_in"))
    hist = out.unionByName(into).join(p, "other").groupBy("node", "block").agg(F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"))
    loops = edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").cast("double").alias("own"))
    return hist.join(loops, "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))


def move_costs(hist: DataFrame, moves: DataFrame, matrix: DataFrame, deg: DataFrame) -> DataFrame:
    """(node, s, ds) for moves (node, r, s)."""
    h = hist.join(moves, "node")

    def cell(i, j, dm):
        return F.struct(i.alias("i"), j.alias("j"), dm.alias("dm"))

    r, s, t, o, n = (F.col(c) for c in ("r", "s", "block", "k_out", "k_in"))
    change = F.array(cell(r, t, -o), cell(s, t, o), cell(t, r, -n), cell(t, s, n))
    changes = h.select("node", "s", F.explode(change).alias("c")).select("node", "s", "c.*")
    own = h.where("own > 0").select("node", "r", "s", "own").distinct()
    loops = own.select("node", "s", F.explode(F.array(cell(r, r, -F.col("own")), cell(s, s, F.col("own")))).alias("c")).select("node", "s", "c.*")
    found = _cost(changes.unionByName(loops), ["node", "s"], matrix, deg)
    still = moves.select("node", "s").join(found, ["node", "s"], "left")
    return still.select("node", "s", F.coalesce("ds", F.lit(0.0)).alias("ds"))


def proposal_terms(hist: DataFrame, matrix: DataFrame, deg: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """The chance that a node proposes a block, in closed form and sparse: (node, base) and (node, s, more).

    A neighbouring block u is drawn by weight; with chance B/(d_u+B) the proposal is uniform, else it
    follows u's row plus column of the matrix.  Every block has the node's base, and those next to its
    neighbours' blocks have more, so the tables grow with the edges and not with nodes times blocks.
    """
    k = hist.select("node", F.col("block").alias("u"), (F.col("k_out") + F.col("k_in")).alias("k"))
    share = k.join(k.groupBy("node").agg(F.sum("k").alias("all")), "node").select("node", "u", (F.col("k") / F.col("all")).alias("w"))
    share = share.join(deg.select(F.col("block").alias("u"), "d"), "u")
    both = matrix.unionByName(matrix.select(F.col("s").alias("r"), F.col("r").alias("s"), "m")).groupBy("r", "s").agg(F.sum("m").alias("m"))
    row = both.select(F.col("r").alias("u"), "s", "m")
    base = share.groupBy("node").agg((F.sum(F.col("w") * n_blocks / (F.col("d") + n_blocks)) / n_blocks).alias("base"))
    return base, share.join(row, "u").groupBy("node", "s").agg(F.sum(F.col("w") * F.col("m") / (F.col("d") + n_blocks)).alias("more"))


def proposal_probabilities(hist: DataFrame, matrix: DataFrame, deg: DataFrame, n_blocks: int) -> DataFrame:
    """(node, s, p): ``proposal_terms`` written out for every block, for reports of small partitions."""
    base, more = proposal_terms(hist, matrix, deg, n_blocks)
    every = base.join(F.broadcast(deg.select(F.col("block").alias("s"))))
    return every.join(more, ["node", "s"], "left").select("node", "s", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("p"))


def hastings(hist: DataFrame, moves: DataFrame, matrix: DataFrame, deg: DataFrame, n_blocks: int) -> DataFrame:
    """(node, s, h): p(back)/p(forth) of each move, after against before the change.

    p = sum over neighbouring blocks t of k_t (M_ts + M_st + 1) / (d_t + B).
    """
    k = hist.join(moves, "node").select("node", "r", "s", F.col("block").alias("t"), "k_out", "k_in", "own", (F.col("k_out") + F.col("k_in")).alias("k"))
    both = matrix.unionByName(matrix.select(F.col("s").alias("r"), F.col("r").alias("s"), "m")).groupBy("r", "s").agg(F.sum("m").cast("double").alias("m"))
    total = k.groupBy("node", "s").agg(F.sum("k").alias("all"), F.sum(F.when(F.col("t") == F.col("r"), F.col("k")).otherwise(0.0)).alias("to_r"), F.sum(F.when(F.col("t") == F.col("s"), F.col("k")).otherwise(0.0)).alias("to_s"), F.max("own").alias("loop"))
    k = k.join(total, ["node", "s"])
    for name, c in (("ms", "s"), ("mr", "r")):
        k = k.join(both.select(F.col("r").alias("t"), F.col("s").alias(c), F.col("m").alias(name)), ["t", c], "left")
    k = k.join(deg.select(F.col("block").alias("t"), F.col("d").cast("double").alias("d")), "t")
    k = k.fillna(0.0, ["ms", "mr"])
    t, r, s = F.col("t"), F.col("r"), F.col("s")
    full = F.col("all") + 2 * F.col("loop")  # of the node's degree
    # of M_tr + M_rt after the move: the node's weight to t leaves r's row and column
    after = F.when(t == r, F.col("mr") - 2 * F.col("to_r") - 2 * F.col("loop")).when(t == s, F.col("mr") - F.col("to_s") + F.col("to_r")).otherwise(F.col("mr") - F.col("k"))
    d_after = F.when(t == r, F.col("d") - full).when(t == s, F.col("d") + full).otherwise(F.col("d"))
    terms = k.groupBy("node", "s").agg(F.sum(F.col("k") * (F.col("ms") + 1) / (F.col("d") + n_blocks)).alias("forth"), F.sum(F.col("k") * (after + 1) / (d_after + n_blocks)).alias("back"))
    return terms.select("node", "s", (F.col("back") / F.col("forth")).alias("h"))


def propose(hist: DataFrame, part: DataFrame, matrix: DataFrame, deg: DataFrame, n_blocks: int, seed: int) -> DataFrame:
    """(node, r, s): one seeded draw of the proposal distribution for each node, by inverse cumulative sums."""
    both = matrix.unionByName(matrix.select(F.col("s").alias("r"), F.col("r").alias("s"), "m")).groupBy("r", "s").agg(F.sum("m").cast("double").alias("m"))
    by_node = Window.partitionBy("node").orderBy("block")
    k = hist.select("node", "block", (F.col("k_out") + F.col("k_in")).alias("k"))
    k = k.withColumn("upto", F.sum("k").over(by_node)).withColumn("all", F.sum("k").over(Window.partitionBy("node")))
    u = k.where((F.col("upto") > uniform(seed, F.col("node")) * F.col("all"))).groupBy("node").agg(F.min("block").alias("u"))
    u = u.join(deg.select(F.col("block").alias("u"), F.col("d").cast("double").alias("d")), "u")
    row = both.select(F.col("r").alias("u"), "s", F.sum("m").over(Window.partitionBy("r").orderBy("s")).alias("upto"))
    drawn = u.join(row, "u").where(F.col("upto") > uniform(seed + 2, F.col("node")) * F.col("d")).groupBy("node").agg(F.min("s").alias("near"))
    every = part.join(u, "node", "left").join(drawn, "node", "left")
    jump = F.col("u").isNull() | (uniform(seed + 1, F.col("node")) < n_blocks / (F.col("d") + n_blocks)) | F.col("near").isNull()
    anywhere = F.floor(uniform(seed + 3, F.col("node")) * n_blocks).cast("long")
    return every.select("node", F.col("block").alias("r"), F.when(jump, anywhere).otherwise(F.col("near")).alias("s"))


def sweep(edges: DataFrame, part: DataFrame, n_blocks: int, seed: int, beta: float = BETA) -> tuple[DataFrame, float]:
    """A bulk-synchronous sweep: all proposals against the same matrix, accepted by seeded chance.

    Returns the new partition and the summed cost of the accepted moves.
    """
    m = materialize(block_matrix(edges, part), "sbp-matrix")
    deg = materialize(block_degrees(m), "sbp-degrees")
    hist = materialize(node_block_histogram(edges, part), "sbp-histogram")
    moves = propose(hist, part, m, deg, n_blocks, seed).where("r <> s")
    moves = materialize(moves, "sbp-moves")
    judged = move_costs(hist, moves, m, deg).join(hastings(hist, moves, m, deg, n_blocks), ["node", "s"], "left")
    chance = F.exp(F.least(-beta * F.col("ds"), F.lit(50.0))) * F.coalesce("h", F.lit(1.0))
    taken = materialize(judged.where(uniform(seed + 4, F.col("node")) < chance).select("node", "s", "ds"), "sbp-taken")
    new = materialize(part.join(taken.select("node", "s"), "node", "left").select("node", F.coalesce("s", "block").alias("block")), "sbp-partition")
    ds = taken.agg(F.coalesce(F.sum("ds"), F.lit(0.0))).first()[0]
    release(m, deg, hist, moves, taken)
    return new, float(ds)


class SparkSteps:
    """The steps of the search as jobs; a partition is a table."""

    def __init__(self, edges: DataFrame, seed: int, beta: float):
        self.table = edges
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        self.first = materialize(compact_labels(nodes.withColumn("block", F.col("node"))), "sbp-partition")
        self.n, self.edges, self.seed, self.beta, self.step = self.first.count(), edges.count(), seed, beta, 0

    def start(self) -> tuple[DataFrame, int]:
        return self.first, self.n

    def compact(self, part: DataFrame) -> tuple[DataFrame, int]:
        part = materialize(compact_labels(part), "sbp-partition")
        return part, part.select("block").distinct().count()

    def entropy(self, part: DataFrame, blocks: int) -> float:
        m = block_matrix(self.table, part)
        return float(data_entropy(m, block_degrees(m)).first()[0]) + model_entropy(blocks, self.n, self.edges)

    def merge(self, part: DataFrame, blocks: int, wanted: int) -> tuple[DataFrame, int]:
        m = materialize(block_matrix(self.table, part), "sbp-matrix")
        cheap = best_merges(merge_costs(m, block_degrees(m)))
        part = materialize(apply_merges(part, cheap, wanted), "sbp-partition")
        return part, part.select("block").distinct().count()

    def sweep(self, part: DataFrame, blocks: int) -> tuple[DataFrame, float]:
        self.step += 1
        return sweep(self.table, part, blocks, self.seed * 1_000_003 + self.step * 11, self.beta)


@dataclass
class Probe:
    blocks: int
    entropy: float
    part: object


def search(steps, sweeps: int):
    """Merges from singletons, sweeps between, and golden-section search for the number of blocks."""
    part, blocks = steps.start()
    if blocks < 2:
        return part
    high, best, low = None, Probe(blocks, math.inf, part), None
    target = max(1, int(blocks * (1 - SHRINK)))
    while True:
        part, reached = steps.merge(part, blocks, blocks - target)
        stuck = reached == blocks
        blocks = reached
        entropy = steps.entropy(part, blocks)
        limit = THRESHOLD_BRACKETED if low is not None else THRESHOLD_OPEN
        recent: list[float] = []
        for _ in range(sweeps if blocks > 1 else 0):
            part, ds = steps.sweep(part, blocks)
            recent.append(ds)
            last = recent[-WINDOW + 1 :]
            if len(recent) >= WINDOW and -sum(last) / len(last) < limit * entropy:
                break
        part, blocks = steps.compact(part)
        probe = Probe(blocks, steps.entropy(part, blocks), part)
        if probe.entropy <= best.entropy:
            if blocks < best.blocks:
                high, best = best, probe
            else:
                low, best = best, probe
        elif blocks < best.blocks:
            low = probe
        else:
            high = probe
        if low is None:
            target = int(best.blocks * (1 - SHRINK))
            if target < 1 or stuck:
                return best.part
            part, blocks = best.part, best.blocks
            continue
        top = high.blocks if high is not None else best.blocks
        if top - low.blocks <= 2 or stuck:
            return best.part
        upper, lower = top - best.blocks, best.blocks - low.blocks
        if high is not None and upper >= lower:
            target = best.blocks + max(1, round(upper * (1 - GOLDEN))) if upper > 1 else best.blocks
            part, blocks = high.part, high.blocks
        else:
            target = low.blocks + max(1, round(lower * GOLDEN)) if lower > 1 else best.blocks
            part, blocks = best.part, best.blocks
        if target in (best.blocks, blocks, low.blocks):
            return best.part


LOCAL_NODES, LOCAL_EDGES = 3_000, 1_000_000


def partition(edges: DataFrame, seed: int = 1, sweeps: int = SWEEPS, beta: float = BETA, local: bool | None = None) -> DataFrame:
    """(node, block).  Graphs of at most LOCAL_NODES nodes and LOCAL_EDGES edges (counted) are searched in one task."""
    edges = materialize(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "sbp-edges")
    if local is None:
        n_edges = edges.count()
        local = n_edges <= LOCAL_EDGES and edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count() <= LOCAL_NODES
    if not local:
        return search(SparkSteps(edges, seed, beta), sweeps)

    def run(key, t):
        import numpy as np
        import pyarrow as pa

        from trellis.operators.blockmodel_local import LocalSteps

        src, dst, w = (t[c].to_numpy() for c in ("src", "dst", "weight"))
        order = np.lexsort((w, dst, src))  # the same result however the rows arrived
        names, at = np.unique(np.concatenate((src[order], dst[order])), return_inverse=True)
        found = search(LocalSteps(at[: len(src)], at[len(src) :], w[order], len(names), seed, beta), sweeps)
        return pa.table({"node": pa.array(names), "block": pa.array(np.asarray(found, np.int64))})

    one = edges.where("src is not null and dst is not null").withColumn("all", F.lit(0))
    return one.groupBy("all").applyInArrow(run, "node long, block long")
