"""Sparse matrix algebra over triples (i, j, v): absent means zero, and no operator keeps a zero."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import tiles
from trellis.session import materialize

SHARES = 4
#: A tile has about so many pairs, and so many entries of either side; pairs and cells are made a chunk at a time.
TILE_PAIRS, TILE_ENTRIES, CHUNK = 1 << 28, 1 << 21, 1 << 22
#: Pairs whose lists are held at once.
LIST_PAIRS = 1 << 20
#: Tiles a side at most, unless memory asks for more, where lists leave tiles a few rows at a time: each side is moved so many times.
LIST_SIDE = 8
#: Cells that are summed up at once, and bits of a word that a double holds exactly.
SPAN_CELLS, WORD = 1 << 18, 52
#: Entries that are packed at once, and rows of a batch.
PACKED, BATCH = 1 << 20, 1 << 18
#: Tiles serve where they make so many pairs of each entry that they move.
DENSE = 8


def nonzero(m: DataFrame) -> DataFrame:
    return m.where("v <> 0")


def from_triples(rows: DataFrame) -> DataFrame:
    """Sum duplicates and drop zeros."""
    return nonzero(rows.groupBy("i", "j").agg(F.sum("v").alias("v")))


def pair_counts(x: DataFrame, y: DataFrame) -> DataFrame:
    """(k, p, q, nulls): the entries that each inner index has on both sides of x (i, k, ..) times y (k, j, ..), and those of no row or column."""
    n = x.groupBy("k").agg(F.count("*").alias("p"), (F.count("*") - F.count("i")).alias("x0")).join(y.groupBy("k").agg(F.count("*").alias("q"), (F.count("*") - F.count("j")).alias("y0")), "k")
    n = n.select("k", "p", "q", (F.col("x0") + F.col("y0")).alias("nulls"))
    return materialize(n, "pairs")


def dealt_pairs(x: DataFrame, y: DataFrame, counts: DataFrame) -> DataFrame:
    """The join of x (i, k, ..) and y (k, j, ..) on k, with the pairs of hot inner indices dealt over many tasks.

    An index of p and q entries makes p * q pairs.  One that makes more than its share is cut into
    blocks of rows times blocks of columns, each a join key of its own.  The few such indices (less than
    SHARES a task) and their numbers of blocks are broadcast; all others are an ordinary join.
    """
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = counts.select("k", (F.col("p").cast("double") * F.col("q")).alias("pairs"))
    share = max(1.0, (pairs.agg(F.sum("pairs")).first()[0] or 0.0) / (SHARES * tasks))
    hot = F.broadcast(pairs.where(F.col("pairs") > share).select("k", F.ceil(F.sqrt(F.col("pairs") / share)).cast("int").alias("blocks")))

    def dealt(side: DataFrame, own: str, row: str, column: str) -> DataFrame:
        n = F.coalesce("blocks", F.lit(1))
        marked = side.join(hot, "k", "left").withColumn(row, F.pmod(F.xxhash64(own), n).cast("int"))
        return marked.withColumn(column, F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")

    return dealt(x, "i", "row_block", "column_block").join(dealt(y, "j", "column_block", "row_block"), ["k", "row_block", "column_block"])


class _Tile:
    """Two sides with the inner indices that both have: x by (row, inner index), y by (inner index, column), all numbered from 0."""

    def __init__(self, i: np.ndarray, kx: np.ndarray, va: np.ndarray, ky: np.ndarray, j: np.ndarray, vb: np.ndarray):
        self.inner = np.intersect1d(kx, ky)
        here, there = np.isin(kx, self.inner), np.isin(ky, self.inner)
        self.rows, i = np.unique(i[here], return_inverse=True)
        self.columns, j = np.unique(j[there], return_inverse=True)
        kx, ky = np.searchsorted(self.inner, kx[here]), np.searchsorted(self.inner, ky[there])
        order = np.lexsort((kx, i))
        self.i, self.kx, self.va = i[order], kx[order], va[here][order]
        order = np.lexsort((j, ky))
        self.ky, self.j, self.vb = ky[order], j[order], vb[there][order]
        self.low = np.searchsorted(self.ky, self.kx)
        self.many = np.searchsorted(self.ky, self.kx, side="right") - self.low
        self.first = np.searchsorted(self.i, np.arange(len(self.rows) + 1))  # entry of x where each row begins
        self.before = np.append(0, np.cumsum(self.many))  # pairs before each entry of x

    def until(self, row: int, pairs: int, cells: int) -> int:
        """The row after those from ``row`` on with at most so many pairs, or, if these are more, so many cells; one at least."""
        last = int(np.searchsorted(self.before[self.first], self.before[self.first[row]] + pairs, side="right")) - 1
        return min(len(self.rows), max(row + 1, last, row + cells // max(1, len(self.columns))))

    def pairs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of entries first .. last of x: places in x and in y."""
        n = self.many[first:last]
        at = np.arange(int(n.sum())) + np.repeat(self.low[first:last] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(first, last), n), at


def _exact(t: _Tile) -> bool:
    """Whether all sums are whole numbers that a double holds, in any order."""
    most = 1.0
    for v in (t.va, t.vb):
        if not (np.isfinite(v).all() and (v == np.rint(v)).all()):
            return False
        most *= float(np.abs(v).max(initial=0)) * max(1, len(v))
    return most < 1 << 53


def _products(t: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and sums, a few rows at a time; neither more than CHUNK pairs nor many more cells are held at once."""
    width, depth = len(t.columns), len(t.inner)
    total = int(t.before[-1])
    whole = len(t.rows) * width * depth <= 64 * total and width * depth <= 2 * CHUNK and _exact(t)
    y = np.bincount(t.ky * width + t.j, t.vb, depth * width).reshape(depth, width) if whole else None
    full = len(t.rows) * width <= 64 * total
    row = 0
    while row < len(t.rows):
        last = t.until(row, 0 if full else CHUNK, min(CHUNK, CHUNK * width // depth) if full else 0)
        p, q = int(t.first[row]), int(t.first[last])
        n = last - row
        if y is not None:
            sums = (np.bincount((t.i[p:q] - row) * depth + t.kx[p:q], t.va[p:q], n * depth).reshape(n, depth) @ y).reshape(-1)
            cells = np.flatnonzero(sums)
            sums = sums[cells]
        elif full or n == 1:
            sums = np.zeros(n * width)
            while p < q:
                end = min(q, max(p + 1, int(np.searchsorted(t.before, t.before[p] + CHUNK, side="right")) - 1))
                x, at = t.pairs(p, end)
                sums += np.bincount((t.i[x] - row) * width + t.j[at], t.va[x] * t.vb[at], len(sums))
                p = end
            cells = np.flatnonzero(sums)
            sums = sums[cells]
        else:
            x, at = t.pairs(p, q)
            cells, number = np.unique((t.i[x] - row) * width + t.j[at], return_inverse=True)
            sums = np.bincount(number, t.va[x] * t.vb[at], len(cells))
            cells, sums = cells[sums != 0], sums[sums != 0]
        yield t.rows[row + cells // width], t.columns[cells % width], sums
        row = last


def tile_product(i: np.ndarray, kx: np.ndarray, va: np.ndarray, ky: np.ndarray, j: np.ndarray, vb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and sums of a product of triples."""
    every = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *_products(_Tile(i, kx, va, ky, j, vb))]
    return tuple(np.concatenate(c) for c in zip(*every, strict=True))


def _blocks(n: int):
    """Entries (row, inner index, value) of n blocks of rows, as packed bytes: those of small numbers take a few bytes each."""

    def block(rows: np.ndarray) -> np.ndarray:
        return ((rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows, k, v = (np.concatenate(c) for c in zip(*held, strict=True))
        at = block(rows)
        order = np.lexsort((k, rows, at))
        at, rows, k, v = at[order], rows[order], k[order], v[order].astype("<f8").view("<u8").byteswap().view(np.int64)
        starts = np.flatnonzero(np.append(True, np.diff(at) != 0))
        ends = np.append(starts[1:], len(at))
        payloads = [tiles.pack(rows[s:e], k[s:e], v[s:e]) for s, e in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_pydict({"block": pa.array(at[starts].astype(np.int32)), "payload": pa.array(payloads, pa.binary())})

    def work(batches):
        held, many = [], 0
        for x in batches:
            if x.num_rows:
                held.append(tuple(x.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
                many += x.num_rows
            if many >= PACKED:
                yield packed(held)
                held, many = [], 0
        if held:
            yield packed(held)

    return work


def _entries(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every = [tiles.unpack(x) for x in payloads]
    rows, k, v = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*every, strict=True)) if every else (np.zeros(0, np.int64),) * 3
    return rows, k, v.view("<u8").byteswap().view("<f8")


def _in_tiles(x: DataFrame, y: DataFrame, rows: int, columns: int, work, schema: str) -> DataFrame:
    """``work`` (from a tile to record batches) over a grid of row blocks times column blocks.

    Only packed blocks are moved, and what a tile gives leaves it batch by batch.
    """
    x = x.select(F.col("i").cast("long"), F.col("k").cast("long"), F.col("va").cast("double")).mapInArrow(_blocks(rows), "block int, payload binary")
    y = y.select(F.col("j").cast("long"), F.col("k").cast("long"), F.col("vb").cast("double")).mapInArrow(_blocks(columns), "block int, payload binary")
    x = x.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.col("block") * columns + c)).alias("tile"), "payload")
    y = y.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + F.col("block"))).alias("tile"), "payload")

    def gather(key, left, right):
        kind = pa.list_(pa.binary())
        return pa.table({"x": pa.array([left["payload"].to_pylist()], kind), "y": pa.array([right["payload"].to_pylist()], kind)})

    def expand(batches):
        for batch in batches:
            for left, right in zip(batch.column("x"), batch.column("y"), strict=True):
                i, kx, va = _entries(left.as_py())
                j, ky, vb = _entries(right.as_py())
                yield from work(_Tile(i, kx, va, ky, j, vb))

    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows * columns, 10_000))
    both = x.repartition(tasks, "tile").groupBy("tile").cogroup(y.repartition(tasks, "tile").groupBy("tile"))
    return both.applyInArrow(gather, "x array<binary>, y array<binary>").mapInArrow(expand, schema)


def tiled_product(x: DataFrame, y: DataFrame, rows: int, columns: int) -> DataFrame:
    """(i, j, v) over a grid of row blocks times column blocks: each tile is summed where its pairs arise."""

    def work(t: _Tile):
        for i, j, v in _products(t):
            for s in range(0, len(v), BATCH):
                yield pa.RecordBatch.from_pydict({"i": i[s : s + BATCH], "j": j[s : s + BATCH], "v": v[s : s + BATCH]})

    return _in_tiles(x, y, rows, columns, work, "i long, j long, v double")


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product.

    Where pairs outnumber by far what tiles would move (counted), each tile of the product is computed in one
    place, and no pair leaves it.  Otherwise the sides are joined on the inner index, and sums are partial
    before the one exchange of (i, j).  The two agree but for the order of floating-point sums.
    """
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("va"))
    y = b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    counts = pair_counts(x, y)
    pairs, p, q, nulls = counts.agg(F.sum(F.col("p").cast("double") * F.col("q")), F.sum("p"), F.sum("q"), F.sum("nulls")).first()
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, math.isqrt(max(2 * tasks, math.ceil((pairs or 0) / TILE_PAIRS))))
    rows, columns = max(side, math.ceil((p or 0) / TILE_ENTRIES)), max(side, math.ceil((q or 0) / TILE_ENTRIES))
    if not nulls and (pairs or 0) > DENSE * ((p or 0) * columns + (q or 0) * rows):
        return tiled_product(x, y, rows, columns)
    return nonzero(dealt_pairs(x, y, counts).groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v")))


def _lists(t: _Tile, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns, ends of lists and the lists: the sorted inner indices of each cell with enough of them, a few rows at a time."""
    width, depth = len(t.columns), len(t.inner)
    once = not any(((np.diff(p) == 0) & (np.diff(q) == 0)).any() for p, q in ((t.i, t.kx), (t.ky, t.j)))
    full = once and len(t.rows) * width * depth <= 16 * int(t.before[-1]) and width * depth <= 16 * LIST_PAIRS
    if full:
        y = np.zeros((width, depth), bool)
        y[t.j, t.ky] = True
        few = y.T.astype(np.float32)
    row = 0
    while row < len(t.rows):
        last = t.until(row, LIST_PAIRS, 0)
        if full:
            last = min(last, row + max(1, 16 * LIST_PAIRS // (width * depth)))
        p, q = int(t.first[row]), int(t.first[last])
        if full:
            x = np.zeros((last - row, depth), bool)
            x[t.i[p:q] - row, t.kx[p:q]] = True
            size = (x.astype(np.float32) @ few).astype(np.int64)
            cells = x[:, None, :] & y
            enough = size >= max(1, least)
            if ((size > 0) & ~enough).any():
                cells &= enough[:, :, None]
            at = np.flatnonzero(enough)
            i, j, size, k = row + at // width, at % width, size.reshape(-1)[at], np.flatnonzero(cells) % depth
        else:
            x, at = t.pairs(p, q)
            i, j, k = t.i[x], t.j[at], t.ky[at]
            order = np.lexsort((k, j, i))
            i, j, k = i[order], j[order], k[order]
            starts = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(j) != 0)))
            size = np.diff(np.append(starts, len(k)))
            enough = size >= least
            i, j, k, size = i[starts[enough]], j[starts[enough]], k[np.repeat(enough, size)], size[enough]
        yield t.rows[i], t.columns[j], np.append(0, np.cumsum(size)), t.inner[k]
        row = last


def _words(t: np.ndarray, at: np.ndarray, rows: int, depth: int) -> np.ndarray:
    """One word of bits for every row and WORD inner indices."""
    bits = np.zeros((-(-depth // WORD), rows), np.int64)
    np.bitwise_or.at(bits, (at // WORD, t), np.int64(1) << (at % WORD))
    return bits


def _top(words: np.ndarray) -> np.ndarray:
    """The highest bit of each word, which is not 0."""
    return (words.astype(np.float64).view(np.int64) >> 52) - 1023


def _summed(t: _Tile, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, columns, and the number, first, last and sum of what ``_lists`` would give, without a list where tiles are dense."""
    width, depth = len(t.columns), len(t.inner)
    once = not any(((np.diff(p) == 0) & (np.diff(q) == 0)).any() for p, q in ((t.i, t.kx), (t.ky, t.j)))
    most = float(np.abs(t.inner.astype(float)).sum())
    if not (once and len(t.rows) * width * depth <= 64 * int(t.before[-1]) and width * depth <= 2 * CHUNK and most < 1 << 53):
        for i, j, ends, ks in _lists(t, max(1, least)):
            if len(i):
                yield i, j, np.diff(ends), ks[ends[:-1]], ks[ends[1:] - 1], np.add.reduceat(ks, ends[:-1])
        return
    few = np.zeros((depth, width), np.float32)
    few[t.ky, t.j] = 1
    kind = np.float32 if most < 1 << 24 else np.float64
    weighed = few * t.inner[:, None].astype(kind)
    y = _words(t.j, t.ky, width, depth)
    row, step = 0, max(1, SPAN_CELLS // width)
    while row < len(t.rows):
        last = min(len(t.rows), row + step)
        p, q = int(t.first[row]), int(t.first[last])
        x = np.zeros((last - row, depth), np.float32)
        x[t.i[p:q] - row, t.kx[p:q]] = 1
        n = (x @ few).reshape(-1)
        at = np.flatnonzero(n >= max(1, least))
        i, j = at // width, at % width
        both = _words(t.i[p:q] - row, t.kx[p:q], last - row, depth)
        low, high = np.full(len(at), -1), np.full(len(at), -1)
        for found, order in ((low, range(len(y))), (high, range(len(y) - 1, -1, -1))):
            left = None  # cells that no word has shown yet
            for w in order:
                bits = (both[w][:, None] & y[w]).reshape(-1)[at] if left is None else both[w][i[left]] & y[w][j[left]]
                if found is low:
                    bits &= -bits
                some = bits != 0
                if left is None and some.all():
                    found[:] = _top(bits) + w * WORD
                    break
                where = np.flatnonzero(some) if left is None else left[some]
                found[where] = _top(bits[some]) + w * WORD
                left = np.flatnonzero(~some) if left is None else left[~some]
                if not len(left):
                    break
        total = (x.astype(kind, copy=False) @ weighed).reshape(-1)[at]
        yield t.rows[row + i], t.columns[j], n[at].astype(np.int64), t.inner[low], t.inner[high], total.astype(np.int64)
        row = last


def _collected(a: DataFrame, b: DataFrame, work, schema: str) -> tuple[DataFrame | None, DataFrame, DataFrame, DataFrame]:
    """``work`` on tiles, if pairs outnumber what these would move; else the sides and their counts."""
    x = a.where("v <> 0").select("i", F.col("j").alias("k"))
    y = b.where("v <> 0").select(F.col("i").alias("k"), "j")
    counts = pair_counts(x, y)
    pairs, p, q, nulls = counts.agg(F.sum(F.col("p").cast("double") * F.col("q")), F.sum("p"), F.sum("q"), F.sum("nulls")).first()
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = math.isqrt(max(4 * tasks, math.ceil((pairs or 0) / TILE_PAIRS)))
    side = max(1, min(wanted, LIST_SIDE), math.ceil(max(p or 0, q or 0) / TILE_ENTRIES))
    if nulls or (pairs or 0) <= DENSE * ((p or 0) + (q or 0)) * side:
        return None, x, y, counts
    # no value is moved: a zero takes no byte
    return _in_tiles(x.withColumn("va", F.lit(0.0)), y.withColumn("vb", F.lit(0.0)), side, side, work, schema), x, y, counts


def spgemm_collect(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """Product over lists: each cell has the inner indices that contribute; cells with fewer than ``least`` go.

    As in ``spgemm``, where pairs outnumber what tiles would move, each tile's lists are made in one place.
    """

    def work(t: _Tile):
        for i, j, ends, ks in _lists(t, least):
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "ks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ks)})

    tiled, x, y, counts = _collected(a, b, work, "i long, j long, ks array<long>")
    if tiled is not None:
        return tiled
    cells = dealt_pairs(x, y, counts).groupBy("i", "j").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    return cells.where(F.size("ks") >= least)


def spgemm_collect_sums(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """(i, j, n, low, high, total): the length, ends and sum of each list of ``spgemm_collect``, without the lists where tiles serve."""

    def work(t: _Tile):
        for columns in _summed(t, least):
            for s in range(0, len(columns[0]), BATCH):
                yield pa.RecordBatch.from_pydict({c: x[s : s + BATCH] for c, x in zip(("i", "j", "n", "low", "high", "total"), columns, strict=True)})

    tiled, x, y, counts = _collected(a, b, work, "i long, j long, n long, low long, high long, total long")
    if tiled is not None:
        return tiled
    sums = [F.count("*").alias("n"), F.min("k").cast("long").alias("low"), F.max("k").cast("long").alias("high"), F.sum("k").cast("long").alias("total")]
    return dealt_pairs(x, y, counts).groupBy("i", "j").agg(*sums).where(F.col("n") >= least)


def spmv(m: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of the product with a vector (j, x)."""
    return nonzero(m.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")))


def row_nnz(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.count("*").alias("nnz"))


def col_nnz(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.count("*").alias("nnz"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("total"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("total"))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def nnz(m: DataFrame) -> DataFrame:
    return nonzero(m).agg(F.count("*").alias("nnz"))


def shape(m: DataFrame) -> DataFrame:
    """One row: the largest row and column, and the number of nonzeros."""
    return nonzero(m).agg(F.coalesce(F.max("i"), F.lit(0)).alias("rows"), F.coalesce(F.max("j"), F.lit(0)).alias("cols"), F.count("*").alias("nnz"))


def element(m: DataFrame, i: int, j: int) -> float:
    """A single value; zero where there is no entry."""
    return float(m.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0])


def render(m: DataFrame, rows: int, cols: int) -> str:
    """The corner of at most rows x cols cells, from 1, as text: what fits a screen, hence the bound."""
    corner = {(r["i"], r["j"]): r["v"] for r in m.where((F.col("i") >= 1) & (F.col("i") <= rows) & (F.col("j") >= 1) & (F.col("j") <= cols)).collect()}
    cells = [[f"{corner.get((i, j), 0):g}" for j in range(1, cols + 1)] for i in range(1, rows + 1)]
    width = max((len(c) for row in cells for c in row), default=0)
    return "\n".join(" ".join(c.rjust(width) for c in row) for row in cells)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise product."""
    y = b.select("i", "j", F.col("v").alias("w"))
    return nonzero(a.join(y, ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return from_triples(a.select("i", "j", "v").unionByName(b.select("i", "j", "v")))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b; it is empty exactly if both are equal."""
    return add(a, b.select("i", "j", (-F.col("v")).alias("v")))


def where_equal(m: DataFrame, value: float) -> DataFrame:
    return m.where(F.col("v") == value)


def without_diagonal(m: DataFrame) -> DataFrame:
    return m.where("i <> j")


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j")


def lower(m: DataFrame, strict: bool = True) -> DataFrame:
    return m.where("i > j" if strict else "i >= j")


def upper(m: DataFrame, strict: bool = True) -> DataFrame:
    return m.where("i < j" if strict else "i <= j")


def binarize(m: DataFrame) -> DataFrame:
    return nonzero(m).select("i", "j", F.lit(1.0).alias("v"))


def keep_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Zero all rows but those listed in ``rows`` (i)."""
    return m.join(rows.select("i"), "i", "left_semi")


def drop_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("i"), "i", "left_anti")


def nonempty_rows(m: DataFrame) -> DataFrame:
    return nonzero(m).select("i").distinct()


def clamp(m: DataFrame, low: float, high: float) -> DataFrame:
    return nonzero(m.select("i", "j", F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)).alias("v")))


def assign(m: DataFrame, i: int, j: int, v: float) -> DataFrame:
    """Overwrite one element; zero removes it."""
    rest = m.where(~((F.col("i") == i) & (F.col("j") == j))).select("i", "j", "v")
    if not v:
        return rest
    one = m.sparkSession.range(1).select(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(float(v)).alias("v"))
    return rest.unionByName(one)


def out_degree_histogram(m: DataFrame) -> DataFrame:
    """(degree, n): how many rows have so many nonzeros."""
    return row_nnz(nonzero(m)).groupBy(F.col("nnz").alias("degree")).agg(F.count("*").alias("n"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int, block_rows: int = 1 << 16) -> DataFrame:
    """Kronecker product of 1-based matrices.

    A right side of at most ``block_rows`` entries (counted) is broadcast.  A larger one is dealt into
    blocks of that size, and A into parts where blocks are few: each pair of a part and a block meets by an
    equi-join, so the output is spread over all tasks and no side is ever held whole.
    """
    n = max(1, -(-b.count() // block_rows))
    out = [((F.col("ia") - 1) * rows_b + F.col("ib")).alias("i"), ((F.col("ja") - 1) * cols_b + F.col("jb")).alias("j"), (F.col("va") * F.col("vb")).alias("v")]
    x = a.select(F.col("i").alias("ia"), F.col("j").alias("ja"), F.col("v").alias("va"))
    y = b.select(F.col("i").alias("ib"), F.col("j").alias("jb"), F.col("v").alias("vb"))
    if n == 1:
        return x.withColumn("blk", F.lit(0)).join(F.broadcast(y.withColumn("blk", F.lit(0))), "blk").select(*out)
    parts = -(-int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    y = y.withColumn("blk", F.pmod(F.xxhash64("ib", "jb"), F.lit(n)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    x = x.withColumn("part", F.pmod(F.xxhash64("ia", "ja"), F.lit(parts)).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.join(y, ["blk", "part"]).select(*out)
