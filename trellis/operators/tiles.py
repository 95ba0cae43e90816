"""Triangles of a graph dealt as tiles: three ranges of vertices and the edges between them, so that no wedge is ever moved.

Vertices are cut into ranges of about equal degree.  The edges between two ranges are a cell, held as packed bytes (two
to four an edge).  A triangle lies in just one tile, the ranges of its vertices, and a tile gets the cells between its
ranges if none of them is empty.  So graphs whose edges keep to near numbers are moved about three times, and any other
graph about sqrt(6 * edges / TILE) times, in bytes instead of rows.  Ranges begin where no edge crosses wherever that is
enough: such a part of the graph is a tile of its own, and a truss of it is found in one search.
"""

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import materialize, release

#: Edges of a tile: no less than the first is worth a task, and more than the second are avoided by narrower ranges.
LEAST, TILE = 1 << 19, 3 << 19
#: Edges of a range, and ranges at most.
RANGE, RANGES = 1 << 19, 512
#: Edges packed at once, candidates checked at once, and entries of the lookup table.
PACKED, CHUNK, TABLE = 1 << 21, 1 << 20, 1 << 23
BATCH = 1 << 16
#: Vertices of a tile at most whose triangles are counted by a dense product, and multiplications that take as long as a candidate.
SQUARE, MULTIPLIED = 1 << 12, 100
#: Of the ends of so many edges, every SKIP-th one serves to find ranges.
MANY, SKIP = 1 << 20, 16
#: Parts of a graph without edges between them that are told apart.
SPANS = 1 << 11
#: Triangles of a tile that are held at most, to follow what falls in it; the mark of an edge that went.
HELD, GONE = 1 << 23, 1 << 40
CELLS = "kind int, cell int, n long, hit long, payload binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("hit", pa.int64()), ("payload", pa.binary())])
EDGE, VERTEX, SPAN = 0, 1, 2


class Packed(NamedTuple):
    """A graph in cells; the payload of a cell holds edges, each with a number."""

    cells: DataFrame
    bounds: np.ndarray  # where each range but the first begins
    distinct: bool  # no edge is in two payloads, or twice in one
    hits: int = 0


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, the low ones first, without those that are zero throughout."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    x = np.zeros((n, 8), np.uint8)
    x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
    return x.reshape(-1).view("<u8"), at + 1 + n * width


def pack(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> bytes:
    """Edges in the order of (a, b) with numbers w; differences are modulo 2**64, so every long fits."""
    low = b.min()
    step = np.diff(a, prepend=a[:1]).view(np.uint64)
    return struct.pack("<qqq", len(a), a[0], low) + _planes(step) + _planes((b - low).view(np.uint64)) + _planes(w.astype(np.int64).view(np.uint64))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, low = struct.unpack_from("<qqq", raw)
    step, at = _numbers(raw, 24, n)
    b, at = _numbers(raw, at, n)
    w, _ = _numbers(raw, at, n)
    return np.cumsum(step).view(np.int64) + np.int64(first), b.view(np.int64) + np.int64(low), w.view(np.int64)


def _unpack_all(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    every = [unpack(x) for x in payloads]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(e[k] for e in every)]) for k in range(3))


def _cells(bounds: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, kind: int = EDGE) -> pa.RecordBatch:
    """One row per cell that the edges touch; ``hit`` counts numbers that are not 0."""
    cell = np.searchsorted(bounds, a, "right") * (len(bounds) + 1) + np.searchsorted(bounds, b, "right")
    order = np.lexsort((b, a, cell))
    cell, a, b, w = cell[order], a[order], b[order], w[order]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    ends = np.append(starts[1:], len(cell))
    rows = [(kind, int(cell[s]), int(e - s), int(np.count_nonzero(w[s:e])), pack(a[s:e], b[s:e], w[s:e])) for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_SCHEMA)], schema=_SCHEMA)


def _once(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in order, each once, with the least of its numbers."""
    order = np.lexsort((w, b, a)) if w.any() else np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    new = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if len(a) else order
    return a[new], b[new], w[new]


def _parts(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of numbers, each with a count, as few that no two share a number; beyond SPANS of them the closest are joined."""
    order = np.argsort(low, kind="stable")
    low, high, n = low[order], np.maximum.accumulate(high[order]), n[order]
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    if len(first) > SPANS:
        gap = low[first[1:]].astype(float) - high[first[1:] - 1]
        first = np.append(0, np.sort(first[1:][np.argpartition(-gap, SPANS - 2)[: SPANS - 1]]))
    return low[first], high[np.append(first[1:], len(low)) - 1], np.add.reduceat(n, first)


def _span_row(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((SPAN, 0, 0, 0, pack(*_parts(low, high, n))), _SCHEMA, strict=True)], schema=_SCHEMA)


def _packer(bounds: np.ndarray, kind: int, once: bool = False, spans: bool = False):
    def packed_rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, w = (np.concatenate(c) for c in zip(*held, strict=True))
        return _cells(bounds, *(_once(a, b, w) if once else (a, b, w)), kind)

    def given(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        batch = packed_rows(held)
        yield batch
        if spans:
            for raw in batch.column("payload").to_pylist():
                a, b, _ = unpack(raw)
                yield _span_row(a, b, np.ones_like(a))

    def work(batches):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for x in batches:
            held.append(tuple(x.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            n += x.num_rows
            if n >= PACKED:
                yield from given(held)
                held, n = [], 0
        if n:
            yield from given(held)

    return work


def _spread(every: int):
    """Some ends of the edges of each payload, in even steps."""

    def work(batches):
        for x in batches:
            for raw in x.column("payload").to_pylist():
                a, b, _ = unpack(raw)
                yield pa.RecordBatch.from_pydict({"v": pa.array(np.sort(np.concatenate([a, b]))[every // 2 :: every], pa.int64())})

    return work


def _joined(batches):
    """The spans of all payloads as one."""
    held = None
    for x in batches:
        for raw in x.column("payload").to_pylist():
            low, high, n = unpack(raw)
            held = _parts(*(np.concatenate(c) for c in zip(held, (low, high, n), strict=True))) if held else (low, high, n)
    if held:
        yield _span_row(*held)


def _natural(raw: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where ranges may begin so that no edge crosses, and the spans to cut: too large for a tile, or so few that tasks would idle."""
    found = raw.where(F.col("kind") == SPAN).select("payload").repartition(1).mapInArrow(_joined, CELLS).collect()  # one row of at most SPANS spans
    if not found:
        return np.zeros(0, np.int64), []
    low, high, n = unpack(bytes(found[0]["payload"]))
    most = max(RANGE, int(n.sum()) * 2 // RANGES)
    whole = TILE if int((n > LEAST).sum()) >= raw.sparkSession.sparkContext.defaultParallelism else LEAST
    begins, large, held = [], [], 0
    for x, y, m in zip(low.tolist(), high.tolist(), n.tolist(), strict=True):
        if held and held + m > most:
            begins.append(x)
            held = 0
        held += m
        if m > whole:
            large.append((x, y))
    return np.array(begins, np.int64), large


def _quantiles(vertices: DataFrame, weight: int) -> np.ndarray:
    cuts = [k / RANGES for k in range(1, RANGES)]
    n, at = vertices.agg(F.count("*"), F.percentile_approx(F.col(vertices.columns[0]).cast("long"), cuts, 4 * RANGES)).first()
    ranges = 8
    while ranges < RANGES and ranges * RANGE < n * weight:
        ranges *= 2
    return np.unique(np.array((at or [])[RANGES // ranges - 1 :: RANGES // ranges], np.int64))


def packed(und: DataFrame, vertices: DataFrame | None = None, number: Column | None = None, distinct: bool = False) -> Packed:
    """The edges (a, b), a < b, as cells; repeated ones are allowed unless ``distinct``, and the least of their numbers holds.

    The ranges come from the quantiles of ``vertices`` (one column); without, they begin where no edge crosses, and parts too
    large for a tile are cut at quantiles of the ends of edges.  They decide where the work is done, not what is found.
    ``und`` is computed once: without ``vertices``, it is packed as it comes first.
    """
    rows = und.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.lit(0) if number is None else number).cast("long").alias("w"))
    if vertices is not None:
        bounds = _quantiles(vertices, 1)
        return Packed(materialize(rows.mapInArrow(_packer(bounds, EDGE, not distinct), CELLS), "cells"), bounds, distinct)
    written = materialize(stored(rows, distinct), "packed")
    g = dealt(written, distinct)
    release(written)
    return g


def stored(und: DataFrame, distinct: bool = False) -> DataFrame:
    """Edges (a, b, w) packed as they come, for ``dealt``."""
    return und.mapInArrow(_packer(np.zeros(0, np.int64), EDGE, not distinct, spans=True), CELLS)


def dealt(written: DataFrame, distinct: bool = False) -> Packed:
    """A graph in cells from edges ``stored``; a column ``number`` is the number of all edges of its row."""
    bounds, large = _natural(written)
    raw = written.where(F.col("kind") == EDGE)
    if large:
        every = 1 if (raw.agg(F.sum("n")).first()[0] or 0) < MANY else SKIP
        at = _quantiles(raw.mapInArrow(_spread(every), "v long"), every)
        inside = np.zeros(len(at), bool)
        for x, y in large:
            inside |= (at > x) & (at <= y)
        bounds = np.union1d(bounds, at[inside])
    numbers = "number" in written.columns

    def deal(batches):
        for x in batches:
            given = x.column("number").to_pylist() if numbers else [None] * x.num_rows
            for payload, number in zip(x.column("payload").to_pylist(), given, strict=True):
                a, b, w = unpack(payload)
                yield _cells(bounds, a, b, w if number is None else np.full_like(w, number))

    return Packed(materialize(raw.mapInArrow(deal, CELLS), "cells"), bounds, distinct)


class _Plan(NamedTuple):
    routes: DataFrame  # kind, x, y, tile: where the cell between two coarse ranges goes
    width: int  # ranges to a coarse one
    coarse: int
    tiles: int
    alone: np.ndarray  # cells between coarse ranges that go to one tile only


def _triples(filled: np.ndarray) -> list[tuple[int, int, int]]:
    """Coarse ranges i <= j <= k with no empty cell that a triangle needs."""
    found = []
    for i, j in zip(*np.nonzero(np.triu(filled)), strict=True):
        both = filled[i] & filled[j]
        both[:j] = False
        if i == j:
            both &= filled[i, i]
        found += [(int(i), int(j), int(k)) for k in np.flatnonzero(both) if not (i < j == k and not filled[j, j])]
    return found


def _needs(i: int, j: int, k: int) -> set[tuple[int, int]]:
    return {(i, i)} if i == k else {(i, j), (i, k), (j, k)} - ({(k, k)} if i == j else set())


def _plan(g: Packed, marked: bool = False) -> _Plan:
    """The widest coarse ranges whose tiles have few enough edges, by the counted sizes of all cells.

    ``marked``: only tiles with an edge whose number is not 0.
    """
    spark, ranges = g.cells.sparkSession, len(g.bounds) + 1
    sizes = np.zeros((ranges, ranges), np.int64)
    hits = np.zeros_like(sizes)
    for cell, n, hit in g.cells.where(F.col("kind") == EDGE).groupBy("cell").agg(F.sum("n"), F.sum("hit")).collect():
        sizes[cell // ranges, cell % ranges], hits[cell // ranges, cell % ranges] = n, hit
    most = min(TILE, max(LEAST, int(sizes.sum()) // (4 * spark.sparkContext.defaultParallelism)))
    width = ranges
    while True:
        coarse = -(-ranges // width)
        edges = np.arange(0, ranges, width)
        cell = np.add.reduceat(np.add.reduceat(sizes, edges, 0), edges, 1)
        filled = (cell + cell.T) > 0
        triples = _triples(filled)
        if marked:
            hit = np.add.reduceat(np.add.reduceat(hits, edges, 0), edges, 1)
            triples = [t for t in triples if any(hit[p] for p in _needs(*t))]
        largest = max((sum(int(cell[p]) for p in _needs(*t)) for t in triples), default=0)
        if largest <= most or width == 1:
            break
        width = -(-width // 2)
    rows, goes = [], np.zeros((coarse, coarse), np.int64)
    for i, j, k in triples:
        tile = (i * coarse + j) * coarse + k
        for p in _needs(i, j, k):
            goes[p] += 1
        rows += [(EDGE, x, y, tile) for x, y in _needs(i, j, k)] + [(VERTEX, x, x, tile) for x in {i, j, k}]
    routes = spark.createDataFrame(rows or [(EDGE, -1, -1, 0)], "kind int, x int, y int, tile long")
    return _Plan(routes, width, coarse, len(triples), goes == 1)


def _matches(p: np.ndarray, q: np.ndarray, e: np.ndarray, src: np.ndarray, dst: np.ndarray, spoke: np.ndarray, n: int):
    """Triangles of base edges (p, q) and spokes src -> dst that share their end: chunks of edges e, of either spoke, and of the end.

    The shorter list of a base edge is looked up in the longer one, so hubs cost no more than their neighbours; the
    longer lists stand in a table of rows, of which only what was set is cleared.
    """
    order = np.argsort(src, kind="stable")
    src, dst, spoke = src[order], dst[order], spoke[order]
    ptr = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=ptr[1:])
    degree = np.diff(ptr)
    used = np.zeros(n, bool)
    used[dst] = True
    column = (np.cumsum(used) - 1).astype(np.int32)
    col, width = column[dst], int(used.sum())
    less = degree[p] <= degree[q]
    small, other = np.where(less, p, q), np.where(less, q, p)
    some = np.flatnonzero(degree[small])
    if not len(some):
        return
    some = some[np.argsort(other[some], kind="stable")]
    small, other, e = small[some], other[some], e[some]
    many = degree[small]
    ends = np.cumsum(many)
    high = max(1, TABLE // width)
    table = np.zeros(high * width, np.int32)
    first = 0
    while first < len(e):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right"))
        o = int(other[first])
        last = max(first + 1, min(last, int(np.searchsorted(other, o + high))))
        lo, hi = ptr[o], ptr[int(other[last - 1]) + 1]
        set_ = (src[lo:hi] - o) * width + col[lo:hi]
        table[set_] = np.arange(lo + 1, hi + 1, dtype=np.int64)
        m = many[first:last]
        at = np.arange(int(m.sum())) + np.repeat(ptr[small[first:last]] - (np.cumsum(m) - m), m)
        there = table[np.repeat((other[first:last] - o) * width, m) + col[at]]
        hit = np.flatnonzero(there)
        if len(hit):
            base = first + np.searchsorted(np.cumsum(m), hit, "right")
            x, y = at[hit], there[hit].astype(np.int64) - 1
            yield e[base], spoke[x], spoke[y], dst[x]
        table[set_] = 0
        first = last


class _Tile(NamedTuple):
    a: np.ndarray  # local numbers of the ends of edges
    b: np.ndarray
    w: np.ndarray
    vertex: np.ndarray  # number -> id
    bound: np.ndarray | None  # number of each vertex
    block: np.ndarray  # coarse range of each vertex
    sides: tuple[np.ndarray, ...]  # base edges and spokes: ends, ends and number of edge of each
    found: Iterator[tuple[np.ndarray, ...]]

    def count(self, only: np.ndarray | None = None) -> int:
        """The number of triangles, all or those whose edges all are among ``only``."""
        p, q, e, src, dst, spoke = self.sides
        if only is not None:
            base, way = only[e], only[spoke]
            p, q, e, src, dst, spoke = p[base], q[base], e[base], src[way], dst[way], spoke[way]
        n = _dense(p, q, src, dst, len(self.vertex))
        return sum(len(x[0]) for x in _matches(p, q, e, src, dst, spoke, len(self.vertex))) if n is None else n


def _dense(p: np.ndarray, q: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> int | None:
    """The number of base edges (p, q) times common ends of spokes, if a dense product finds it sooner than ``_matches``."""
    degree = np.bincount(src, minlength=n)
    candidates = int(np.minimum(degree[p], degree[q]).sum())
    ends, dst = np.unique(dst, return_inverse=True)
    first, p = np.unique(p, return_inverse=True)
    if n > SQUARE or len(first) * len(ends) * n > MULTIPLIED * candidates:
        return None
    near = np.zeros((n, len(ends)), np.float32)  # sums of at most SQUARE ones are exact
    near[src, dst] = 1
    total, step = 0, max(1, CHUNK // max(1, n))
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    for s in range(0, len(first), step):
        lo, hi = np.searchsorted(p, [s, s + step])
        total += int((near[first[s : s + step]] @ near.T)[p[lo:hi] - s, q[lo:hi]].sum(dtype=np.float64))
    return total


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices in order, and their places in it; a table serves where ids lie close together."""
    if not len(a):
        return a, a, b
    low, span = int(a.min()), int(b.max()) - int(a.min()) + 1  # a < b
    if span > 8 * len(a):
        vertex, local = np.unique(np.concatenate([a, b]), return_inverse=True)
        return vertex, local[: len(a)].astype(np.int32), local[len(a) :].astype(np.int32)
    a, b = a - low, b - low
    used = np.zeros(span, bool)
    used[a] = used[b] = True
    place = (np.cumsum(used) - 1).astype(np.int32)
    return np.flatnonzero(used) + low, place[a], place[b]


def _open(tile: int, g_bounds: np.ndarray, distinct: bool, width: int, coarse: int, kinds: list[int], payloads: list[bytes]) -> _Tile:
    a, b, w = _unpack_all([x for x, k in zip(payloads, kinds, strict=True) if k == EDGE])
    vertex, a, b = _numbered(a, b)
    if not distinct:
        a, b, w = _once(a, b, w)
    bound = None
    if VERTEX in kinds:
        v, _, x = _unpack_all([x for x, k in zip(payloads, kinds, strict=True) if k == VERTEX])
        bound = np.zeros(len(vertex), np.int64)
        at = np.searchsorted(vertex, v)
        known = np.flatnonzero((at < len(vertex)) & (vertex[np.minimum(at, len(vertex) - 1)] == v)) if len(vertex) else []
        bound[at[known]] = x[known]
    i, j, k = tile // (coarse * coarse), tile // coarse % coarse, tile % coarse
    block = np.searchsorted(g_bounds, vertex, "right") // width
    every = np.arange(len(a), dtype=np.int32)
    if i == k:
        degree = np.bincount(a, minlength=len(vertex)) + np.bincount(b, minlength=len(vertex))
        up = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
        src, dst = np.where(up, a, b), np.where(up, b, a)
        sides = (src, dst, every, src, dst, every)
    else:
        base = np.flatnonzero((block[a] == i) & (block[b] == j)) if j < k else np.flatnonzero(block[a] == j)
        spoke = np.flatnonzero(block[b] == k) if j < k else np.flatnonzero(block[a] == i)
        src, dst = (a[spoke], b[spoke]) if j < k else (b[spoke], a[spoke])
        sides = (a[base], b[base], base, src, dst, spoke)
    return _Tile(a, b, w, vertex, bound, block, sides, _matches(*sides, len(vertex)))


def _per_tile(g: Packed, work, schema: str, *more: DataFrame, plan: _Plan | None = None) -> DataFrame:
    """``work`` (from an open tile to record batches) on every tile."""
    plan = plan or _plan(g)
    ranges, bounds, distinct, width, coarse = len(g.bounds) + 1, g.bounds, g.distinct, plan.width, plan.coarse
    rows = g.cells
    for x in more:
        rows = rows.unionByName(x)
    x, y = (F.floor(F.floor(F.col("cell") / ranges) / width).cast("int"), F.floor(F.col("cell") % ranges / width).cast("int"))
    rows = rows.withColumn("x", x).withColumn("y", y).join(F.broadcast(plan.routes), ["kind", "x", "y"]).select("tile", "kind", "payload")
    parts = max(int(g.cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(plan.tiles, 1000))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, payloads = [], []
        for x in batches:
            kinds += x.column("kind").to_pylist()
            payloads += x.column("payload").to_pylist()
        yield from work(_open(key[0].as_py(), bounds, distinct, width, coarse, kinds, payloads))

    return rows.repartition(parts, "tile").groupBy("tile").applyInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def listed(g: Packed) -> DataFrame:
    """(v1, v2, v3), v1 < v2 < v3."""

    def work(t: _Tile):
        for e, _, _, r in t.found:
            low, high = np.minimum(t.a[e], t.b[e]), np.maximum(t.a[e], t.b[e])
            v1, v3 = np.minimum(low, r), np.maximum(high, r)
            yield _batch(v1=t.vertex[v1], v2=t.vertex[low + high + r - v1 - v3], v3=t.vertex[v3])

    return _per_tile(g, work, "v1 long, v2 long, v3 long")


def counted(g: Packed) -> DataFrame:
    """One row: the number of triangles."""

    def work(t: _Tile):
        yield _batch(n=[t.count()])

    return _per_tile(g, work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def closed(g: Packed) -> DataFrame:
    """One row: how many triangles have an edge whose number is not 0."""

    def work(t: _Tile):
        old = t.w == 0
        yield _batch(n=[t.count() - t.count(old) if old.any() else t.count()])

    return _per_tile(g, work, "n long", plan=_plan(g, marked=True)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def opposite(g: Packed) -> DataFrame:
    """One row: the sum over triangles and their edges of n, where an edge's number is 2 * n + m and m is 1 at both others."""

    def work(t: _Tile):
        total = 0
        for sides in t.found:
            p, q, r = (t.w[s] for s in sides[:3])
            total += int(((p >> 1) * (q & r & 1) + (q >> 1) * (p & r & 1) + (r >> 1) * (p & q & 1)).sum())
        yield _batch(n=[total])

    return _per_tile(g, work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def at_vertices(g: Packed) -> DataFrame:
    """(vertex, triangles) of vertices that have any."""

    def work(t: _Tile):
        n = np.zeros(len(t.vertex), np.int64)
        for e, _, _, r in t.found:
            for x in (t.a[e], t.b[e], r):
                n += np.bincount(x, minlength=len(n))
        some = np.flatnonzero(n)
        yield _batch(vertex=t.vertex[some], n=n[some])

    return _per_tile(g, work, "vertex long, n long").groupBy("vertex").agg(F.sum("n").alias("triangles"))


def histogram(g: Packed, greatest: bool = False, cap: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(k, n): how many triangles have the number k, the least (or greatest) of their edges' numbers, of the numbers of
    their vertices (vertex, most), and the cap.  Numbers are not negative."""
    more = []
    if vertices is not None:
        v = F.col("vertex").cast("long")
        more = [vertices.select(v.alias("a"), v.alias("b"), F.col("most").cast("long").alias("w")).mapInArrow(_packer(g.bounds, VERTEX), CELLS)]
    pick = np.maximum if greatest else np.minimum

    def work(t: _Tile):
        numbers: dict[int, int] = {}
        for e, x, y, r in t.found:
            k = pick(pick(t.w[e], t.w[x]), t.w[y])
            if t.bound is not None:
                for v in (t.a[e], t.b[e], r):
                    k = pick(k, t.bound[v])
            if cap is not None:
                k = np.minimum(k, cap)
            for value, n in zip(*np.unique(k, return_counts=True), strict=True):
                numbers[int(value)] = numbers.get(int(value), 0) + int(n)
        yield _batch(k=list(numbers), n=list(numbers.values()))

    return _per_tile(g, work, "k long, n long", *more).groupBy("k").agg(F.sum("n").alias("n"))


def _counts(t: _Tile) -> np.ndarray:
    n = np.zeros(len(t.a), np.int64)
    for found in t.found:
        for x in found[:3]:
            n += np.bincount(x, minlength=len(n))
    return n


def _fall(t: _Tile, least: int, judged: np.ndarray, known: bool) -> tuple[np.ndarray, np.ndarray]:
    """Triangles at each edge that this tile keeps, and those ``judged`` edges it knows to fall, by what falls in it.

    The edges are numbered by their supports, if ``known``; else all triangles of judged edges are in this tile.
    """
    held, many = [], 0
    n = np.zeros(len(t.a), np.int64)
    for found in t.found:
        many += len(found[0])
        for x in found[:3]:
            n += np.bincount(x, minlength=len(n))
        if many <= HELD:
            held.append(np.stack(found[:3]).astype(np.int32))
        else:  # too many to follow: the next count sees what falls
            held = []
    whole = n
    support = t.w if known else whole
    gone = judged & (support < least)
    if many > HELD or not held:
        return n, gone & False
    tri = np.concatenate(held, 1)
    del held
    while True:
        tri = tri[:, ~gone[tri].any(0)]
        n = sum(np.bincount(x, minlength=len(n)) for x in tri)
        more = judged & (support - (whole - n) < least)
        if (more == gone).all():
            return n, gone
        gone = more


def supported(g: Packed, least: int = 0, fall: bool = False, known: bool = False) -> Packed:
    """The edges in some triangle, numbered by their triangles; with ``least`` 0 those in none as well.

    ``hit`` counts edges in some triangles, yet in less than ``least``.  With ``fall``, edges whose triangles are all in one
    tile go if these are less, and each tile lets go what that takes along in it.  If the edges are ``known``, which is
    numbered by their supports, all edges of less go so: then the numbers are right if ``hit`` is 0, else too high, as
    triangles of edges that went were counted in other tiles.
    """
    bounds, plan = g.bounds, _plan(g)
    alone = plan.alone

    def work(t: _Tile):
        if fall:
            own = alone[t.block[t.a], t.block[t.b]]
            n, gone = _fall(t, least, own | known, known)
            n = n + (gone & ~own) * GONE  # no other tile has its own edges: they need no mark
        else:
            n = _counts(t)
        some = np.flatnonzero(n)
        if len(some):
            yield _cells(bounds, t.vertex[t.a[some]], t.vertex[t.b[some]], n[some])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = _unpack_all([x for y in batches for x in y.column("payload").to_pylist()])
        order = np.lexsort((b, a)).astype(np.int32)
        a, b, w = a[order], b[order], w[order]
        del order
        new = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
        a, b, w = a[new], b[new], np.add.reduceat(w, new)
        gone, w = w >= GONE, w % GONE
        hit = int(((w > 0) & (gone | (w < least))).sum())
        stay = ~gone & (w >= least) if known else w >= min(least, 1)
        row = (EDGE, key[0].as_py(), int(stay.sum()), hit, pack(a[stay], b[stay], w[stay]) if stay.any() else None)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    rows = _per_tile(g, work, CELLS, plan=plan)
    if not least:
        rows = rows.unionByName(numbered_zero(g.cells))
    tasks = int(g.cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.repartition(tasks, "cell").groupBy("cell").applyInArrow(add, CELLS)
    found = materialize(cells, "support")
    return Packed(found.where("n > 0"), bounds, True)._replace(hits=found.agg(F.sum("hit")).first()[0] or 0)


def numbered_zero(cells: DataFrame) -> DataFrame:
    def work(batches):
        for x in batches:
            zero = []
            for raw in x.column("payload").to_pylist():
                a, b, w = unpack(raw)
                zero.append(pack(a, b, np.zeros_like(w)))
            yield pa.RecordBatch.from_arrays([*(x.column(k) for k in range(4)), pa.array(zero, pa.binary())], schema=_SCHEMA)

    return cells.mapInArrow(work, CELLS)


def edges(g: Packed) -> DataFrame:
    """(a, b, w) of a graph without repeated edges."""

    def work(batches):
        for x in batches:
            for raw in x.column("payload").to_pylist():
                a, b, w = unpack(raw)
                for s in range(0, len(a), BATCH):
                    yield _batch(a=a[s : s + BATCH], b=b[s : s + BATCH], w=w[s : s + BATCH])

    return g.cells.where("n > 0").mapInArrow(work, "a long, b long, w long")


def indexed(g: Packed) -> Packed:
    """The edges, each once, numbered from 0 in the order of (a, b) within the range of a (see ``named``)."""
    bounds, ranges = g.bounds, len(g.bounds) + 1

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = _once(*_unpack_all([x for y in batches for x in y.column("payload").to_pylist()]))
        yield _cells(bounds, a, b, np.arange(len(a)))

    rows = g.cells.where((F.col("kind") == EDGE) & (F.col("n") > 0)).select(F.floor(F.col("cell") / ranges).cast("int").alias("x"), "payload")
    parts = max(int(g.cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ranges, 1000))
    return Packed(materialize(rows.repartition(parts, "x").groupBy("x").applyInArrow(work, CELLS), "indexed"), bounds, True)


def named(g: Packed, among: Packed | None = None) -> DataFrame:
    """(a, b, w) of edges ``indexed``, all or those that are also ``among`` others, numbered in the order of (a, b)."""
    ranges = len(g.bounds) + 1
    sizes = np.zeros(ranges, np.int64)
    for x, n in g.cells.groupBy(F.floor(F.col("cell") / ranges).cast("int")).agg(F.sum("n")).collect():  # a row per range
        sizes[x] = n
    starts = np.cumsum(sizes) - sizes
    bounds = g.bounds
    rows, every = g.cells.select(F.lit(0).alias("side"), "cell", "payload"), among is None
    if among is not None:
        rows = rows.unionByName(among.cells.where("n > 0").select(F.lit(1).alias("side"), "cell", "payload"))

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = [], []
        for x in batches:
            for side, payload in zip(x.column("side").to_pylist(), x.column("payload").to_pylist(), strict=True):
                (other if side else own).append(payload)
        a, b, w = _unpack_all(own)
        w += starts[key[0].as_py() // ranges]
        if not every:
            p, q, _ = _unpack_all(other)
            p, q = np.concatenate([a, p]), np.concatenate([b, q])
            order = np.lexsort((q, p))  # stable: of two equal ones, the first is our own
            p, q = p[order], q[order]
            at = order[:-1][(p[1:] == p[:-1]) & (q[1:] == q[:-1])]
            del order, p, q
            a, b, w = a[at], b[at], w[at]
        for s in range(0, len(a), BATCH):
            yield _batch(a=a[s : s + BATCH], b=b[s : s + BATCH], w=w[s : s + BATCH])

    tasks = max(int(g.cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ranges, 1000))
    return rows.repartition(tasks, "cell").groupBy("cell").applyInArrow(work, "a long, b long, w long")


def edge_count(g: Packed) -> DataFrame:
    return g.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("edges"))


def vertex_sums(g: Packed) -> DataFrame:
    """(vertex, total) of the numbers of its edges."""

    def work(batches):
        for x in batches:
            for raw in x.column("payload").to_pylist():
                a, b, w = unpack(raw)
                for ends in (a, b):
                    vertex, local = np.unique(ends, return_inverse=True)
                    yield _batch(vertex=vertex, n=np.bincount(local, w, len(vertex)).astype(np.int64))

    return g.cells.where("n > 0").mapInArrow(work, "vertex long, n long").groupBy("vertex").agg(F.sum("n").alias("total"))


def truss(g: Packed, k: int, keep: bool = False) -> Packed:
    """The edges of the k-truss, k >= 3.  The cells of g are deleted unless ``keep``.

    Supports are counted, and each tile follows what falls within it: at once for edges that no other tile has, and for all
    others by the supports counted before; this is repeated while edges have gone whose triangles other tiles still counted.
    """
    known = False
    while True:
        left = supported(g, k - 2, fall=k > 3, known=known)
        if not keep:
            release(g.cells)
        keep = False
        if not left.hits:  # edges without triangles take nothing with them
            return left
        g, known = left, not known
