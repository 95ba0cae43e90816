"""SimHash near-deduplication over sharded BK-trees.

Fingerprints are gathered to their distinct values first, so copies cost nothing further.  Two values
within the radius differ in at most ``radius`` of any ``parts`` disjoint slices of their bits, so they agree
on some ``parts - radius`` slices: every choice of slices gives a table, and equal slices a shard.  Slices
are as narrow as lets a shard hold about SHARD values, enough for its tree to rule most of them out.  Each
shard is a BK-tree - children keyed by their Hamming distance to the parent - and a search follows only
the edges within the radius of the query's own distance.  A shard's tree lies with its queries: a
broadcast of all trees would grow with the corpus, and would collect all fingerprints on the driver.
A shard reports a star per connected set, not its pairs.

Defined results: null and blank texts have fingerprint zero and link like any other; very long texts count
whole; a null doc_id never names a component unless all its members lack one; ties do not matter, as a
component is named by its smallest doc_id; rows that repeat share a component; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.llm import textnp as T
from trellis.session import materialize

RADIUS = 3
SEED = 42
FRONTIER = 1 << 17
SHARD = 256


def simhash(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        start = np.append(0, end[:-1] + 1)
        pairs = zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
        f = xxhash.xxh64_intdigest
        h = np.array([f(joined[a:b], SEED) for a, b in pairs], np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        count += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""

    def work(batches):
        for b in batches:
            fp = np.fromiter((simhash(t, shingle) for t in T.raw_texts(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards at once; values are distinct within a shard."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values
        self.edge = np.zeros(n, np.int64)
        parent = np.full(n, -1)
        subtree = np.unique(shard, return_inverse=True)[1].astype(np.int64)
        rest = np.argsort(subtree, kind="stable")
        self.root_of = np.zeros(n, np.int64)
        first_round = True
        while len(rest):
            s = subtree[rest]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            node = np.repeat(rest[head], np.diff(np.append(head, len(rest))))
            if first_round:
                self.root_of[rest] = node
                first_round = False
            others = np.ones(len(rest), bool)
            others[head] = False
            rest, node = rest[others], node[others]
            d = np.bitwise_count(values[rest] ^ values[node]).astype(np.int64)
            parent[rest], self.edge[rest] = node, d
            subtree[rest] = node * 65 + d
            rest = rest[np.argsort(subtree[rest], kind="stable")]
        # a node is a child of its last parent; several share (parent, edge) only before they are placed
        self.parent = parent
        order = np.lexsort((self.edge, parent))
        self.children = order[np.searchsorted(parent[order], 0) :]
        up = parent[self.children]
        self.begin = np.searchsorted(up, np.arange(n))
        self.count = np.searchsorted(up, np.arange(n), side="right") - self.begin

    def neighbours(self, query: np.ndarray, radius: int, both: bool = False):
        """Blocks of (query, neighbour) index pairs within the radius, itself excluded; each pair once or both ways."""
        stack = [(query, self.root_of[query])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[k : k + FRONTIER], node[k : k + FRONTIER]) for k in range(0, len(q), FRONTIER)]
                continue
            d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & ((q != node) if both else (q < node))
            if hit.any():
                yield q[hit], node[hit]
            c = self.count[node]
            child = self.children[T.spread(self.begin[node], c)]
            follow = np.abs(self.edge[child] - np.repeat(d, c)) <= radius
            if follow.any():
                stack.append((np.repeat(q, c)[follow], child[follow]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label leads each vertex to its set's smallest."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def slices_for(n: int, radius: int) -> tuple[int, int]:
    """Number and width of the slices by which n values fall into shards of SHARD or so (more only if bits run out)."""
    bits = max(1, int(np.ceil(np.log2(max(n, 2) / SHARD))))
    parts = radius + 1
    while parts < radius + 4 and (64 // parts) * (parts - radius) < bits:
        parts += 1
    return parts, min(64 // parts, -(-bits // (parts - radius)))


def slice_masks(parts: int, radius: int, width: int = 0) -> list[int]:
    """The bits of each choice of ``parts - radius`` of the slices, of ``width`` bits or else all that there are."""
    cuts = [width * k for k in range(parts + 1)] if width else [64 * k // parts for k in range(parts + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(single[k] for k in keep) for keep in combinations(range(parts), parts - radius)]


def links(distinct: DataFrame, radius: int, n_values: int) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all within the radius of each other."""
    n = C.bucket_count(distinct, 1 << 20)
    parts, width = slices_for(n_values, radius)
    masks = slice_masks(parts, radius, width)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("e")).select("fp", F.xxhash64("e.t", "e.k").alias("k"))
    rows = rows.withColumn("b", F.expr(f"pmod(k, {n})"))

    def work(key, t):
        fp, shard = t["fp"].to_numpy(), t["k"].to_numpy()
        order = np.lexsort((fp, shard))
        fp, shard = fp[order], shard[order]
        many = np.zeros(len(fp), bool)
        many[1:] = shard[1:] == shard[:-1]
        many[:-1] |= many[1:]
        fp, shard = fp[many], shard[many]
        label = np.arange(len(fp))
        if len(fp):
            forest = BKForest(fp.view(np.uint64), shard)
            for lo in range(0, len(fp), 1 << 14):
                for a, b in forest.neighbours(np.arange(lo, min(len(fp), lo + (1 << 14))), radius):
                    unite(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": pa.array(fp[moved], pa.int64()), "v": pa.array(fp[label[moved]], pa.int64())})

    return rows.groupBy("b").applyInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id, component_size (documents)."""
    each = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "simhash-values")
    found = C.components(links(distinct, radius, distinct.count()))
    rooted = distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "simhash-roots")
    groups = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("component_size"))
    named = materialize(rooted.join(groups, "root").select("fp", "copies", "component_id", "component_size"), "simhash-names")
    return C.lookup_skewed(each, named, "fp", "copies").select("doc_id", "fp", "component_id", "component_size")


# ---- near duplicates by shingle similarity ------------------------------------------------------
#
# A similarity of 0.8 over five-word shingles leaves single fingerprints of such shingles ten bits
# apart, far beyond what slices can index.  So candidates come from SEEDS fingerprints over the distinct
# words, any of which within the radius suffices, and from BANDS bands of ROWS min-hashes of the shingles,
# any of which equal suffices: whatever the edit, a pair of similarity s shares no band with probability
# (1 - s**ROWS)**BANDS, at 0.8 three in a million.  The keys are used in two passes, the second of which
# leaves out shards whose documents the first has connected.  Candidates are verified on their whole sets of shingles, as 32-bit hashes.

SEEDS = 4
BANDS = 24
FIRST_BANDS = 4
ROWS = 4
SIMILARITY = 0.8
GROUP = 512
QUERIES = 16
VALUES = 1 << 20
#: Identifiers that are broadcast at most: 32 MB at 64 bytes each once hashed.
BROADCAST_UIDS = (32 << 20) // 64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_fingerprints(text: bytes) -> list[int]:
    """SEEDS fingerprints of the set of words, signs and case aside."""
    words = sorted(set(_WORD.findall(text.lower())))
    if not words:
        return [0] * SEEDS
    base = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    out = []
    for k in range(SEEDS):
        h = T.mix(base + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else base
        count = np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
        out.append(int(np.packbits(count * 2 > len(h), bitorder="little").view(np.int64)[0]))
    return out


def shingle_hashes(texts: list[bytes], shingle: int):
    """(hashes, cut) of each block: text k of the block has the shingles hashes[cut[k]:cut[k + 1]], at least one."""
    for lo, hi in T.blocks(texts):
        block = T.Block([t.lower() for t in texts[lo:hi]])
        start, end, first = block.words()
        roll = T.Rolling(T.word_hashes(block.data, start, end, 4))
        n = np.diff(first)
        count, whole = np.maximum(n - shingle + 1, 1), n < shingle
        cut = np.append(0, np.cumsum(count))
        h = np.empty(cut[-1], np.uint64)
        h[cut[:-1][whole]] = roll(first[:-1], first[1:])[whole]
        h[T.spread(cut[:-1][~whole], count[~whole])] = roll.fixed(shingle)[T.spread(first[:-1][~whole], count[~whole])]
        yield h, cut


_FACTORS = T.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(texts x BANDS) keys of the bands of min-hashes."""
    low = np.array([np.minimum.reduceat(hashes * f, cut[:-1]) for f in _FACTORS])
    key = low[::ROWS]
    for k in range(1, ROWS):
        key = T.mix(key) ^ low[k::ROWS]
    return T.mix(key).T.view(np.int64)


def sketches_of(hashes: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Of each text the hashes of its shingles: all of them, sorted."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def shingle_sketches(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    return [s for x in shingle_hashes(texts, shingle) for s in sketches_of(*x)]


def similarity(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a set of shingles with each of many; none is empty."""
    size = np.fromiter(map(len, many), np.int64, len(many))
    values = np.concatenate(many)
    both = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    common = np.add.reduceat(both, np.cumsum(size) - size, dtype=np.int64)
    return common / (len(one) + size - common)


class Shards:
    """Rows of one bucket as shards of distinct fingerprints, each with its documents."""

    def __init__(self, k: np.ndarray, fp: np.ndarray, radius: int):
        order = np.lexsort((fp, k))
        self.order, k, fp = order, k[order], fp[order]
        new = np.append(True, (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])) if len(k) else np.zeros(0, bool)
        self.node = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(k)))
        self.forest = BKForest(fp[new].view(np.uint64), k[new])
        self.shard = np.cumsum(np.append(True, k[new][1:] != k[new][:-1])) - 1 if len(k) else np.zeros(0, np.int64)
        self.radius = radius

    def hits(self):
        n = len(self.begin)
        for lo in range(0, n, 1 << 13):
            yield from self.forest.neighbours(np.arange(lo, min(n, lo + (1 << 13))), self.radius)

    def near(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        """For each node itself and its neighbours."""
        found = [*self.forest.neighbours(nodes, self.radius, both=True)]
        a, b = (np.concatenate([nodes, *(x[i] for x in found)]) for i in (0, 1))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        return dict(zip(a[cuts].tolist(), np.split(b, cuts[1:]), strict=True))

    def groups(self):
        """Ranges of whole shards with GROUP nodes or so; a larger shard stands alone."""
        ends = np.flatnonzero(np.append(self.shard[1:] != self.shard[:-1], True)) + 1 if len(self.shard) else []
        lo = hi = 0
        for e in ends:
            if e - lo > GROUP and hi > lo:
                yield lo, hi
                lo = hi
            hi = int(e)
        if hi > lo:
            yield lo, hi


def candidates(rows: DataFrame, radius: int) -> DataFrame:
    """The rows (b, k, fp, uid, root) whose shard holds a document of another root within the radius."""

    def work(key, t):
        s = Shards(t["k"].to_numpy(), t["fp"].to_numpy(), radius)
        root = t["root"].to_numpy()[s.order]
        low, high = (f.reduceat(root, s.begin) for f in (np.minimum, np.maximum))
        live = low < high
        for a, b in s.hits():
            apart = np.minimum(low[a], low[b]) < np.maximum(high[a], high[b])
            live[a[apart]] = live[b[apart]] = True
        return t.take(pa.array(s.order[live[s.node]]))

    return rows.groupBy("b").applyInArrow(work, rows.schema)


def verified_links(rows: DataFrame, radius: int, least: float) -> DataFrame:
    """(u, v): for each shard, stars over its documents connected by verified similarity.

    A search goes breadth first: a document is compared with the candidates that no set holds yet, so a
    group of copies costs one comparison each.
    """

    def work(key, t):
        uid = t["uid"].to_numpy()
        sketch = [np.frombuffer(x, np.uint32) for x in t["sketch"].to_pylist()]
        s = Shards(t["k"].to_numpy(), t["fp"].to_numpy(), radius)
        uid, sketch = uid[s.order], [sketch[k] for k in s.order.tolist()]
        size = np.fromiter(map(len, sketch), np.int64, len(sketch))
        free = np.ones(len(uid), bool)
        u, v = [], []

        def grow(root: int, last: int, near: dict[int, np.ndarray]) -> None:
            """Everything that verified similarity connects with root; last: the end of its shards' rows."""
            free[root] = False
            queue = [root]
            while queue and free[root:last].any():
                batch, queue = queue[-QUERIES:], queue[:-QUERIES]
                unknown = sorted({int(n) for n in s.node[batch]} - near.keys())
                found = near if not unknown else near | s.near(np.array(unknown))
                for i in batch:
                    nodes = found[int(s.node[i])]
                    others = T.spread(s.begin[nodes], s.size[nodes])
                    others = others[free[others]]
                    # sizes too far apart rule a pair out
                    others = others[np.minimum(size[others], size[i]) / np.maximum(size[others], size[i]) >= least]
                    block = np.cumsum(size[others]) // VALUES
                    for part in np.split(others, np.flatnonzero(np.diff(block)) + 1) if len(others) else ():
                        same = part[similarity(sketch[i], [sketch[k] for k in part.tolist()]) >= least]
                        free[same] = False
                        queue += same.tolist()
                        u.append(uid[same])
                        v.append(np.full(len(same), uid[root]))

        for lo, hi in s.groups():
            near = s.near(np.arange(lo, hi)) if hi - lo <= GROUP else {}
            last = int(s.begin[hi - 1] + s.size[hi - 1])
            for root in range(int(s.begin[lo]), last):
                if free[root]:
                    grow(root, last, near)
        return pa.table({"u": pa.array(np.concatenate(u) if u else [], pa.int64()), "v": pa.array(np.concatenate(v) if v else [], pa.int64())})

    return rows.groupBy("b").applyInArrow(work, "u long, v long")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near duplicates: of each connected group the smallest doc_id stays.

    Null counts as empty; texts without words are alike; shorter ones than a shingle are one shingle; a null
    doc_id comes last, and of one doc_id any one stays; of rows equal in doc_id and text the smallest by its
    other columns stays, so exact duplicates need not go first; an empty table gives an empty result; other
    columns pass through, whatever their names.
    """
    schema = "doc_id long, own string, fps array<long>, bands array<long>, sketch binary"

    def work(batches):
        for t in C.large_batches(batches, limit=4 << 20):
            texts = T.raw_texts(t["text"])
            fps = [word_fingerprints(x) for x in texts]
            bands, sketches = [], []
            for found in shingle_hashes(texts, shingle):
                bands += band_keys(*found).tolist()
                sketches += [x.tobytes() for x in sketches_of(*found)]
            ids = t["doc_id"].combine_chunks().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(C.row_keys(ids, texts)), pa.array(fps, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "own", "fps", "bands", "sketch"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = materialize(plain.mapInArrow(work, schema).withColumn("uid", F.monotonically_increasing_id()), "near-documents")
    n = C.bucket_count(docs, 2 << 20)
    masks = [m - (1 << 64) if m >> 63 else m for m in slice_masks(radius + 1, radius)]
    sliced = [[F.struct(F.lit(f"{k}:{i}").alias("t"), F.col("fps")[k].alias("fp"), F.col("fps")[k].bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)] for k in range(SEEDS)]
    banded = [F.struct(F.lit(f"band {k}").alias("t"), F.lit(0).cast("long").alias("fp"), F.col("bands")[k].alias("k")) for k in range(BANDS)]

    def linked(known: DataFrame, keys: list) -> DataFrame:
        """(u, v): verified links by some of the keys between documents (uid, root, fps, bands) of different roots."""
        rows = known.select("uid", "root", F.explode(F.array(*keys)).alias("e")).select("uid", "root", "e.fp", F.xxhash64("e.t", "e.k").alias("k")).withColumn("b", F.expr(f"pmod(k, {n})"))
        live = materialize(candidates(rows, radius), "near-candidates")
        sketches, uids = each.select("uid", "sketch"), live.select("uid").distinct()
        if uids.count() <= BROADCAST_UIDS:  # then only their sketches are exchanged
            sketches = sketches.join(F.broadcast(uids), "uid", "left_semi")
        return materialize(verified_links(live.join(sketches, "uid"), radius, least), "near-links")

    # a few keys connect most near copies; the others look only where documents are not connected yet
    first = linked(each.withColumn("root", F.col("uid")), [*sliced[0], *banded[:FIRST_BANDS]])
    stars = materialize(C.components(first), "near-stars")
    known = each.select("uid", "fps", "bands").join(stars.withColumnRenamed("u", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    second = linked(known, [*(x for s in sliced[1:] for x in s), *banded[FIRST_BANDS:]])
    found = C.components(second.unionByName(stars.withColumnRenamed("root", "v")))
    member = each.select("uid", "doc_id", "own").join(found.withColumnRenamed("u", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    member = materialize(member, "near-members")
    stays = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("first"), F.count("*").alias("n")).where("n > 1")
    once, key = C.first_of_equal_rows(docs)
    # rows equal to the one that stays are that one
    gone = member.join(stays, "root").where("own <> first.own").select(F.col("own").alias(key)).distinct()
    return once.join(gone, key, "left_anti").select(*C.columns(docs))


def op5_simhash_bk_tree(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
