"""Distribution helpers of the corpus operators: bucket counts, packed exchanges, hot keys, components."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm import textnp as T
from trellis.session import materialize, release

NULL_ID = -(1 << 63)
FLUSH_BYTES = 12 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``; where it knows none, 64 MB a partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 < size < 1 << 55 else df.rdd.getNumPartitions() << 26


def bucket_count(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """Buckets for a keyed exchange of ``df``: they grow with the input, so a bucket's size does not."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(1 << 20, max(2 * partitions, -(-input_bytes(df) // bytes_each))))


def ids_of(column: pa.Array) -> np.ndarray:
    """doc_id as int64; null is the smallest id."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def row_digests(texts: list[bytes]) -> np.ndarray:
    """The first 64 bits of each text's MD5: with the doc_id they tell rows apart, and they order rows of one doc_id."""
    joined = b"".join([hashlib.md5(t, usedforsecurity=False).digest()[:8] for t in texts])
    return np.frombuffer(joined, ">u8").astype(np.uint64)


def row_bucket(ids: np.ndarray, digests: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(T.mix(ids.astype(np.int64).view(np.uint64)) ^ digests) % np.uint64(n)).astype(np.int64)


def same_as_previous(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def repeated_rows(ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which rows equal another one in doc_id and text that comes first here."""
    order = np.lexsort((digests, ids))
    out = np.zeros(len(ids), bool)
    out[order] = same_as_previous(ids[order], digests[order])
    return out


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that are taken (whatever their case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def large_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = FLUSH_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of text: large enough to pre-aggregate, small enough for a worker's memory."""
    held, size = [], 0
    for whole in batches:
        for b in _slices(whole, whole.schema.get_field_index(text), limit):
            held.append(b)
            size += b.column(b.schema.get_field_index(text)).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _slices(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text is at most ``limit`` bytes, or a single row."""
    if not batch.num_rows:
        return
    if batch.column(text).nbytes <= limit:
        yield batch
        return
    size = np.cumsum(pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


_CODES = [np.dtype(x) for x in ("u1", "<u2", "<u4", "<u8", "<i8", "<i4")]


def squeeze(*parts) -> bytes:
    """Arrays and byte strings as one compressed string with six bytes of overhead each, as many are tiny."""
    out = []
    for p in parts:
        if isinstance(p, bytes):
            out.append(struct.pack("<BI", 255, len(p)) + p)
        else:
            p = np.ascontiguousarray(p)
            out.append(struct.pack("<BI", _CODES.index(p.dtype), len(p)) + p.tobytes())
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(b"".join(out))


def expand(blob: bytes) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        code, n = struct.unpack_from("<BI", raw, at)
        at += 5
        if code == 255:
            out.append(raw[at : at + n])
            at += n
        else:
            out.append(np.frombuffer(raw, _CODES[code], n, at))
            at += n * _CODES[code].itemsize
    return out


def to_ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers) of each bucket that has rows; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def plain(docs: DataFrame) -> DataFrame:
    """Docs with numbers as column names but for doc_id and text, since Python workers refuse some names; ``toDF`` restores them."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def row_key() -> Column:
    """What tells rows apart: doc_id and a 64-bit hash of the text; rows equal in both are the same."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def row_keys(ids: pa.Array, texts: list[bytes]) -> list[str]:
    """``row_key`` of rows that a worker holds."""
    h = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
    return [f"{'none' if i is None else i}:{x}" for i, x in zip(ids.to_pylist(), h.tolist(), strict=True)]


def first_of_equal_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """Docs with a column of their row keys (whose name is returned), and of rows equal in doc_id and text one.

    It is the smallest by its other columns.  Partitions drop what repeats before rows are exchanged, and
    the result lies by row key, so a join by it needs no further exchange.
    """
    key, place = fresh(docs.columns, "row_key", "place")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    marked = docs.withColumn(key, row_key())
    first = marked.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(order), order)))
    return first.where(F.col(place) == 1).drop(place), key


def packed(docs: DataFrame, n: int) -> DataFrame:
    """(b, copy, blob): whole rows dealt by a hash of doc_id and text into n buckets, as compressed Arrow blobs.

    An exchange of these moves a third of the bytes that plain rows would.  A row that equals another one
    of its unit of work in both is marked as a copy and dealt by its place, so a row that repeats any
    number of times sends one row a unit to its bucket.
    """

    def pack(batches):
        for t in large_batches(batches):
            ids, digests = ids_of(t["doc_id"]), row_digests(T.raw_texts(t["text"]))
            again = repeated_rows(ids, digests)
            home = row_bucket(ids, digests, n)
            out = []
            for copy in (False, True):
                rows = np.flatnonzero(again == copy)
                at = (home[rows] + (np.arange(len(rows)) + 1 if copy else 0)) % n
                out += [(b, copy, to_ipc(t.take(pa.array(rows[i])))) for b, i in by_bucket(at)]
            yield pa.RecordBatch.from_pydict({"b": pa.array([r[0] for r in out], pa.int64()), "copy": pa.array([r[1] for r in out], pa.bool_()), "blob": pa.array([r[2] for r in out], pa.binary())})

    return docs.mapInArrow(pack, "b long, copy boolean, blob binary")


def unpacked(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a bucket, and which of them are copies of others, here or in another bucket."""
    tables = [pa.ipc.open_stream(x).read_all() for x in group["blob"].to_pylist()]
    copy = np.repeat(group["copy"].to_numpy().astype(bool), [t.num_rows for t in tables])
    t = pa.concat_tables(tables)
    copy |= repeated_rows(ids_of(t["doc_id"]), row_digests(T.raw_texts(t["text"]))) & ~copy if len(copy) else copy
    return t, copy


HOT_SAMPLE = 20_000
HOT_RECORDS = 5_000
HOT_KEYS = 1 << 16


def hot_keys(docs: DataFrame, keys_of, most: int = HOT_SAMPLE, records: int = HOT_RECORDS) -> np.ndarray:
    """Keys that about ``records`` documents or more share, judged on about ``most`` sampled ones.

    keys_of(texts) gives the unsigned keys of some texts.  The list only decides how rows are dealt, so
    what the sample misses costs balance and no results; at most HOT_KEYS of them leave the cluster.
    """
    n = docs.count()
    share = min(1.0, most / max(n, 1))
    if n < records:
        return np.zeros(0, np.uint64)

    def work(batches):
        for t in large_batches(batches, limit=4 << 20):
            each = [np.unique(keys_of([x])) for x in T.raw_texts(t["text"])]
            k, c = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "c"])

    found = docs.select("text").sample(share, seed=7).mapInArrow(work, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    rows = found.where(F.col("c") >= max(4, int(records * share))).orderBy(F.col("c").desc(), "k").limit(HOT_KEYS).collect()
    return np.sort(np.array([r["k"] for r in rows], np.int64).view(np.uint64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def lookup_skewed(left: DataFrame, right: DataFrame, key: str, size: str, share: int = 200) -> DataFrame:
    """left join on a key of which right has one row, with its number of left rows in ``size``.

    Keys that hold over 1/share of all left rows number less than ``share``; only those are broadcast,
    and the rest is an ordinary join on a key that no longer has hot values.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    floor = max(1, total // share)
    extra = [c for c in right.columns if c != key]
    hot = F.broadcast(right.where(F.col(size) > floor).select(F.col(key).alias("_k"), F.struct(*extra).alias("_hot")))
    cold = right.where(F.col(size) <= floor).select(key, *extra)
    marked = left.join(hot, left[key] == hot["_k"], "left").drop("_k")
    names = [c for c in left.columns]
    warm = marked.where(F.col("_hot").isNotNull()).select(*names, *[F.col(f"_hot.{c}").alias(c) for c in extra])
    rest = marked.where(F.col("_hot").isNull()).select(*names).join(cold, key, "left").select(*names, *extra)
    return warm.unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (u, root) with root the smallest vertex reachable.

    Alternating large-star and small-star steps; all state stays in tables, and each round halves the
    longest chain.  Vertices without edges do not appear.  Each step only groups by vertex with
    min-aggregates and joins the minimum back, so no neighbour list is ever gathered.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(both, "links")
    before = None
    for _ in range(max_rounds):
        pairs = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "links-low")
        # the centre of a large star is a key that all its leaves look up
        large = lookup_skewed(pairs.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        previous, current = current, materialize(small.where("u <> v").distinct(), "links")
        release(previous, low)
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return current.groupBy("u").agg(F.min("v").alias("root"))
