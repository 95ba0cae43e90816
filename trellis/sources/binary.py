"""Binary edge files: pairs of little-endian 64-bit vertex numbers from 0, 16 bytes an edge."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 16
PIECE = 1 << 16
WHOLE = 256 << 20


def _decode(batches):
    for b in batches:
        for raw in b.column("content").to_pylist():
            if len(raw) % RECORD:
                raise ValueError("the file's size is no multiple of 16 bytes")
            e = np.frombuffer(raw, "<i8").reshape(-1, 2)
            for k in range(0, len(e), 1 << 20):
                part = e[k : k + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, 0])), pa.array(np.ascontiguousarray(part[:, 1]))], names=["src", "dst"])


def read_edges(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(src, dst) of all files under the path; a size that is no multiple of 16 bytes is an error.

    Files of at most ``whole`` bytes are read each by one task; where one is larger, Spark deals byte ranges of
    whole records instead.  Fixed-length records have no DataFrame source, hence the one use of an RDD: it hands
    on pieces of many records, which are decoded as Arrow batches like whole files.
    """
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.max("length")).first()[0] or 0) <= whole:
        return decode_edges(files.select("content"))
    if not files.where(F.col("length") % RECORD != 0).isEmpty():
        raise ValueError("a file's size is no multiple of 16 bytes")

    def pieces(records):
        while held := list(itertools.islice(records, PIECE)):
            yield (b"".join(held),)

    return decode_edges(spark.createDataFrame(spark.sparkContext.binaryRecords(path, RECORD).mapPartitions(pieces), "content binary"))


def decode_edges(pieces: DataFrame) -> DataFrame:
    """(src, dst) of binary pieces (content)."""
    return pieces.mapInArrow(_decode, "src long, dst long")


def encode_edges(edges: DataFrame, records: int = 1 << 20) -> DataFrame:
    """(content): edges as binary pieces of at most ``records`` edges."""

    def encode(batches):
        for b in batches:
            pairs = np.column_stack((b.column("src").to_numpy(), b.column("dst").to_numpy())).astype("<i8")
            pieces = [pairs[k : k + records].tobytes() for k in range(0, len(pairs), records)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["content"])

    return edges.select("src", "dst").mapInArrow(encode, "content binary")


def slice_bounds(records: int, workers: int) -> list[tuple[int, int]]:
    """(first, count) per worker: contiguous slices, the first (records mod workers) one longer."""
    size, extra = divmod(records, workers)
    return [(w * size + min(w, extra), size + (w < extra)) for w in range(workers)]


def write_edges(edges: DataFrame, path: str) -> None:
    """A folder of binary files, one per partition, of vertex numbers from 0 to 2**56 - 1.

    Spark's text sink writes the bytes: it ends each piece by a zero, which is the last byte of such a number.
    """
    fits = (F.col("dst") >= 0) & (F.col("dst") < 1 << 56)
    checked = edges.select("src", F.when(fits, F.col("dst")).otherwise(F.raise_error(F.lit("a vertex number beyond 2**56")).cast("long")).alias("dst"))
    pieces = encode_edges(checked).where(F.length("content") > 0).select(F.substring("content", F.lit(1), F.length("content") - 1).cast("string").alias("value"))
    pieces.write.mode("overwrite").text(path, lineSep="\0")
