"""Threshold-scaled document fingerprints.

A fingerprint keeps every hash of the document's five-word shingles below a fixed fraction of the hash
range, the same for all documents.  So its size follows the document's, fingerprints merge by union, and
the containment of a small document in a large one can be estimated: both keep the same shingles of what
they share.  Of u shingles in two documents together about u / FRACTION are compared, so a likeness s has
a standard error of sqrt(s * (1 - s) * FRACTION / u): 0.05 at 1,000 shingles, 0.15 at 100, and documents
of a few words often keep no hash at all.

As text: the fraction, a colon, and the sorted hashes in base64 (32 bits below the threshold each, eight
hundredths of a long text), or a dash where the document has no words.

Defined results: null counts as empty; texts without words are alike to each other only; shorter ones
than a shingle are one shingle; where two documents keep no hash between them, nothing speaks for a
likeness and it is 0; very long texts are worked on whole; rows of one doc_id follow in the order of their
texts' MD5, rows that repeat follow themselves, a null doc_id comes first, and the only row of a table is
its own successor; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.llm import textnp as T

SHINGLE = 5
FRACTION = 10
BUCKET_BYTES = 8 << 20
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sketch:
    """The kept hashes, sorted, and whether the document has any shingle."""

    __slots__ = ("blank", "fraction", "hashes")

    def __init__(self, hashes: np.ndarray, blank: bool, fraction: int = FRACTION):
        self.hashes, self.blank, self.fraction = hashes, blank, fraction

    @classmethod
    def of(cls, shingles: np.ndarray, fraction: int = FRACTION) -> Sketch:
        limit = np.uint64((1 << 64) // fraction)
        kept = shingles[shingles < limit]
        # 32 bits of each kept hash, spread over the range below the threshold
        return cls(np.unique((kept // (limit >> np.uint64(32))).astype(np.uint32)), not len(shingles), fraction)

    def text(self) -> str:
        return f"{self.fraction}:" + ("-" if self.blank else base64.b64encode(self.hashes.astype(">u4").tobytes()).decode())

    @classmethod
    def parse(cls, s: str) -> Sketch:
        fraction, body = s.split(":")
        return cls(np.frombuffer(b"" if body == "-" else base64.b64decode(body), ">u4").astype(np.uint32), body == "-", int(fraction))

    def common(self, other: Sketch) -> int:
        if self.fraction != other.fraction:
            raise ValueError("fingerprints of different fractions cannot be compared")
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def merge(self, other: Sketch) -> Sketch:
        """The fingerprint of both documents' shingles together."""
        if self.fraction != other.fraction:
            raise ValueError("fingerprints of different fractions cannot be merged")
        return Sketch(np.union1d(self.hashes, other.hashes), self.blank and other.blank, self.fraction)

    def likeness(self, other: Sketch) -> float:
        """Estimated share of common shingles (Jaccard)."""
        common = self.common(other)
        union = len(self.hashes) + len(other.hashes) - common
        return common / union if union else float(self.blank and other.blank)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this document's shingles that the other holds."""
        return self.common(other) / len(self.hashes) if len(self.hashes) else float(self.blank)


def sketches(texts: list[bytes]) -> list[Sketch]:
    out = []
    for lo, hi in T.blocks(texts):
        block = T.Block([t.lower() for t in texts[lo:hi]])
        start, end, first = block.words()
        roll = T.Rolling(T.word_hashes(block.data, start, end, 3))
        n = np.diff(first)
        grams = roll.fixed(SHINGLE)
        whole = roll(first[:-1], first[1:])
        for k in range(hi - lo):
            a, m = int(first[k]), int(n[k])
            out.append(Sketch.of(grams[a : a + m - SHINGLE + 1] if m >= SHINGLE else whole[k : k + 1] if m else grams[:0]))
    return out


def edit(text: str, following: str) -> str:
    """The last quarter of the text (rounded down, in code points) replaced by the start of the next one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def range_starts(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest (id, digest) of each of at most n ranges of rows: one pair a bucket goes to the driver and back."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID).cast("long")).alias("id"), F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 16).alias("digest"))
    found = keys.repartitionByRange(n, "id", "digest").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "digest")).alias("low")).collect()
    low = sorted((r["low"]["id"], int(r["low"]["digest"], 16)) for r in found)
    return np.array([x[0] for x in low], np.int64), np.array([x[1] for x in low], np.uint64)


def range_of(starts: tuple[np.ndarray, np.ndarray], ids: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its range, and whether it is the first of it."""
    n = len(starts[0])
    i, g = np.append(starts[0], ids), np.append(starts[1], digests)
    is_row = np.arange(len(i)) >= n
    order = np.lexsort((is_row, g, i))
    at = np.empty(len(i), np.int64)
    at[order] = np.cumsum(~is_row[order]) - 1
    at = at[n:]
    return at, (starts[0][at] == ids) & (starts[1][at] == digests)


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """(b, tail, n, blob): rows by range of (doc_id, digest); the first row of each range also goes to the range before it.

    Rows of a unit of work that repeat go as one, with their numbers in ``n``.
    """
    starts = range_starts(docs, n)

    def work(batches):
        for t in C.large_batches(batches):
            ids, digests = C.ids_of(t["doc_id"]), C.row_digests(T.raw_texts(t["text"]))
            order = np.lexsort((digests, ids))
            head = np.flatnonzero(~C.same_as_previous(ids[order], digests[order]))
            rows, count = order[head], np.diff(np.append(head, len(order))).astype(np.int64)
            at, first = range_of(starts, ids[rows], digests[rows])
            out = [(b, 0, count[i], rows[i]) for b, i in C.by_bucket(at)]
            out += [((at[k] - 1) % len(starts[0]), 1, count[k : k + 1], rows[k : k + 1]) for k in np.flatnonzero(first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(r[0]) for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([C.to_ipc(t.take(pa.array(r[3]))) for r in out], pa.binary())],
                names=["b", "tail", "n", "blob"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "b long, tail int, n array<long>, blob binary")


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness."""

    def work(key, t):
        tail = t["tail"].to_numpy()

        def rows(kind):
            """(doc_id, text, number of rows) in order, each distinct row once."""
            some = t.filter(pa.array(tail == kind))
            if not some.num_rows:
                return []
            x = C.from_ipc(some["blob"].to_pylist())
            texts, ids = T.raw_texts(x["text"]), C.ids_of(x["doc_id"])
            digests = C.row_digests(texts)
            count = np.concatenate(some["n"].to_pylist()).astype(np.int64)
            order = np.lexsort((digests, ids))
            head = np.flatnonzero(~C.same_as_previous(ids[order], digests[order]))
            number = np.add.reduceat(count[order], head)
            doc = x["doc_id"].to_pylist()
            return [(doc[k], texts[k], int(c)) for k, c in zip(order[head].tolist(), number.tolist(), strict=True)]

        own, after = rows(0), rows(1)[:1]
        raw = [r[1] for r in [*own, *after]]
        # a row that repeats comes before itself, but for the last time
        pairs = [p for k, r in enumerate(own) for p in ([(k, k, r[2] - 1)] if r[2] > 1 else []) + [(k, (k + 1) % len(raw), 1)]]
        edited = [edit(raw[k].decode(), raw[nxt].decode()).encode() for k, nxt, _ in pairs]
        plain, other = sketches(raw), sketches(edited)
        out = {f.split()[0]: [] for f in _SCHEMA.split(", ")}
        for (k, nxt, number), e, sketch in zip(pairs, edited, other, strict=True):
            values = (own[k][0], len(raw[k].decode()), hashlib.sha256(e).hexdigest(), plain[k].text(), sketch.text(), plain[k].likeness(sketch), plain[k].likeness(plain[nxt]))
            for c, v in zip(out, values, strict=True):
                out[c] += [v] * number
        kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})

    return in_order(docs, C.bucket_count(docs, BUCKET_BYTES)).groupBy("b").applyInArrow(work, _SCHEMA)


def op10_scaled_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(C.documents(spark, sf_dir))
