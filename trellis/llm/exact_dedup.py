"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its rows into one run of distinct digests, sorted, each with the smallest
identifier seen and a count.  Runs are then exchanged in binomial rounds: in each round the digest space
is cut into FANOUT times as many ranges, and the parts that FANOUT runs have of a range meet and are
merged multiway into one.  So every row of every round holds about one partition's worth of digests, a
digest with any number of copies is one entry of each run, and after log(partitions) rounds, two at
least, each range has a single run.  Entries merge only if the whole SHA-256 and an independent check
(length and 64-bit hash of the normalised text) agree, at every level.

Defined results: null text counts as empty; empty texts form a group like any other; very long texts are
hashed whole; a null doc_id sorts after every number, so it stays only where all copies lack an id; of rows
that also share the doc_id, a tie, exactly one stays: ``decide`` marks one of them, and ``deduplicate``
keeps the smallest by its other columns where the texts are equal, too; an empty table gives an empty
result; other columns pass through ``deduplicate`` and are ignored by ``decide``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.session import materialize

FANOUT = 4
_LAST = (1 << 63) - 1
_ENTRY = np.dtype([("d", "<u8", 4), ("check", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digests(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", normalised(F.col("text")).alias("_t"), C.row_key().alias("own"))
    return t.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2("_t", 256).alias("text_sha256"),
        F.xxhash64(F.length("_t"), F.col("_t")).alias("check"),
        F.col("own"),
    )


def merge_runs(entries: np.ndarray) -> np.ndarray:
    """Distinct verified digests of several runs, sorted: smallest (id, row) and summed count of each."""
    d = entries["d"]
    order = np.lexsort((entries["row"], entries["id"], entries["check"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    e = entries[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["d"][1:] != e["d"][:-1]).any(axis=1) | (e["check"][1:] != e["check"][:-1])
    first = np.flatnonzero(new)
    out = e[first].copy()
    out["n"] = np.add.reduceat(e["n"], first) if len(first) else 0
    return out


def _split(run: np.ndarray, prefix: int, level: int, group: int) -> pa.RecordBatch:
    """Cut a sorted run into FANOUT ranges of the next level."""
    ranges = FANOUT ** (level + 1)
    top = (run["d"][:, 0] >> np.uint64(40)).astype(np.int64) * ranges >> 24
    rows = [(b, group, run[i].tobytes()) for b, i in C.by_bucket(top)]
    return pa.RecordBatch.from_pydict({"prefix": pa.array([r[0] for r in rows], pa.int64()), "grp": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})


_KEYED = "prefix long, grp long, blob binary"


def tree_merge(digests: DataFrame) -> DataFrame:
    """(text_sha256, check, keep_id, keep_row, group_size), one row a digest."""
    n = max(1, digests.rdd.getNumPartitions())
    rounds = min(11, max(2, math.ceil(math.log(n, FANOUT) - 1e-9)))  # 4**12 ranges are the most that 24 bits of prefix serve

    def make(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            e = np.zeros(b.num_rows, _ENTRY)
            e["d"] = np.frombuffer(bytes.fromhex("".join(b.column("text_sha256").to_pylist())), "<u8").byteswap().reshape(-1, 4)
            e["check"] = b.column("check").to_numpy()
            e["id"] = b.column("doc_id").fill_null(_LAST).to_numpy()
            e["row"] = b.column("row").to_numpy()
            e["n"] = 1
            held.append(merge_runs(e))
            if len(held) == FANOUT:
                held = [merge_runs(np.concatenate(held))]
        if held:
            yield _split(merge_runs(np.concatenate(held)), 0, 0, TaskContext.get().partitionId() // FANOUT)

    def merge(level):
        def step(key, t):
            run = merge_runs(np.concatenate([np.frombuffer(x, _ENTRY) for x in t["blob"].to_pylist()]))
            return pa.Table.from_batches([_split(run, key[0].as_py(), level, key[1].as_py() // FANOUT)])

        return step

    def finish(key, t):
        run = merge_runs(np.concatenate([np.frombuffer(x, _ENTRY) for x in t["blob"].to_pylist()]))
        ids = run["id"].astype(np.int64)
        return pa.table({
            "text_sha256": pa.array([x.tobytes().hex() for x in np.ascontiguousarray(run["d"]).byteswap()], pa.string()),
            "check": pa.array(run["check"].astype(np.int64)),
            "keep_id": pa.array(ids, mask=ids == _LAST),
            "keep_row": pa.array(run["row"].astype(np.int64)),
            "group_size": pa.array(run["n"].astype(np.int64)),
        })

    runs = digests.mapInArrow(make, _KEYED)
    for level in range(1, rounds):
        runs = runs.groupBy("prefix", "grp").applyInArrow(merge(level), _KEYED)
    # whatever number of runs is left, a range's runs meet in the last round
    return runs.groupBy("prefix").applyInArrow(finish, "text_sha256 string, check long, keep_id long, keep_row long, group_size long")


def _decided(docs: DataFrame) -> DataFrame:
    rows = materialize(_digests(docs), "digests")
    key = F.concat_ws(":", "text_sha256", "check")
    merged = materialize(tree_merge(rows).select(key.alias("k"), "keep_id", "keep_row", "group_size"), "digest-tree")
    found = C.lookup_skewed(rows.select("row", "doc_id", "text_sha256", "own", key.alias("k")), merged, "k", "group_size")
    return found.withColumn("kept", F.col("row") == F.col("keep_row"))


def decide(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    once, key = C.first_of_equal_rows(docs)
    stays = _decided(docs).where("kept").select(F.col("own").alias(key))
    return once.join(stays, key, "left_semi").select(*C.columns(docs))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(C.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
