"""Substring deduplication over a log-structured fingerprint index of word windows.

A window is MIN_WORDS consecutive words of one document.  Its fingerprint has two parts from independent
hashes of its words: 64 bits of its anchor, the 4-word gram of smallest hash within it, and 40 bits over
all its words; a hit must agree in both (104 bits), which verifies it.  Windows that share an anchor
travel as one record, so the exchange costs about seven bytes a word, and the anchor decides the bucket.

The index (``FingerprintIndex``) is a folder of sorted immutable runs.  A run holds, per bucket, the
distinct windows that one batch of documents added, by anchor and fingerprint.  A batch of documents is
sorted likewise, merge-joined with the live runs, and only its new windows are written, as another run;
once TIER runs of like size are live they are compacted into one.  Runs are written bucketed, so a later
batch joins them where they lie: history is read and never shuffled.  The query feeds its table to an
index in BATCHES ascending ranges of doc_id.

An anchor that very many documents hold would make its bucket as large as they are many; the windows of
such hot anchors (found on a sample, see ``common.hot_keys``, and kept beside the runs) are dealt one by
one, by their own hash.  Windows that start earlier within the same unit of work are settled there and not
sent, so a passage that a third of all documents hold is one record a unit of work and not one a document.

Defined results: null text has no words; texts under MIN_WORDS words lose nothing; very long texts are
worked on whole, in a unit of their own; a null doc_id comes before every number; rows of one doc_id are
documents of their own, in the order of the MD5 of their texts; of rows equal in doc_id and text one is the
first and the others come after it, so they lose every window, and one copy of the text is always left;
history precedes what is new; an empty table gives an empty result; other columns, whatever their names,
are passed through, and results take names that are free.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from trellis.llm import common as C
from trellis.llm import textnp as T
from trellis.llm.common import expand, same_as_previous, squeeze
from trellis.session import checkpoint_dir, materialize

MIN_WORDS = 20
GRAM = 4
UNIT_BYTES = 6 << 20
BUCKET_BYTES = 4 << 20
PARTITION_BYTES = 64 << 20
BATCHES = 4
TIER = 3
_U = np.uint64
_FULL = _U(40)
_ROW = "b long, kind int, blob binary"
NEW, REMOVED, RUN = 0, 1, 2


def windows_of(texts: list[bytes]):
    """All windows of the texts in order: anchor hash, full hash (40 bits), text number, start, anchor place."""
    parts = []
    for lo, hi in T.blocks(texts):
        block = T.Block(texts[lo:hi])
        start, end, first = block.words()
        grams = T.Rolling(T.word_hashes(block.data, start, end, 1)).fixed(GRAM)
        place = T.sliding_argmin(grams, MIN_WORDS - GRAM + 1)
        if not len(place):
            continue
        full = T.Rolling(T.word_hashes(block.data, start, end, 2)).fixed(MIN_WORDS) >> (_U(64) - _FULL)
        s = T.spread(first[:-1], np.maximum(np.diff(first) - MIN_WORDS + 1, 0))
        doc = np.repeat(np.arange(hi - lo), np.maximum(np.diff(first) - MIN_WORDS + 1, 0))
        parts.append((grams[place[s]], full[s], doc + lo, s - first[doc], place[s] - first[doc]))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchors_of(texts: list[bytes]) -> np.ndarray:
    return windows_of(texts)[0]


def identity_order(anchor: np.ndarray, full: np.ndarray) -> np.ndarray:
    """A stable order that brings equal windows together."""
    key = anchor ^ T.mix(full)
    order = np.argsort(key, kind="stable")
    k, a, f = key[order], anchor[order], full[order]
    if (same_as_previous(k) & ~same_as_previous(a, f)).any():  # different windows with one key
        order = np.lexsort((full, anchor, key))
    return order


class Run:
    """Distinct windows sorted by anchor and full hash: the distinct anchors, and of each window its anchor's number and its hash."""

    def __init__(self, anchors: np.ndarray, count: np.ndarray, full: np.ndarray):
        self.anchors, self.full = anchors, full
        self.window = (np.repeat(np.arange(len(anchors), dtype=_U), count) << _FULL) | full

    @classmethod
    def of(cls, anchor: np.ndarray, full: np.ndarray) -> Run:
        """From windows sorted by anchor and full hash, without repeats."""
        head = np.flatnonzero(~same_as_previous(anchor))
        return cls(anchor[head], np.diff(np.append(head, len(anchor))), full)

    @classmethod
    def read(cls, blob: bytes) -> Run:
        anchors, count, low = expand(blob)
        return cls(anchors, count, whole_hashes(low, int(count.sum())))

    def write(self) -> bytes:
        count = np.bincount((self.window >> _FULL).astype(np.int64), minlength=len(self.anchors))
        return squeeze(self.anchors, count.astype(np.uint32), low_bytes(self.full))

    def holds(self, anchors: np.ndarray, number: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Which of the sorted probe windows (anchors[number], full) the run holds: a merge join by both parts."""
        if not len(self.window) or not len(number):
            return np.zeros(len(number), bool)
        at = np.minimum(np.searchsorted(self.anchors, anchors), len(self.anchors) - 1)
        known = self.anchors[at] == anchors
        probe = (at.astype(_U)[number] << _FULL) | full
        place = np.minimum(np.searchsorted(self.window, probe), len(self.window) - 1)
        return known[number] & (self.window[place] == probe)

    @staticmethod
    def merge(runs: list[Run]) -> Run:
        anchor = np.concatenate([r.anchors[(r.window >> _FULL).astype(np.int64)] for r in runs])
        full = np.concatenate([r.full for r in runs])
        order = np.lexsort((full, anchor))
        anchor, full = anchor[order], full[order]
        new = ~same_as_previous(anchor, full)
        return Run.of(anchor[new], full[new])


def low_bytes(full: np.ndarray) -> bytes:
    return np.ascontiguousarray(full).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def whole_hashes(low: bytes, n: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return raw.view(_U).ravel()


def removal_rows(ids, digests, start, count, n: int) -> list[tuple[int, int, bytes]]:
    return [(b, REMOVED, squeeze(ids[i], digests[i], start[i].astype(np.uint32), count[i].astype(np.uint32))) for b, i in C.by_bucket(C.row_bucket(ids, digests, n))] if len(ids) else []


def row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["b", "kind", "blob"])


def window_rows(docs: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """Per unit of work: windows to look up, by bucket, and the removals that it settles itself."""

    def work(batches):
        for t in C.large_batches(batches, limit=UNIT_BYTES):
            texts, ids = T.raw_texts(t["text"]), C.ids_of(t["doc_id"])
            digests = C.row_digests(texts)
            order = np.lexsort((digests, ids))
            ids, digests = ids[order], digests[order]
            twin = same_as_previous(ids, digests)
            # copies of a row lose all their windows, which the cut sees to
            anchor, full, doc, s, place = windows_of([b"" if x else texts[i] for i, x in zip(order.tolist(), twin.tolist(), strict=True)])
            single = C.member(anchor, hot)
            anchor[single] = T.mix(anchor[single] ^ full[single])
            by = identity_order(anchor, full)
            gone = np.zeros(len(by), bool)
            gone[by] = same_as_previous(anchor[by], full[by])
            # runs of consecutive windows with one anchor
            new = ~same_as_previous(doc, place) | (np.diff(gone, prepend=False) != 0) | single | np.append(False, single[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(doc)))
            sent = ~gone[first]
            f, c = first[sent], count[sent]
            rows = []
            for b, i in C.by_bucket((anchor[f] % _U(n)).astype(np.int64)) if len(f) else ():
                at = ids[doc[f[i]]]
                rows.append((b, NEW, squeeze(anchor[f[i]], at[:1], np.diff(at), digests[doc[f[i]]], s[f[i]].astype(np.uint32), c[i].astype(np.uint8), low_bytes(full[T.spread(f[i], c[i])]))))
            f, c = first[~sent], count[~sent]
            rows += removal_rows(ids[doc[f]], digests[doc[f]], s[f], c, n)
            yield row_batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _ROW)


def match_rows(rows: DataFrame, n: int, keep_run: bool) -> DataFrame:
    """Per bucket: removals by document bucket and, if wanted, a run of the windows that no live run holds."""

    def work(key, t):
        bucket, out, history, parts = key[0].as_py(), [], [], []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
            if kind == REMOVED:
                out.append((bucket, REMOVED, blob))
            elif kind == RUN:
                history.append(Run.read(blob))
            else:
                parts.append(expand(blob))
        if not parts:
            return pa.Table.from_batches([row_batch(out)])
        ids = np.concatenate([np.concatenate((p[1], p[1] + np.cumsum(p[2]))) for p in parts])
        anchor, digests, start, count = (np.concatenate([p[k] for p in parts]) for k in (0, 3, 4, 5))
        full = whole_hashes(b"".join(p[6] for p in parts), int(count.sum()))
        offset = np.cumsum(count.astype(np.int64)) - count
        order = np.lexsort((start, digests, ids))
        c = count[order].astype(np.int64)
        rec, s, full = np.repeat(order, c), T.spread(start[order], c), full[T.spread(offset[order], c)]
        # sorted by window; equal ones in the order of their places
        anchors, number = np.unique(anchor, return_inverse=True)
        window = (number.astype(_U)[rec] << _FULL) | full
        by = np.argsort(window, kind="stable")
        window, rec, s, full = window[by], rec[by], s[by], full[by]
        later = same_as_previous(window)
        first = np.maximum.accumulate(np.where(later, 0, np.arange(len(window))))
        own = (ids[rec] == ids[rec[first]]) & (digests[rec] == digests[rec[first]]) & (s == s[first])
        gone = later & ~own
        heads = np.flatnonzero(~later)
        of_anchor = (window[heads] >> _FULL).astype(np.int64)
        known = np.zeros(len(window), bool)
        for run in history:
            known[heads] |= run.holds(anchors, of_anchor, full[heads])
        gone |= known[first]
        if keep_run:
            new = ~known[heads]
            if new.any():
                out.append((bucket, RUN, Run.of(anchors[of_anchor[new]], full[heads[new]]).write()))
        rec, s = rec[gone], s[gone]
        back = np.lexsort((s, rec))
        rec, s = rec[back], s[back]
        start_of = np.flatnonzero(~(same_as_previous(rec) & (np.diff(s, prepend=-9) == 1)))
        out += removal_rows(ids[rec[start_of]], digests[rec[start_of]], s[start_of], np.diff(np.append(start_of, len(s))), n)
        return pa.Table.from_batches([row_batch(out)])

    return rows.groupBy("b").applyInArrow(work, _ROW)


def merged_runs(rows: DataFrame) -> DataFrame:
    """Per bucket one run of all its runs' windows."""

    def work(key, t):
        run = Run.merge([Run.read(x) for x in t["blob"].to_pylist()])
        return pa.Table.from_batches([row_batch([(key[0].as_py(), RUN, run.write())])])

    return rows.groupBy("b").applyInArrow(work, _ROW)


def dealt_runs(rows: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """Runs whose windows of newly hot anchors are dealt one by one, as ``window_rows`` deals them."""

    def work(batches):
        for batch in batches:
            out = []
            for b, blob in zip(batch.column("b").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                run = Run.read(blob)
                anchor = run.anchors[(run.window >> _FULL).astype(np.int64)]
                single = C.member(anchor, hot)
                if (~single).any():
                    out.append((b, RUN, Run.of(anchor[~single], run.full[~single]).write()))
                alone, full = T.mix(anchor[single] ^ run.full[single]), run.full[single]
                order = np.lexsort((full, alone))
                alone, full = alone[order], full[order]
                out += [(d, RUN, Run.of(alone[i], full[i]).write()) for d, i in C.by_bucket((alone % _U(n)).astype(np.int64))]
            yield row_batch(out)

    return rows.mapInArrow(work, _ROW)


def covered(size: int, start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Mask of the places that windows of ``width`` cover; count consecutive windows begin at each start."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + count + width - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_rows(docs: DataFrame, removals: DataFrame, n: int, results: list[tuple[str, S.DataType]], one) -> DataFrame:
    """All rows and columns of docs with further columns: one(text, starts, counts, copy) of each row.

    Starts and counts are the row's removed windows (none: None); copy says that an equal row comes first.
    """
    names = [*docs.columns, *C.fresh(docs.columns, *[r[0] for r in results])]
    docs = C.plain(docs)
    schema = S.StructType([*docs.schema.fields, *(S.StructField(x, kind) for x, kind in results)])
    arrow_schema = to_arrow_schema(schema)

    def work(key, left, right):
        if not left.num_rows:
            return arrow_schema.empty_table()
        t, copy = C.unpacked(left)
        texts, ids = T.raw_texts(t["text"]), C.ids_of(t["doc_id"])
        digests = C.row_digests(texts)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            i, g, s, c = (np.concatenate(x) for x in zip(*map(expand, right["blob"].to_pylist()), strict=True))
            order = np.lexsort((s, g, i))
            i, g, s, c = i[order], g[order], s[order], c[order]
            cuts = np.flatnonzero(~same_as_previous(i, g))
            for lo, hi in zip(cuts, [*cuts[1:], len(i)], strict=True):
                found[int(i[lo]), int(g[lo])] = s[lo:hi].astype(np.int64), c[lo:hi].astype(np.int64)
        rows = [one(x, *found.get((i, g), (None, None)), k) for x, i, g, k in zip(texts, ids.tolist(), digests.tolist(), copy.tolist(), strict=True)]
        columns = [*t.columns, *(pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), list(arrow_schema)[t.num_columns :], strict=True))]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    return C.packed(docs, n).groupBy("b").cogroup(removals.groupBy("b")).applyInArrow(work, schema).toDF(*names)


def cut_documents(docs: DataFrame, removals: DataFrame, n: int) -> DataFrame:
    """Docs with three further columns: the kept words, the number of words, and of those removed."""

    def one(text, start, count, copy):
        words = text.split()
        size = len(words)
        if copy and size >= MIN_WORDS:
            return "", size, size
        if start is not None:
            gone = covered(size, start, count, MIN_WORDS)
            words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
        return b" ".join(words).decode(), size, size - len(words)

    return cut_rows(docs, removals, n, [("_kept_text", S.StringType()), ("_n_words", S.LongType()), ("_n_removed", S.LongType())], one)


class FingerprintIndex:
    """A persistent index: ``add`` deduplicates a batch of documents against all earlier batches.

    ``path`` holds the runs, and everything else follows from the folder's listing, so an index can be
    reopened by another session.  A run is named by the first and last batch it covers; a run within a
    larger one's range has been compacted and is no longer live (a crash may leave both).  ``buckets`` and
    the partitions they lie in are fixed by the first opening, as are hot anchors until a batch brings
    more, when the runs are dealt anew.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, partitions: int | None = None, tier: int = TIER):
        self.spark, self.path, self.tier = spark, path.rstrip("/"), tier
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        known = [x for x in self._listing() if x.startswith("buckets-")]
        if known:
            self.n, self.partitions = (int(x) for x in known[0].split("-")[1:])
        else:
            self.n = buckets
            self.partitions = partitions or min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
            self.fs.mkdirs(self._at(f"buckets-{self.n}-{self.partitions}"))
        self.live = self._live()
        self.hot = self._hot()

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listing(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def _live(self) -> list[tuple[int, int, str]]:
        done = [x for x in self._listing() if x.startswith("run-") and self.fs.exists(self._at(f"{x}/_SUCCESS"))]
        runs = sorted((int(x.split("-")[1]), int(x.split("-")[2]), x) for x in done)
        return [r for r in runs if not any(o[0] <= r[0] and r[1] <= o[1] and (o[1] - o[0], o[2]) > (r[1] - r[0], r[2]) for o in runs)]

    def _hot(self) -> np.ndarray:
        found = [x for x in self._listing() if x.startswith("hot-") and self.fs.exists(self._at(f"{x}/_SUCCESS"))]
        if not found:
            return np.zeros(0, _U)
        rows = self.spark.read.schema("k long").parquet(f"{self.path}/{found[-1]}").collect()  # at most HOT_KEYS a batch
        return np.sort(np.array([r["k"] for r in rows], np.int64).view(_U))

    def _write(self, rows: DataFrame, first: int, last: int) -> tuple[int, int, str]:
        """Write a run bucketed by b, so that reading it needs no exchange; sorted by kind, so that pages are skipped."""
        name = f"run-{first:06d}-{last:06d}-{uuid.uuid4().hex}"
        table = f"trellis_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.partitions, "b").sortBy("kind").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # external: the files stay
        return first, last, name

    def _read(self, run: tuple[int, int, str]) -> DataFrame:
        table = f"trellis_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({_ROW}) USING parquet CLUSTERED BY (b) SORTED BY (kind) INTO {self.partitions} BUCKETS LOCATION '{self.path}/{run[2]}'")
        rows = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return rows

    def history(self) -> list[DataFrame]:
        return [self._read(r).where(F.col("kind") == RUN) for r in self.live]

    def warm(self, hot: np.ndarray) -> None:
        """Deal the windows of further hot anchors one by one, those of the live runs included."""
        new = np.setdiff1d(hot, self.hot)
        if not len(new):
            return
        hot = np.union1d(self.hot, new)
        if self.live:
            rows = self.history()
            joined = rows[0]
            for r in rows[1:]:
                joined = joined.unionByName(r)
            run = self._write(merged_runs(dealt_runs(joined, self.n, new).repartition(self.partitions, "b")), self.live[0][0], self.live[-1][1])
            self._replace(len(self.live), run)
        number = len([x for x in self._listing() if x.startswith("hot-")])
        self.spark.createDataFrame([(int(k),) for k in hot.view(np.int64)], "k long").coalesce(1).write.parquet(f"{self.path}/hot-{number:06d}")
        self.hot = hot

    def add(self, docs: DataFrame) -> DataFrame:
        """Docs as of ``cut_documents``, without what earlier batches or earlier documents of this one hold."""
        self.warm(C.hot_keys(docs, anchors_of))
        return cut_documents(docs, self.add_windows(docs), self.n)

    def add_windows(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(b, blob): the removals in a batch, which joins the index unless it is the ``last`` that will be asked."""
        rows = window_rows(docs, self.n, self.hot).repartition(self.partitions, "b")
        for run in self.history():
            rows = rows.unionByName(run)
        matched = match_rows(rows, self.n, keep_run=not last)
        if last:
            return materialize(matched, "removals").select("b", "blob")
        number = self.live[-1][1] + 1 if self.live else 0
        run = self._write(matched, number, number)
        removals = materialize(self._read(run).where(F.col("kind") == REMOVED).select("b", "blob"), "removals")
        self.live.append(run)
        self.compact()
        return removals

    def compact(self) -> None:
        """Merge the last runs while ``tier`` of them cover equally many batches."""
        while len(self.live) >= self.tier and len({b - a for a, b, _ in self.live[-self.tier :]}) == 1:
            rows = self.history()[-self.tier :]
            joined = rows[0]
            for r in rows[1:]:
                joined = joined.unionByName(r)
            self._replace(self.tier, self._write(merged_runs(joined), self.live[-self.tier][0], self.live[-1][1]))

    def _replace(self, last: int, run: tuple[int, int, str]) -> None:
        """A complete run takes the place of the last ones, whose files go."""
        old, self.live = self.live[-last:], [*self.live[:-last], run]
        for _, _, name in old:
            self.fs.delete(self._at(name), True)

    def drop(self) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)
        self.live = []


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """Docs as n or fewer ascending ranges of doc_id of about equal numbers of rows; rows of one doc_id stay together."""
    i = F.col("doc_id").cast("long")
    edges = sorted({int(x) for x in docs.select(i.alias("doc_id")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01)})
    if not edges:
        return [docs]
    out = [docs.where((i < edges[0]) | i.isNull())]
    out += [docs.where((i >= a) & (i < b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [*out, docs.where(i >= edges[-1])]


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Docs as of ``cut_documents``: repeats of earlier windows of the same table removed."""
    spark = docs.sparkSession
    partitions = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, C.input_bytes(docs) // PARTITION_BYTES)))
    n = max(partitions, C.bucket_count(docs, BUCKET_BYTES))
    index = FingerprintIndex(spark, f"{checkpoint_dir(spark)}/trellis-index-{uuid.uuid4().hex}", n, partitions)
    index.warm(C.hot_keys(docs, anchors_of))
    parts = batches_of(docs, batches)
    removals = [index.add_windows(part, last=k == len(parts) - 1) for k, part in enumerate(parts)]
    index.drop()
    found = removals[0]
    for r in removals[1:]:
        found = found.unionByName(r)
    return cut_documents(docs, found, n)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    cut = remove_repeats(docs)
    kept, n_words, n_removed = cut.columns[-3:]
    return cut.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_removed).alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


#: Rows, not ids, are the documents; rows of one id follow in the order of their texts' MD5.
ORACLE = r"""
WITH n AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w, CAST(len(w) AS BIGINT) AS n_words
  FROM documents
), win AS (
  SELECT r, s, md5(array_to_string(w[s : s + 19], ' ')) AS k
  FROM (SELECT r, w, unnest(generate_series(1, n_words - 19)) AS s FROM n WHERE n_words >= 20)
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(s, s + 19)) AS p
  FROM (SELECT r, s, row_number() OVER (PARTITION BY k ORDER BY r, s) AS o FROM win) WHERE o > 1
), words AS (SELECT r, unnest(generate_series(1, n_words)) AS p, unnest(w) AS word FROM n),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM n LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
