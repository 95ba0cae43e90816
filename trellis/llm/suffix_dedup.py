"""Byte-level substring deduplication with per-shard suffix arrays.

A byte goes if a WIDTH-byte string that covers it also starts anywhere else in the corpus.  Suffix
arrays serve where a repeat is possible at all, which three steps find:

1. every WIDTH-byte window has an anchor, its 64-byte gram of smallest hash; consecutive windows with
   one anchor form a context.  Equal windows have equal anchors, so anchors decide the bucket, and a
   context whose anchor occurs once in the corpus cannot repeat, and one all of whose anchor's contexts
   recur whole (by 128-bit fingerprints) repeats throughout.
2. for the other anchors that recur, the bytes of each distinct context are fetched from one of its documents
   (contexts with equal 128-bit fingerprints are one, with their multiplicity);
3. a bucket's contexts are dealt into shards of at most SHARD bytes.  Each gets a suffix array by
   Larsson-Sadakane refinement (only groups that are not yet unique are sorted again, by doubled
   prefixes), Kasai's common prefixes, and from both the classes of equal windows; the shards' sorted
   classes are merged by binary search.

An anchor that very many documents hold would gather as many different contexts in a bucket; each window
of such a hot anchor (found on a sample, see ``common.hot_keys``) is a context of its own, dealt by its
first and last gram.  Contexts that recur within a unit of work are settled there: they leave one record, so groups of any
number of copies cost one record a unit.

Defined results: null counts as empty; texts under WIDTH bytes lose nothing; very long texts are worked on
whole, in a unit of their own; every row is a document, so rows that repeat, with or without their doc_id,
lose every WIDTH-byte string, as any text with a copy does; there are no ties, since order plays no part;
null ids are ids like others; empty tables give empty results; other columns, whatever their names, pass
through, and results take names that are free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trellis.llm import common as C
from trellis.llm import textnp as T
from trellis.llm.common import expand, same_as_previous, squeeze
from trellis.llm.substring_index import REMOVED, covered, cut_rows, removal_rows, row_batch
from trellis.session import materialize

WIDTH = 200
GRAM = 64
UNIT_BYTES = 6 << 20
BUCKET_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
SHARD = 1 << 20
_U = np.uint64
_ROW = "b long, kind int, blob binary"
CONTEXT, FETCH, MEMBERS, BYTES = 10, 11, 12, 13


# ---- suffix arrays ---------------------------------------------------------------------------


def big_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(WIDTH + 8, np.uint8)))
    out = np.zeros(len(data) + WIDTH, _U)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(out)]
    return out


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each position), by Larsson-Sadakane refinement from eight-byte prefixes."""
    n = len(data)
    words = (big_words(data) if words is None else words)[:n]
    sa = np.argsort(words, kind="stable")
    first = ~same_as_previous(words[sa])
    # positions whose eight bytes pass the end differ from equal ones by their length
    short = np.arange(max(0, n - 7), n)
    at = np.flatnonzero(np.isin(sa, short))
    first[at] = True
    first[at[at + 1 < n] + 1] = True
    if len(at):  # a shorter suffix comes first among equal keys
        key = np.minimum(n - sa, 8)
        sa = sa[np.lexsort((key, words[sa]))]
        first = ~same_as_previous(words[sa], np.minimum(n - sa, 8))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 8
    while True:
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa, rank
        pos = sa[slots]
        after = pos + h
        k2 = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        k1 = rank[pos]
        order = np.argsort(k1 * np.int64(n + 1) + k2 + 1, kind="stable")
        pos, k1, k2 = pos[order], k1[order], k2[order]
        sa[slots] = pos
        fresh = ~same_as_previous(k1, k2)
        first[slots] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2


def common_prefixes(words: np.ndarray, sa: np.ndarray, rank: np.ndarray, start: np.ndarray, length: np.ndarray, cap: int = WIDTH) -> np.ndarray:
    """For each position the common prefix with its predecessor in the suffix array, at most cap (Kasai).

    The contexts run in lockstep: within each, a position's prefix is at least the last one's less one.
    """
    n = len(sa)
    out = np.zeros(n, np.int64)
    h = np.zeros(len(start), np.int64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    for j in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -j, side="left"))
        pos = start[:live] + j
        r = rank[pos]
        before = sa[np.maximum(r - 1, 0)]
        cur = np.maximum(h[:live] - 1, 0)
        cur[r == 0] = 0
        todo = np.flatnonzero(r > 0)
        while len(todo):
            x, y = pos[todo] + cur[todo], before[todo] + cur[todo]
            limit = np.minimum(n - x, n - y)
            d = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
            same = np.full(len(todo), 8)
            odd = d != 0
            if odd.any():
                same[odd] = 7 - (np.frexp(d[odd].astype(np.float64))[1] - 1) // 8
                # the float may round up to the next power of two: check the byte found
                lead = d[odd] >> (_U(8) * (_U(7) - same[odd].astype(_U)))
                same[odd] += (lead == 0).astype(same.dtype)
            same = np.minimum(same, np.maximum(limit, 0))
            cur[todo] = np.minimum(cur[todo] + same, cap)
            todo = todo[(same == 8) & (cur[todo] < cap)]
        h[:live] = cur
        out[pos] = cur
    return out


def precedes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sign of comparing the WIDTH bytes from a with those from b: -1, 0 or 1."""
    out = np.zeros(len(a), np.int8)
    todo = np.arange(len(a))
    for k in range(0, WIDTH, 8):
        x, y = words[a[todo] + k], words[b[todo] + k]
        odd = x != y
        out[todo[odd]] = np.where(x[odd] < y[odd], -1, 1)
        todo = todo[~odd]
        if not len(todo):
            break
    return out


def find_sorted(words: np.ndarray, table: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the probes' windows among the table's sorted windows, and which are equal there."""
    lo, hi = np.zeros(len(probe), np.int64), np.full(len(probe), len(table))
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        less = precedes(words, table[mid], probe[open_]) < 0
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    equal = np.zeros(len(probe), bool)
    inside = lo < len(table)
    equal[inside] = precedes(words, table[lo[inside]], probe[inside]) == 0
    return lo, equal


def repeated_windows(data: np.ndarray, length: np.ndarray, copies: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Mask over the bytes of concatenated contexts: a WIDTH-byte window starts here and elsewhere too."""
    words = big_words(data)
    start = np.cumsum(length) - length
    starts_window = np.ones(len(data), bool)
    starts_window[T.spread(start + np.maximum(length - WIDTH + 1, 0), np.minimum(length, WIDTH - 1))] = False
    weight = np.repeat(copies, length)
    repeated = np.zeros(len(data), bool)
    classes: list[tuple[np.ndarray, np.ndarray]] = []  # of each shard: windows and their class
    merged, total = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted distinct windows, their number
    owner = np.zeros(len(data), np.int64)  # of a window: the position that stands for its class
    cut = np.searchsorted(np.cumsum(length), np.arange(shard, int(length.sum()) + shard, shard))
    for lo, hi in zip([0, *cut], [*cut, len(length)], strict=True):
        if lo >= hi:
            continue
        base, top = int(start[lo]), int(start[hi - 1] + length[hi - 1])
        w = words[base : top + WIDTH].copy()
        part = data[base:top]
        w[max(0, top - base - 7) :] = big_words(part)[max(0, top - base - 7) :]
        sa, rank = suffix_array(part, w)
        lcp = common_prefixes(w, sa, rank, start[lo:hi] - base, length[lo:hi])
        group = np.cumsum(lcp[sa] < WIDTH)
        ok = starts_window[base:top][sa]
        pos, group = sa[ok] + base, group[ok]
        if not len(pos):
            continue
        first = np.flatnonzero(~same_as_previous(group))
        count = np.add.reduceat(weight[pos], first)
        stands = pos[first]
        owner[pos] = np.repeat(stands, np.diff(np.append(first, len(pos))))
        at, equal = find_sorted(words, merged, stands)
        total[at[equal]] += count[equal]
        alias = np.arange(len(stands))
        owner[pos] = np.where(np.repeat(equal, np.diff(np.append(first, len(pos)))), np.repeat(np.append(merged, 0)[np.where(equal, at, len(merged))], np.diff(np.append(first, len(pos)))), owner[pos])
        new = alias[~equal]
        merged, total = np.insert(merged, at[new], stands[new]), np.insert(total, at[new], count[new])
        classes.append((pos, owner[pos]))
    number = np.zeros(len(data), np.int64)
    number[merged] = total
    for pos, own in classes:
        repeated[pos] = number[own] > 1
    return repeated


# ---- Spark steps -----------------------------------------------------------------------------


def anchored_windows(texts: list[bytes]):
    """Per block of texts: the block, its grams' hashes, and each window's start, text and anchor place."""
    for lo, hi in T.blocks(texts, BLOCK_BYTES):
        block = T.Block(texts[lo:hi])
        grams = T.Rolling(T.byte_values(2)[block.data]).fixed(GRAM)
        place = T.sliding_argmin(grams, WIDTH - GRAM + 1)
        m = np.maximum(block.length - WIDTH + 1, 0)
        s, doc = T.spread(block.start, m), np.repeat(np.arange(hi - lo), m)
        if len(s):
            yield lo, block, grams, s, doc, place[s]


def anchors_of(texts: list[bytes]) -> np.ndarray:
    found = [np.unique(grams[p]) for _, _, grams, _, _, p in anchored_windows(texts)]
    return np.concatenate(found) if found else np.zeros(0, _U)


def context_rows(docs: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    def work(batches):
        for t in C.large_batches(batches, limit=UNIT_BYTES):
            texts, ids = T.raw_texts(t["text"]), C.ids_of(t["doc_id"])
            digests = C.row_digests(texts)
            order = np.lexsort((digests, ids))
            ids, digests = ids[order], digests[order]
            texts = [texts[i] for i in order]
            parts = []
            for lo, block, grams, s, doc, p in anchored_windows(texts):
                single = C.member(grams[p], hot) if len(hot) else np.zeros(len(p), bool)
                first = np.flatnonzero(~same_as_previous(doc, p) | single | np.append(False, single[:-1]))
                count = np.diff(np.append(first, len(s)))
                f, alone = s[first], single[first]
                digest = T.slice_hashes(block.data, f, f + count + WIDTH - 1) ^ T.mix((count * 256 + np.where(alone, 0, p[first] - f)).astype(_U))
                anchor = np.where(alone, T.mix(grams[f] ^ T.mix(grams[f + WIDTH - GRAM])), grams[p[first]])
                parts.append((anchor, digest, doc[first] + lo, f - block.start[doc[first]], count))
            if not parts:
                continue
            anchor, digest, doc, a, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((digest, anchor))
            later = np.zeros(len(by), bool)
            later[by] = same_as_previous(anchor[by], digest[by])
            heads = np.flatnonzero(~later[by])
            number = np.zeros(len(by), np.int64)
            number[by] = np.repeat(np.diff(np.append(heads, len(by))), np.diff(np.append(heads, len(by))))
            rows = []
            i = np.flatnonzero(~later)
            for b, j in C.by_bucket((anchor[i] % _U(n)).astype(np.int64)):
                k = i[j]
                at = ids[doc[k]]
                rows.append((b, CONTEXT, squeeze(anchor[k], digest[k], at[:1], np.diff(at), digests[doc[k]], a[k].astype(np.uint32), count[k].astype(np.uint8), np.minimum(number[k], 2).astype(np.uint8))))
            k = np.flatnonzero(number > 1)
            rows += removal_rows(ids[doc[k]], digests[doc[k]], a[k], count[k], n)
            yield row_batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _ROW)


def recurring_rows(rows: DataFrame, n: int) -> DataFrame:
    """Per bucket, for anchors that recur: which contexts to fetch, and where each occurs."""

    def work(key, t):
        bucket, out, parts = key[0].as_py(), [], []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
            if kind == REMOVED:
                out.append((bucket, REMOVED, blob))
            else:
                parts.append(expand(blob))
        if parts:
            ids = np.concatenate([np.concatenate((p[2], p[2] + np.cumsum(p[3]))) for p in parts])
            anchor, digest, rows, a, count, copies = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 4, 5, 6, 7))
            order = np.lexsort((digest, anchor))
            anchor, digest, ids, rows, a, count, copies = (x[order] for x in (anchor, digest, ids, rows, a, count, copies))
            head = np.flatnonzero(~same_as_previous(anchor))
            each = np.diff(np.append(head, len(anchor)))
            first = np.flatnonzero(~same_as_previous(anchor, digest))
            number = np.add.reduceat(copies.astype(np.int64), first)
            # an anchor whose contexts all recur whole needs no look at the bytes: every window of them repeats
            lowest = np.repeat(np.minimum.reduceat(number, np.searchsorted(first, head)), each)
            k = np.flatnonzero(lowest > 1)
            out += removal_rows(ids[k], rows[k], a[k], count[k], n)
            keep = (lowest == 1) & np.repeat(np.add.reduceat(copies.astype(np.int64), head) > 1, each)
            anchor, digest, ids, rows, a, count, copies = (x[keep] for x in (anchor, digest, ids, rows, a, count, copies))
            if len(anchor):
                new = ~same_as_previous(anchor, digest)
                g = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                number = np.add.reduceat(copies.astype(np.int64), first)
                for d, j in C.by_bucket(C.row_bucket(ids[first], rows[first], n)):
                    k = first[j]
                    out.append((d, FETCH, squeeze(bucket, g[k], ids[k], rows[k], a[k], count[k])))
                out.append((bucket, MEMBERS, squeeze(g, ids, rows, a, count, np.minimum(number, 2))))
        return pa.Table.from_batches([row_batch(out)])

    return rows.groupBy("b").applyInArrow(work, _ROW)


def fetched_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The bytes of the wanted contexts, by the bucket of their anchors."""

    def work(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([row_batch([])])
        t, copy = C.unpacked(left)
        t = t.filter(pa.array(~copy))
        texts, ids = T.raw_texts(t["text"]), C.ids_of(t["doc_id"])
        at = dict(zip(zip(ids.tolist(), C.row_digests(texts).tolist(), strict=True), texts, strict=True))
        out = []
        for blob in right["blob"].to_pylist():
            (bucket,), g, i, row, a, count = expand(blob)
            cut = [at[int(i[k]), int(row[k])][int(a[k]) : int(a[k]) + int(count[k]) + WIDTH - 1] for k in range(len(g))]
            out.append((int(bucket), BYTES, squeeze(g, b"".join(cut))))
        return pa.Table.from_batches([row_batch(out)])

    return C.packed(docs.select("doc_id", "text"), n).groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(work, _ROW)


def repeat_rows(rows: DataFrame, n: int, shard: int = SHARD) -> DataFrame:
    """Per bucket: the suffix arrays' verdict on each context, for all its members."""

    def work(key, t):
        members, fetched = None, []
        for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
            if kind == MEMBERS:
                members = expand(blob)
            else:
                fetched.append(expand(blob))
        g, ids, digests, a, count, copies = members
        first = np.flatnonzero(~same_as_previous(g))
        length = count[first].astype(np.int64) + WIDTH - 1
        order = np.concatenate([x[0] for x in fetched])
        raw = np.frombuffer(b"".join(x[1] for x in fetched), np.uint8)
        repeated = repeated_windows(raw, length[order], copies[order], shard)
        begin = np.zeros(len(first), np.int64)
        begin[order] = np.cumsum(length[order]) - length[order]
        at = T.spread(begin[g], count)
        rec = np.repeat(np.arange(len(g)), count)
        s = T.spread(a.astype(np.int64), count)
        keep = repeated[at]
        rec, s = rec[keep], s[keep]
        new = np.flatnonzero(~(same_as_previous(rec) & (np.diff(s, prepend=-9) == 1)))
        return pa.Table.from_batches([row_batch(removal_rows(ids[rec[new]], digests[rec[new]], s[new], np.diff(np.append(new, len(s))), n))])

    return rows.groupBy("b").applyInArrow(work, _ROW)


def cut_bytes(docs: DataFrame, removals: DataFrame, n: int) -> DataFrame:
    """Docs with four further columns: the kept bytes, the number of bytes, of those removed, and of removed runs."""

    def one(text, start, count, copy):
        if copy and len(text) >= WIDTH:
            return b"", len(text), len(text), 1
        if start is None:
            return text, len(text), 0, 0
        mask = covered(len(text), start, count, WIDTH)
        return np.frombuffer(text, np.uint8)[~mask].tobytes(), len(text), int(mask.sum()), len(T.runs_of(mask)[0])

    results = [("_kept_bytes", S.BinaryType()), ("_n_bytes", S.LongType()), ("_n_removed", S.LongType()), ("_n_spans", S.LongType())]
    return cut_rows(docs, removals, n, results, one)


def remove_repeated_bytes(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    n = C.bucket_count(docs, BUCKET_BYTES)
    found = materialize(recurring_rows(context_rows(docs, n, C.hot_keys(docs, anchors_of)), n), "recurring")
    kind = F.col("kind")
    fetched = fetched_rows(docs, found.where(kind == FETCH).select("b", "blob"), n)
    judged = repeat_rows(fetched.unionByName(found.where(kind == MEMBERS)), n, shard)
    removals = materialize(judged.unionByName(found.where(kind == REMOVED)), "removals")
    return cut_bytes(docs, removals.select("b", "blob"), n)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    cut = remove_repeated_bytes(docs)
    kept, *counts = cut.columns[-4:]
    return cut.select("doc_id", *[F.col(c).alias(x) for c, x in zip(counts, ("n_bytes", "n_removed", "n_spans"), strict=True)], F.sha2(kept, 256).alias("kept_sha256"))


#: Rows, not ids, are the documents.
ORACLE = """
WITH n AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(len(h) // 2 AS BIGINT) AS n_bytes FROM documents
), win AS (
  SELECT r, s, md5(substr(h, 2 * s - 1, 400)) AS k
  FROM (SELECT r, h, unnest(generate_series(1, n_bytes - 199)) AS s FROM n WHERE n_bytes >= 200)
), hit AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
step AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM step),
span AS (SELECT r, min(s) AS a, max(s) + 199 AS b FROM run GROUP BY r, g),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
cut AS (
  SELECT r, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head
  FROM gap JOIN n USING (r) GROUP BY r
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN cut USING (r)
"""
