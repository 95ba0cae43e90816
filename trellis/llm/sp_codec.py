"""SentencePiece (BPE) encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best piece score first and leftmost on ties; a candidate merge is
skipped for good if a hash keyed by seed, doc_id, the word's place in the document and the merge's place
in the word falls under the dropout rate.  So every occurrence of a word is segmented by itself, any run
repeats it, and other seeds give other segmentations.  With a rate of 0 the ids equal the library's.

The agenda of a word without any dropped merge is the same wherever it stands.  It is kept with the
candidates that it meets; an occurrence whose key drops none of them has just these ids, and only the
others are merged anew.  Words up to LONG symbols are merged together, vectorised, one merge of each word
a round; longer ones go through a heap.  Characters outside the vocabulary fall back to their bytes, and so
does a literal U+2581, which as a piece would read as a blank: every text decodes to itself.

Defined results: null counts as empty; the empty text has no ids; very long texts are encoded whole; equal
texts of one doc_id have equal ids, so rows that repeat do, and a null doc_id is a key like any other; ties
go to the leftmost merge; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.llm import textnp as T

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 2027
LONG = 48
CACHE = 500_000
SLICE = 1 << 15
_MARK = "▁"
_CHUNK = re.compile(rb" *[^ ]+| +")
_NONE = 1 << 30
_U = np.uint64


class Pieces:
    """A model's pieces as merge tables."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        number = {text[i]: i for i in plain}
        if any(_MARK in text[i].lstrip(_MARK) for i in plain):
            raise ValueError("pieces that hold a blank behind other characters are not supported")
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        self.rank = np.full(n, _NONE, np.int64)
        last, place = None, -1
        for i in order:
            if sp.get_score(i) != last:
                last, place = sp.get_score(i), place + 1
            self.rank[i] = place
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.bytes = [b"" if sp.is_control(i) else text[i].replace(_MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte.tolist()):
            self.bytes[i] = bytes([b])
        # symbols: pieces, then characters that occur only within pieces; others are n_known + code point
        letters = sorted({c for i in plain for c in text[i]} - number.keys())
        symbol = number | {c: n + k for k, c in enumerate(letters)}
        self.n = n
        self.known = n + len(letters)
        single = {ord(c): s for c, s in symbol.items() if len(c) == 1 and c != _MARK}
        self.char = np.array(sorted(single), np.int64)
        self.char_symbol = np.array([single[c] for c in self.char.tolist()], np.int64)
        self.mark = symbol[_MARK]
        # symbols of the basic plane's characters, and the pieces of pairs of the commonest ones, directly
        self.plane = self.known + np.arange(1 << 16)
        basic = self.char < 1 << 16
        self.plane[self.char[basic]] = self.char_symbol[basic]
        self.plane[32] = self.mark
        pairs = {}
        for i in plain:
            p = text[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.pairs = pairs
        # a hash table with one pair per slot; slots that several pairs want also look in the sorted list
        self.factor, self.shift = _U(0x9E3779B97F4A7C15), _U(64 - 20)
        slot = ((self.pair.view(_U) * self.factor) >> self.shift).astype(np.int64)
        self.slot_key, self.slot_piece = np.full(1 << 20, -2, np.int64), np.full(1 << 20, -1, np.int64)
        self.slot_key[slot], self.slot_piece[slot] = self.pair, self.pair_piece
        self.crowded = np.bincount(slot, minlength=1 << 20) > 1

    def symbols(self, points: np.ndarray) -> np.ndarray:
        out = self.plane[np.minimum(points, (1 << 16) - 1)]
        far = np.flatnonzero(points >= 1 << 16)
        if len(far):
            at = np.minimum(np.searchsorted(self.char, points[far]), len(self.char) - 1)
            out[far] = np.where(self.char[at] == points[far], self.char_symbol[at], self.known + points[far])
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or -1."""
        key = np.where((a < self.known) & (b < self.known), (a << 20) | b, -1)
        slot = ((key.view(_U) * self.factor) >> self.shift).astype(np.int64)
        out = np.where(self.slot_key[slot] == key, self.slot_piece[slot], -1)
        todo = np.flatnonzero((self.slot_key[slot] != key) & self.crowded[slot])
        if len(todo):
            at = np.minimum(np.searchsorted(self.pair, key[todo]), len(self.pair) - 1)
            out[todo] = np.where(self.pair[at] == key[todo], self.pair_piece[at], -1)
        return out

    def ids(self, symbols: list[int]) -> list[int]:
        """Final ids: characters that are no piece fall back to bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.n:
                out.append(s)
            else:
                raw = chr(s - self.known).encode() if s >= self.known else self._letter(s)
                out.extend(self.byte[b] for b in raw)
        return out

    def _letter(self, s: int) -> bytes:
        return chr(int(self.char[np.flatnonzero(self.char_symbol == s)[0]])).encode()

    def decode(self, ids) -> bytes:
        """The text of a whole document's ids, without the blank that encoding puts in front."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def merge_codes(start, middle, end) -> np.ndarray:
    """A scrambled number for the merge of [start, middle) with [middle, end)."""
    return T.mix(((np.asarray(start).astype(_U) << _U(42)) | (np.asarray(middle).astype(_U) << _U(21)) | np.asarray(end).astype(_U)) + _U(0x632BE59BD9B4E019))


def skipped(key, code, rate: float) -> np.ndarray:
    """Whether the keyed hash drops the merge."""
    most = math.ceil(rate * 2.0**53) << 11  # of 2**64: the upper 53 bits are below the rate
    h = T.mix(np.asarray(key, _U) ^ code)
    return h < _U(most) if most < 1 << 64 else np.ones(np.shape(h), bool)


def place_keys(ids: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """The key of each of a document's ``count`` words."""
    document = T.mix(T.mix(ids.astype(np.int64).view(_U)) ^ T.mix(np.array([seed], np.int64).view(_U)))
    place = T.spread(np.zeros(len(count), np.int64), count)
    return T.mix(np.repeat(document, count) + place.astype(_U))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and the number of each word's."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def segment_long(pieces: Pieces, points: np.ndarray, key: int, rate: float) -> list[int]:
    """Agenda of a single word as a heap over a linked list."""
    sym = pieces.symbols(points.astype(np.int64)).tolist()
    n = len(sym)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < n:
            p = pieces.pairs.get((sym[i] << 20) | sym[j]) if sym[i] < pieces.known and sym[j] < pieces.known else None
            if p is not None and not (rate and skipped(key, merge_codes(i, j, end[j]), rate)):
                heapq.heappush(heap, (int(pieces.rank[p]), i, j, end[j], p))

    with np.errstate(over="ignore"):
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, e, p = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or nxt[i] != j or end[j] != e:
                continue
            sym[i], sym[j] = p, None
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
    return [s for s in sym if s is not None]


def segment(pieces: Pieces, points: np.ndarray, size: np.ndarray, keys: np.ndarray, rate: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words after their agendas are empty, and the number of each word's.

    ``points`` has the words' code points, ``size`` of each word.  ``met`` gathers (word, code) arrays of the
    candidates of words that are not long.
    """
    # symbols of some words, in the order of their completion: words, sizes, values
    done_words, done_sizes, done_values = [], [], []
    long = np.flatnonzero(size > LONG)
    if len(long):
        begin = np.cumsum(size) - size
        for i in long.tolist():
            found = segment_long(pieces, points[begin[i] : begin[i] + size[i]], int(keys[i]), rate)
            done_words.append([i])
            done_sizes.append([len(found)])
            done_values.append(found)
        points = points[np.repeat(size <= LONG, size)]
    short = np.flatnonzero(size <= LONG)
    length = size[short]
    owner = np.repeat(short.astype(np.int32), length)
    sym = pieces.symbols(points.astype(np.int64)).astype(np.int32)
    start = (np.arange(len(sym)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    end = start + np.int32(1)

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (in the upper half) and piece of merging each place with the next one."""
        after = np.minimum(at + 1, len(sym) - 1)
        inside = np.flatnonzero((owner[at] == owner[after]) & (after > at))
        a, b = at[inside], after[inside]
        found = pieces.merged(sym[a].astype(np.int64), sym[b].astype(np.int64))
        k = np.flatnonzero(found >= 0)
        inside, a, b, found = inside[k], a[k], b[k], found[k]
        if rate or met is not None:
            code = merge_codes(start[a], end[a], end[b])
            if met is not None:
                met.append((owner[a], code))
            if rate:
                k = np.flatnonzero(~skipped(keys[owner[a]], code, rate))
                inside, found = inside[k], found[k]
        rank = np.full(len(at), _NONE << 32, np.int64)
        piece = np.full(len(at), -1, np.int32)
        rank[inside], piece[inside] = pieces.rank[found] << 32, found
        return rank, piece

    rank, piece = candidates(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank | np.arange(len(sym)), first)
        done = (best >> 32) == _NONE
        keep = np.ones(len(sym), bool)
        if done.any():
            each = np.diff(np.append(first, len(sym)))
            keep = np.repeat(~done, each)
            done_words.append(owner[first[done]])
            done_sizes.append(each[done])
            done_values.append(sym[~keep])
        at = (best & 0xFFFFFFFF)[~done]
        sym[at], end[at] = piece[at], end[at + 1]
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        kept = np.flatnonzero(keep)
        sym, owner, start, end, rank, piece = (x[kept] for x in (sym, owner, start, end, rank, piece))
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        again = np.flatnonzero(touched)
        rank[again], piece[again] = candidates(again)
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    word, number, values = (np.concatenate(x).astype(np.int64) for x in (done_words, done_sizes, done_values))
    begin, final = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    begin[word] = np.cumsum(number) - number
    final[word] = number
    return values[T.spread(begin, final)], final


class Encoder:
    """Encodes whole texts; what words become without a dropped merge is cached, with the candidates met."""

    def __init__(self, path: str, rate: float = DROPOUT, seed: int = SEED):
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed
        self.odd: dict[int, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        # of all cached words: ids, codes and code points, one word's after another's, and where each word's begin
        self.ids, self.codes, self.points = np.zeros(0, np.uint32), np.zeros(0, _U), np.zeros(0, np.uint32)
        self.ids_at, self.codes_at, self.points_at = (np.zeros(1, np.int64) for _ in range(3))

    def _final(self, values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids instead of symbols: characters that are no piece become their bytes."""
        if not (values >= self.pieces.n).any():
            return values.astype(np.uint32), size
        owner = np.repeat(np.arange(len(size)), size)
        odd = np.flatnonzero(values >= self.pieces.n)
        more = [self.odd.get(v) or self.odd.setdefault(v, self.pieces.ids([v])) for v in values[odd].tolist()]
        room = np.ones(len(values), np.int64)
        room[odd] = [len(m) for m in more]
        out = np.repeat(values, room)
        out[T.spread((np.cumsum(room) - room)[odd], room[odd])] = np.concatenate(more)
        return out.astype(np.uint32), np.bincount(owner, room, len(size)).astype(np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Ids without dropout and the codes of all candidates met; words that are merged on a heap have none."""
        for k in range(0, len(words), SLICE):
            part = words[k : k + SLICE]
            met: list[tuple[np.ndarray, np.ndarray]] = []
            points, length = code_points([w.decode() for w in part])
            with np.errstate(over="ignore"):
                ids, size = self._final(*segment(self.pieces, points, length, np.zeros(len(part), _U), 0.0, met))
            owner, code = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64), np.zeros(0, _U))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            self.ids_at = np.append(self.ids_at, len(self.ids) + np.cumsum(size))
            self.codes_at = np.append(self.codes_at, len(self.codes) + np.cumsum(np.bincount(owner, minlength=len(part))))
            self.ids = np.concatenate((self.ids, ids))
            self.codes = np.concatenate((self.codes, code[np.argsort(owner, kind="stable")]))
            self.points_at = np.append(self.points_at, len(self.points) + np.cumsum(length))
            self.points = np.concatenate((self.points, points))

    def encode(self, texts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; ``ids`` are the documents'."""
        chunks = [_CHUNK.findall(b" " + t) if t else [] for t in texts]
        count = np.array([len(c) for c in chunks], np.int64)
        flat = [w for c in chunks for w in c]
        at = self._numbers(flat)
        keys = place_keys(ids, count, self.seed)
        parts = [self._occurrences(at[k : k + SLICE], keys[k : k + SLICE]) for k in range(0, len(flat), SLICE)]
        values = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)])
        size = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        ends = np.append(0, np.cumsum(size))[np.cumsum(count)]
        return [values[a:b] for a, b in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True)]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the cache, where unknown ones are learnt: each occurrence is looked up once."""
        at = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        todo = np.flatnonzero(at < 0)
        new = {words[k] for k in todo.tolist()}
        if len(self.number) + len(new) > CACHE:
            self._forget()
            new, todo = set(words), np.arange(len(words))
        self._learn(list(new))
        at[todo] = np.fromiter((self.number[words[k]] for k in todo.tolist()), np.int64, len(todo))
        self.lengths = tuple(np.diff(x) for x in (self.ids_at, self.codes_at, self.points_at))
        return at

    def _occurrences(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences of words, by their places in the cache, one after another, and the number of each one's."""
        size = self.lengths[0][at]
        if not self.rate:
            return self.ids[T.spread(self.ids_at[at], size)], size
        many = self.lengths[1][at]
        drop = skipped(np.repeat(keys, many), self.codes[T.spread(self.codes_at[at], many)], self.rate)
        length = self.lengths[2][at]
        anew = length > LONG
        anew[np.searchsorted(np.cumsum(many), np.flatnonzero(drop), "right")] = True
        todo, rest = np.flatnonzero(anew), np.flatnonzero(~anew)
        with np.errstate(over="ignore"):
            points = self.points[T.spread(self.points_at[at[todo]], length[todo])]
            values, number = self._final(*segment(self.pieces, points, length[todo], keys[todo], self.rate))
        size[todo] = number
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[T.spread(begin[todo], number)] = values
        out[T.spread(begin[rest], size[rest])] = self.ids[T.spread(self.ids_at[at[rest]], size[rest])]
        return out, size


def encode(docs: DataFrame, model: str | None = None, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, decoded): ids of every text, and what they decode to."""
    path = model or public_tokenizers.path(MODEL)

    def work(batches):
        coder = Encoder(path, rate, seed)
        for t in C.large_batches(batches, limit=4 << 20):
            ids = coder.encode(T.raw_texts(t["text"]), C.ids_of(t["doc_id"]))
            back = [coder.pieces.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks().cast(pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([b.decode() for b in back], pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model: str | None = None, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, lossless) without carrying ids and texts back to the JVM."""
    path = model or public_tokenizers.path(MODEL)

    def work(batches):
        coder = Encoder(path, rate, seed)
        for t in C.large_batches(batches, limit=4 << 20):
            texts = T.raw_texts(t["text"])
            ids = coder.encode(texts, C.ids_of(t["doc_id"]))
            back = [coder.pieces.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    t["doc_id"].combine_chunks().cast(pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([b == x for b, x in zip(back, texts, strict=True)]),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op7_sentencepiece_dropout(spark, sf_dir: str) -> DataFrame:
    return digest(C.documents(spark, sf_dir))
