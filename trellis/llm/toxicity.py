"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

The kernel compares short stretches of text by their common subsequences of three letters that need not
be adjacent: each of the two gaps may skip up to two characters, at a price of DECAY per skipped one, so
inserted or missing letters leave most of an insult's subsequences in place.  A window is a word or two
consecutive words of a sentence, with the blanks around and between them, which count as letters.  Letters are code
points without case, of any script; signs within a word are skipped at no price, a letter
counts at most twice in a row, digits stand for the letters they resemble, and single letters between
blanks are one spelled-out word.  The Nystroem map sends a window to its kernel values with the landmark
windows times the inverse root of the landmarks' kernel matrix, where a squared-hinge machine is trained.
Since both steps are linear in the kernel's features (triples, hashed to 2**BITS places), a fitted model is
one weight per place, and a text is scored in one vectorised pass over its letters.

The machine is trained on labelled sentences, each of which takes part with its window of highest margin:
every sentence of a clean document is a negative; those of a toxic document are positives as far as their
margin goes (0 to 1), as most of them are ordinary, by windows that toxic sentences hold LIFT times as
often as clean ones.  Where that is more often than chance allows (by a likelihood ratio), they count as positives throughout and start the first round.  Sentences
that read alike count once, so copied documents do not pass for evidence, and windows weigh as many
sentences as they stand for, so an insult that some clean documents quote stays one as long as a larger
share of toxic sentences holds it.  The score is a logistic function of the document's largest margin and
of the sum of positive ones, in which a class weighs as the root of its size, so that the rarer one
counts.

Training reads at most SAMPLE labelled rows of at most SAMPLE_CHARS characters and SAMPLE_BYTES in all,
those of smallest hashed id; scoring reads every text whole, and uses nothing but the text.

Defined results: null counts as empty; texts without words get the model's score for no evidence; very
long texts are scored in blocks, a block at a time; equal texts get equal scores, so rows that repeat do,
and their sentences count once in training; ties between windows go to the first; an empty table gives an empty result;
other columns pass through ``clean_documents`` and are ignored by ``score``, whatever their names.  With
no usable labels (none, or of one class only) nothing can be learnt: a warning says so and scores are 0.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.llm import textnp as T

SAMPLE = 4000
SAMPLE_CHARS = 10_000
SAMPLE_BYTES = 8 << 20
BLOCK_BYTES = 1 << 18
LANDMARKS = 192
HARD, PLAIN = 1500, 3000
DECAY = 0.5
REACH = 3
ROUNDS = 4
LIFT = 3.0
BITS = 17
_GAPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
NO_CLASSES = "no labelled documents of both classes: every toxicity score is 0"
_BLANK = 1  # class of blanks; 0 are signs


@functools.cache
def letter_classes() -> np.ndarray:
    """Of every code point of the basic plane its letter without case, 0 for signs and lone accents, 1 for blanks."""
    out = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "Z" or 9 <= cp <= 13:
            out[cp] = _BLANK
        elif kind[0] in "LN" or kind[0] == "M" and not 0x300 <= cp < 0x370:
            out[cp] = min(ord(c.lower()[0]), (1 << 16) - 1)
    for digit, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(digit)] = ord(letter)
    return out


@functools.cache
def places() -> tuple[np.ndarray, ...]:
    """For each place of a triple a random number per letter; a triple's place is their exclusive or."""
    return tuple((T.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(k << 32)) >> np.uint64(64 - BITS)).astype(np.int32) for k in (1, 2, 3))


def triple_places(letters: np.ndarray):
    """(third - first, place) of all triples, by the place of their first letter, for each pattern of gaps."""
    one, two, three = (table[letters] for table in places())
    n = len(letters)
    for a, b in _GAPS:
        m = n - a - b
        if m > 0:
            yield a + b, one[:m] ^ two[a : a + m] ^ three[a + b :]


@dataclass
class Words:
    """The words of a block of texts, each with a blank before and behind it."""

    letters: np.ndarray  # letter classes
    start: np.ndarray  # of each word its first letter
    end: np.ndarray
    first: np.ndarray  # of each text its first word, and one more
    paired: np.ndarray  # whether a word and the next one form a window: both of one sentence
    fresh: np.ndarray  # whether a word begins a sentence

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        block = T.Block([b"", *texts])
        points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        text_end = (np.cumsum((block.data & 0xC0) != 0x80) - 1)[block.end]
        kind = letter_classes()[np.minimum(points, (1 << 16) - 1)]
        far_plane = points >= 1 << 16
        if far_plane.any():
            kind[far_plane] = 2 + points[far_plane] % ((1 << 16) - 2)
        blank = kind == _BLANK
        # a blank between single characters joins them
        far = np.concatenate(([True, True], blank, [True, True]))
        near = ~far
        glue = blank & near[1:-3] & near[3:-1] & far[:-4] & far[4:]
        glue[text_end] = False
        separator = blank & ~glue
        stop = points == 10
        stop[1:] |= np.isin(points[:-1], [33, 46, 63])
        stop[text_end] = True
        # inserted signs vanish, and so does a letter's third repetition
        keep = separator | (kind > _BLANK)
        keep[2:] &= separator[2:] | (kind[2:] != kind[1:-1]) | (kind[1:-1] != kind[:-2])
        text_end = (np.cumsum(keep) - keep)[text_end]
        letters, separator, stop = kind[keep], separator[keep], stop[keep]
        stops = np.cumsum(stop & separator)
        # of a run of blanks one stays
        single = ~separator | np.append(True, ~separator[:-1])
        text_end = np.cumsum(single)[text_end] - 1
        letters, separator, stops = letters[single], separator[single], stops[single]
        edge = np.diff(separator.astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        first = np.searchsorted(start, text_end)
        # a run of blanks carries the stops of all of them at the next word
        apart = np.append(True, stops[start[1:]] != stops[start[:-1]]) if len(start) else np.zeros(0, bool)
        return cls(letters, start, end, first, np.append(~apart[1:], False) if len(start) else apart, apart)

    def margins(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Margins of each word, and of each word with the next one (-inf where they are no window)."""
        if not len(self.start):
            return np.zeros(0), np.zeros(0)
        n = len(self.letters)
        blank = self.letters == _BLANK
        word = np.cumsum(blank, dtype=np.int32)
        until = word - blank  # a blank is the last letter of the word before it, too
        value, norm = np.zeros((2, n)), np.zeros((2, n))
        for c, place in triple_places(self.letters):
            m = len(place)
            apart = until[c:] - word[:m]
            w = DECAY ** (c - 2)
            g = weights[place]
            g *= w
            for k in (0, 1):
                here = apart == k if k else apart <= 0
                value[k, :m] += g * here
                norm[k, :m] += here * (w * w)
        at = self.start - 1
        value, norm = np.add.reduceat(value, at, axis=1), np.add.reduceat(norm, at, axis=1)
        single = np.where(norm[0] > 0, value[0] / np.sqrt(np.maximum(norm[0], 1e-12)), 0.0) + bias
        value, norm = (x[0] + np.append(x[0][1:], 0) + x[1] for x in (value, norm))
        pair = np.where(norm > 0, value / np.sqrt(np.maximum(norm, 1e-12)), 0.0) + bias
        return single, np.where(self.paired, pair, -np.inf)

    def sentences(self) -> np.ndarray:
        """The first word of each sentence."""
        return np.flatnonzero(self.fresh)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the letters of each word, and of each word with the next one."""
        roll = T.Rolling(T.mix(self.letters.astype(np.uint64) + np.uint64(1)))
        return roll(self.start, self.end), roll(self.start, np.append(self.end[1:], self.end[-1:]))


class Windows:
    """Windows as instances: the triples of each, for kernels with a few landmarks."""

    def __init__(self, letters: list[np.ndarray]):
        size = np.array([len(x) for x in letters], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        joined = np.concatenate(letters) if letters else np.zeros(0, np.int32)
        self.n = len(size)
        parts = []
        self.norm = np.zeros(self.n)
        for c, place in triple_places(joined):
            ok = np.flatnonzero(owner[: len(place)] == owner[c:])
            w = DECAY ** (c - 2)
            parts.append((owner[ok], place[ok], np.full(len(ok), w)))
            self.norm += np.bincount(owner[ok], minlength=self.n) * w * w
        self.owner, self.place, self.weight = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.scale = 1 / np.sqrt(np.maximum(self.norm, 1e-12))

    def features(self, columns: np.ndarray) -> np.ndarray:
        """Normalised features (windows x columns) at the sorted places ``columns``."""
        at = np.searchsorted(columns, self.place)
        inside = columns[np.minimum(at, len(columns) - 1)] == self.place
        flat = np.bincount(self.owner[inside] * len(columns) + at[inside], self.weight[inside], self.n * len(columns))
        return flat.reshape(self.n, len(columns)) * self.scale[:, None]


def kernel(a: str, b: str) -> float:
    """The kernel of two windows, not normalised."""
    words = [Words.of([x.encode()]) for x in (a, b)]
    both = Windows([w.letters for w in words])
    columns = np.unique(both.place)
    if not len(columns):
        return 0.0
    f = both.features(columns) / both.scale[:, None]
    return float(f[0] @ f[1])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: np.ndarray  # of (1, largest margin, log(1 + sum of positive margins)), margins to 1 at most

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in T.blocks(texts, BLOCK_BYTES):
            words = Words.of(texts[lo:hi])
            out[lo:hi] = self.logistic(document_evidence(words, *words.margins(self.weights, self.bias)))
        return out

    def logistic(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slope, -30, 30)))


class NoModel:
    """Used where nothing can be learnt: no labels, or of one class only."""

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.zeros(len(texts))


def document_evidence(words: Words, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
    n = len(words.first) - 1
    top, many = np.full(n, -2.0), np.zeros(n)
    some = np.flatnonzero(np.diff(words.first))
    if len(some):
        at = words.first[:-1][some]
        best = np.maximum(single, pair)
        top[some] = np.maximum.reduceat(best, at)
        many[some] = np.add.reduceat(np.clip(best, 0, 1), at)
    return np.column_stack((np.ones(n), np.clip(top, -2, 1), np.log1p(many)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression in which more evidence never lowers the score: no slope is negative."""
    used = np.ones(x.shape[1], bool)
    while True:
        w, z = np.zeros(used.sum()), x[:, used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        out = np.zeros(x.shape[1])
        out[used] = w
        falling = (out < 0) & (np.arange(len(out)) > 0)
        if not falling.any():
            return out
        used &= ~falling


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last coefficient is the bias."""
    x = np.column_stack((z, np.ones(len(z))))
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(60):
        short = 1 - y * (x @ w)
        on = short > 0
        xo, wo = x[on], weight[on]
        grad = ridge @ w - 2 * cost * xo.T @ (wo * y[on] * short[on])
        step = np.linalg.solve(ridge + 2 * cost * (xo * wo[:, None]).T @ xo, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def associations(key: np.ndarray, sentence: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each occurrence of a key the root of its log-likelihood ratio with the labels, and the number of keys.

    Negative unless the share of toxic sentences that hold the key is LIFT times that of clean ones, so words
    that are common where toxic documents happen to be, as a language's are, do not count.  Sentences ascend.
    """
    order = np.argsort(key, kind="stable")
    k, d = key[order], sentence[order]
    head = np.append(True, k[1:] != k[:-1])
    number = np.cumsum(head, dtype=np.int32) - 1
    once = head | np.append(True, d[1:] != d[:-1])
    n = int(number[-1]) + 1 if len(number) else 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    label = toxic[d[once]]
    bad, good = np.bincount(number[once], label, n), np.bincount(number[once], ~label, n)
    del k, d, head, once, label

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    share = (bad + good) / (n1 + n0)
    ratio = part(bad, share * n1) + part(good, share * n0) + part(n1 - bad, (1 - share) * n1) + part(n0 - good, (1 - share) * n0)
    root = (np.sqrt(2 * np.maximum(ratio, 0)) * np.where(bad * n0 >= LIFT * good * n1, 1, -1)).astype(np.float32)
    out = np.empty(len(key), np.float32)
    out[order] = root[number]
    return out, n


class Training:
    """Labelled texts as blocks of words, with the windows of any choice."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray):
        self.blocks = [(lo, Words.of(texts[lo:hi])) for lo, hi in T.blocks(texts, BLOCK_BYTES)]
        self.toxic = toxic
        self.words = np.cumsum([0, *(len(w.start) for _, w in self.blocks)])
        self.doc = np.concatenate([np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first)) + np.int32(lo) for lo, w in self.blocks])
        self.key = np.concatenate([np.concatenate([k.reshape(1, -1) for k in w.keys()]) for _, w in self.blocks if len(w.start)], axis=1) if self.words[-1] else np.zeros((2, 0), np.uint64)
        paired = np.concatenate([w.paired for _, w in self.blocks])
        self.valid = np.stack((np.ones(len(paired), bool), paired))
        self.sentence = np.concatenate([w.sentences() + base for (_, w), base in zip(self.blocks, self.words, strict=False)])
        # sentences that read alike under one label are one, so copied documents count once
        said = [T.Rolling(T.mix(w.letters.astype(np.uint64) + np.uint64(2)))(w.start[s], w.end[np.append(s[1:], len(w.start)) - 1]) for _, w in self.blocks for s in [w.sentences()] if len(s)]
        label = toxic[self.doc[self.sentence]]
        _, self.unlike, same = np.unique(T.mix(np.concatenate(said)) ^ label.astype(np.uint64) if said else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        self.unit = np.repeat(same.astype(np.int32), np.diff(np.append(self.sentence, self.words[-1])))
        self.unit_toxic = label[self.unlike]

    def association(self) -> tuple[np.ndarray, float]:
        """Of all windows the association with the labels, and how much chance reaches among so many."""
        out, keys = np.full(self.valid.shape, -np.inf, np.float32), 0
        for k, valid in enumerate(self.valid):
            out[k, valid], n = associations(self.key[k, valid], self.unit[valid], self.unit_toxic)
            keys += n
        return out, float(np.sqrt(2 * np.log(max(keys, 2))))

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.concatenate([np.stack(w.margins(weights, bias)).astype(np.float32) for _, w in self.blocks], axis=1)

    def best(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The window of highest value in each range of words (the first of equals): word * 2 + whether it has two words."""
        longer = value[1] > value[0]
        top = np.where(longer, value[1], value[0])
        highest = np.maximum.reduceat(top, first)
        size = np.diff(np.append(first, len(top)))
        at = np.flatnonzero(top == np.repeat(highest, size))
        owner = np.searchsorted(first, at, side="right") - 1
        keep = np.append(True, owner[1:] != owner[:-1])
        return at[keep] * 2 + longer[at[keep]]

    def letters(self, window: np.ndarray) -> list[np.ndarray]:
        out = []
        for w in window.tolist():
            word, longer = divmod(w, 2)
            b = int(np.searchsorted(self.words, word, side="right")) - 1
            words, k = self.blocks[b][1], word - int(self.words[b])
            out.append(words.letters[words.start[k] - 1 : words.end[k + longer] + 1])
        return out


def distinct(key: np.ndarray, window: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One window of each key, and the weight of all windows it stands for."""
    _, first, number = np.unique(key[window % 2, window // 2], return_index=True, return_inverse=True)
    return window[first], np.bincount(number, weight, len(first))


def train(texts: list[bytes], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model | NoModel:
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        warnings.warn(NO_CLASSES, stacklevel=2)
        return NoModel()
    data = Training(texts, toxic)
    if not len(data.doc) or not toxic[data.doc].any() or toxic[data.doc].all():
        warnings.warn("no words in the labelled documents of one class: every toxicity score is 0", stacklevel=2)
        return NoModel()
    associated, chance = data.association()
    surely = associated >= min(chance, float(associated[:, data.unit_toxic[data.unit]].max()))
    bad, good = data.unlike[data.unit_toxic], data.unlike[~data.unit_toxic]
    value = associated
    kept, n_kept = np.zeros(0, np.int64), np.zeros(0)
    for r in range(ROUNDS):
        # every distinct sentence by its best window
        top = data.best(value, data.sentence)[good]
        able = np.where(associated > 0, value if r else 0.0, np.float32(-9))
        witness = data.best(np.where(surely, np.maximum(able, 1.0), able), data.sentence)[bad]
        strength = np.where(surely[witness % 2, witness // 2], 1.0, np.clip(able[witness % 2, witness // 2], 0, 1))
        witness, sure = witness[strength > 0], strength[strength > 0]
        positive, n_positive = distinct(data.key, witness, sure)
        negative, n_negative = distinct(data.key, top, np.ones(len(top)))
        score = value[negative % 2, negative // 2]
        order = np.argsort(-score, kind="stable")
        # those that earlier rounds found hard stay
        hard, n_hard = distinct(data.key, np.concatenate((kept, negative[order[:HARD]])), np.concatenate((n_kept, n_negative[order[:HARD]])))
        kept, n_kept = hard, n_hard
        rest = np.sort(order[HARD:])
        plain = negative[rest[:: max(1, len(rest) // PLAIN)]]
        rows = np.concatenate((positive, hard, plain))
        # a negative weighs half as one distinct window of all, half as the sentences that it stands for
        n_rest = np.concatenate((n_hard, np.full(len(plain), n_negative[rest].sum() / max(1, len(plain)))))
        mass = np.concatenate((n_positive / n_positive.sum(), (1 / len(n_rest) + n_rest / n_rest.sum()) / 2))
        y = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        often = positive[np.argsort(-n_positive, kind="stable")]
        few = max(1, landmarks // 4)
        chosen = np.concatenate((often[: landmarks // 2], hard[np.argsort(-value[hard % 2, hard // 2], kind="stable")[:few]], plain[:: max(1, len(plain) // few)][:few]))
        marks = Windows(data.letters(np.unique(chosen)))
        columns = np.unique(marks.place)
        if not len(columns):
            warnings.warn("no word of three letters in the labelled documents: every toxicity score is 0", stacklevel=2)
            return NoModel()
        phi = marks.features(columns)
        values, vectors = np.linalg.eigh(phi @ phi.T)
        good_values = values > 1e-6 * values.max()
        root = vectors[:, good_values] / np.sqrt(values[good_values])
        letters = data.letters(rows)
        z = np.concatenate([Windows(letters[k : k + 256]).features(columns) @ phi.T for k in range(0, len(rows), 256)]) @ root
        w = fit_svm(z, y, mass * len(rows))
        weights = np.zeros(1 << BITS)
        weights[columns] = phi.T @ (root @ w[:-1])
        bias = float(w[-1])
        value = data.margins(weights, bias)
    evidence = np.concatenate([document_evidence(w, *w.margins(weights, bias)) for _, w in data.blocks])
    share = np.where(toxic, toxic.mean(), 1 - toxic.mean())
    return Model(weights, bias, fit_logistic(evidence, toxic.astype(float), 1 / np.sqrt(2 * share)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, label, text) to learn from: at most ``sample`` rows with a remainder other than 0, in order."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0)).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    first = F.xxhash64("id")
    picked = known.orderBy(first, "id", "label").limit(sample)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").alias("own"), "text")
    # a doc_id may stand for many rows, so the bound holds for what is joined, too
    joined = texts.join(F.broadcast(picked), F.col("own") == F.col("id")).select("id", "label", "text")
    return joined.orderBy(first, "id", "label", "text").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | NoModel:
    """Train on ``labelled`` rows.  One task does it, so neither their texts nor the training burden the driver."""

    def work(batches):
        texts, toxic, size = [], [], 0
        for b in batches:
            for text, label in zip(T.raw_texts(b.column("text")), b.column("label").to_pylist(), strict=True):
                size += len(text)
                if size <= SAMPLE_BYTES:
                    texts.append(text)
                    toxic.append(label == 1)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            model = train(texts, np.array(toxic, bool))
        missing = str(said[-1].message) if isinstance(model, NoModel) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([missing], pa.string())], names=["model", "missing"])

    row = labelled(docs, labels, sample).coalesce(1).mapInArrow(work, "model binary, missing string").first()
    missing = NO_CLASSES if row is None else row["missing"]
    if missing:
        warnings.warn(missing, stacklevel=2)
    return NoModel() if missing else pickle.loads(row["model"])


def score(docs: DataFrame, model: Model | NoModel) -> DataFrame:
    """(doc_id, score) of every document."""

    def work(batches):
        for t in C.large_batches(batches, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().cast(pa.int64()), pa.array(model.scores(T.raw_texts(t["text"])))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def clean_documents(docs: DataFrame, model: Model | NoModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    names, docs = docs.columns, C.plain(docs)

    def work(batches):
        for whole in batches:
            for t in C.large_batches([whole], limit=4 << 20):
                keep = model.scores(T.raw_texts(t["text"])) < threshold
                yield from t.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(work, docs.schema).toDF(*names)


def op8_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
