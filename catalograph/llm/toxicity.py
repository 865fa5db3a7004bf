"""Operator 9, toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Strings are compared by the subsequences of ``LENGTH`` letters that they share, each within
``SPAN`` letters and weighted by ``DECAY`` to the power of the stretch it covers in either string,
so letters that are inserted, replaced or spelled apart cost some weight but not the match. A word
is marked at its ends and its kernel is divided by a norm of its length. Sentences are read in
windows of ``WINDOW`` words; the kernel of two windows is the sum over their pairs of words (a
convolution kernel). Signs inside a word are left out, letters spelled apart are joined and read
in pieces, and longer words in overlapping pieces.

Training is on windows of labelled sentences. A toxic document is known to hold a toxic window
somewhere, a clean one to hold none, so each round takes every document's worst window (at first by
evidence of words and their beginnings, then by the model so far), draws landmark windows of both
classes, maps all windows by the kernel with the landmarks and the inverse root of the landmarks'
own matrix (Nyström), and fits a linear SVM with squared hinge loss; the worst windows of clean
documents pile up from round to round. Every window of every labelled text is scored in each round.
A document scores its worst window, calibrated by a logistic fit on documents.

The model is linear in the subsequences that its landmarks hold, so for scoring the landmarks are
summed up by subsequence, once, into one weight each; a word's value is computed when a worker
first meets it.

Learning uses labelled rows whose crc32 of the doc_id text is not 1 modulo 3, at most
``MOST_TOXIC`` toxic and ``MOST_CLEAN`` clean ones, the first by a hash of their id: the driver gets
one window of each in a round. Scores use the text alone, all of it.

Null or empty texts score like a window without any shared subsequence. Repeated rows stay, with
equal scores; so do very long texts, which are one row in a task like any other. Without labels of
both kinds every score is the share of toxic labels (0 without labels). An empty table gives an
empty result. Of several texts of one id the first in order is learned from. A null ``doc_id`` has no label and counts as held out. Other columns pass through; a
column named ``score`` is replaced.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, tidy

#: Bounds of the labelled sample.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: Letters of a subsequence, the largest distance of its first and last, and the weight of a step.
LENGTH, SPAN, DECAY = 4, 5, 0.8
#: Words of a window.
WINDOW = 3
#: Landmark windows at most, half of each class, and rounds of training.
LANDMARKS, ROUNDS = 512, 3
#: Word beginnings with the most evidence, which find the first round's windows.
SEEDS, BEGINNINGS = 4096, (4, 5, 6)
RIDGE = 3e-4
THRESHOLD = 0.7
#: Letters of a word's piece; longer words are read in pieces that overlap by half.
WIDE = 32
#: Letters spelled apart: how many make a run, and the lengths of its overlapping pieces.
RUN, RUN_PIECES = 4, (6, 9, 14, 22)
#: Subsequences are told apart by so many bits of a hash.
BITS = 18
#: Words that a worker remembers (its first; up to as many more for a while), and characters that it reads at once.
MEMO, CHARS = 100_000, 1_000_000

_SIGNS = re.compile(r"[\W_]+")
_BREAK = "\0"
_STEPS = [(*inner, last) for last in range(LENGTH - 1, SPAN + 1) for inner in itertools.combinations(range(1, last), LENGTH - 2)]


def in_fold(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


# ---------------------------------------------------------------- kernel


def _coded(words: list[str]):
    """Words by length: their places, and code points between two marks."""
    same: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        same.setdefault(len(w), []).append(i)
    for n, at in same.items():
        code = np.ones((len(at), n + 2), np.uint32)
        code[:, 1:-1] = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        code[:, -1] = 2
        yield np.array(at), code


def _hashed(code: np.ndarray):
    """Weight, and hash at each start, of the subsequences of words of one length; weights have norm 1."""
    wide = code.shape[1]
    steps = [(step, DECAY ** (step[-1] + 1)) for step in _STEPS if step[-1] < wide]
    norm = math.sqrt(sum((wide - step[-1]) * weight**2 for step, weight in steps))
    for step, weight in steps:
        n = wide - step[-1]
        h = code[:, :n] * np.uint32(0x9E3779B1)
        for s in step:
            h += code[:, s : s + n]
            h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        yield weight / norm, h >> np.uint32(32 - BITS)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, weight) of each word's subsequences; a word's weights have a norm of its length.

    The kernel of two words is the sum of weight products over equal hashes.
    """
    rows, hashes, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, code in _coded(words):
        for weight, h in _hashed(code):
            rows.append(np.repeat(at, h.shape[1]))
            hashes.append(h.ravel().astype(np.int64))
            weights.append(np.full(h.size, weight))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)


class Landmarks:
    """Landmark windows by subsequence."""

    def __init__(self, windows: list[list[str]]):
        flat = [(i, w) for i, words in enumerate(windows) for w in words]
        row, h, weight = subsequences([w for _, w in flat])
        self.n = len(windows)
        self.row, self.hash, self.weight = np.array([i for i, _ in flat], np.int64)[row] if flat else row, h, weight
        order = np.argsort(h, kind="stable")
        self.by_hash = self.row[order], weight[order]
        self.known, self.begin, self.count = np.unique(h[order], return_index=True, return_counts=True)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros((len(words), self.n), np.float32)
        for i in range(0, len(words) if len(self.known) else 0, 64):  # so that the joined arrays stay small
            part = words[i : i + 64]
            row, h, weight = subsequences(part)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            met = self.known[at] == h
            row, weight, at = row[met], weight[met], at[met]
            n = self.count[at]
            place = np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            slot = np.repeat(row, n) * self.n + self.by_hash[0][place]
            out[i : i + 64] = np.bincount(slot, np.repeat(weight, n) * self.by_hash[1][place], len(part) * self.n).reshape(len(part), self.n)
        return out

    def mapped(self, windows: list[list[str]], root: np.ndarray) -> np.ndarray:
        """Kernel of each window with each landmark, times ``root``: sums over its words."""
        own: dict[str, int] = {}
        at = np.full((len(windows), max([WINDOW, *map(len, windows)])), -1, np.int64)
        for i, words in enumerate(windows):
            at[i, : len(words)] = [own.setdefault(w, len(own)) for w in words]
        words = list(own)
        each = np.zeros((len(own) + 1, self.n), np.float32)  # the last: no word
        for i in range(0, len(words), 1024):
            each[i : i + 1024][: len(words) - i] = self.kernel(words[i : i + 1024]) @ root
        out = np.empty((len(windows), self.n), np.float32)
        for i in range(0, len(windows), 1024):
            out[i : i + 1024] = each[at[i : i + 1024]].sum(1)
        return out

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """Per subsequence: the landmarks summed up with ``alpha``."""
        return np.bincount(self.hash, self.weight * alpha[self.row], 1 << BITS)


# ---------------------------------------------------------------- windows, inside tasks


def letters(word: str) -> str:
    """A lower-cased word without signs."""
    return word if word.isalnum() else _SIGNS.sub("", word)


def pieces(word: str) -> list[str]:
    return [word[i : i + WIDE] for i in range(0, max(1, len(word) - WIDE // 2), WIDE // 2)]


def spelled(run: str) -> list[str]:
    """Readings of letters spelled apart: the whole, and pieces, as letters around a word hide it."""
    return [run[:WIDE]] + [run[i : i + n] for n in RUN_PIECES if len(run) > n for i in [*range(0, len(run) - n, n // 3), len(run) - n]]


class Linear:
    """A word's value by a weight for each subsequence."""

    def __init__(self, weights: np.ndarray):
        self.w = weights.astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for i in range(0, len(words), 8192):  # so that the arrays stay small
            for at, code in _coded(words[i : i + 8192]):
                out[at + i] = sum(weight * self.w[h].sum(1, dtype=np.float64) for weight, h in _hashed(code))
        return out


def beginnings(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    own = [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]
    return [xxhash.xxh3_64_intdigest(k) >> 1 for k in own] if len(word) > 2 else []


class Evidence:
    """A word's value by evidence of its beginnings."""

    def __init__(self, found: dict[int, float]):
        self.found = found

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.array([max((self.found.get(k, 0.0) for k in beginnings(w)), default=0.0) for w in words])


class Reader:
    """Worst windows of texts by ``value``, a function of words; it remembers words."""

    def __init__(self, value):
        self.value = value
        self.at: dict[str, int] = {}
        self.letters: list[str] = []
        self.worth, self.ends, self.single = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)

    def forget(self, keep: int = 0):
        """Drop all words but the first ``keep``."""
        if keep < len(self.letters):
            self.at = dict(itertools.islice(self.at.items(), keep))
        self.letters = self.letters[:keep]
        self.worth, self.ends, self.single = self.worth[:keep], self.ends[:keep], self.single[:keep]

    def look(self, words: list[str]) -> np.ndarray:
        if len(self.at) > 2 * MEMO:
            self.forget(MEMO)
        new = sorted({w for w in words if w not in self.at})
        if new:
            plain = [letters(w) for w in new]
            worth = np.zeros(len(new))
            short = [i for i, w in enumerate(plain) if 0 < len(w) <= WIDE]
            worth[short] = self.value([plain[i] for i in short])
            for i, w in enumerate(plain):
                if len(w) > WIDE:  # it stands for its piece of most worth, in training too
                    own = pieces(w)
                    each = self.value(own)
                    worth[i], plain[i] = each.max(), own[int(each.argmax())]
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.letters += plain
            self.worth = np.concatenate([self.worth, worth])
            self.ends = np.concatenate([self.ends, np.array([w[-1] in ".!?\0" for w in new])])
            self.single = np.concatenate([self.single, np.array([len(w) == 1 for w in plain])])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def read(self, texts: list[str]):
        """Per text: value of its worst window, and (batch's words, first, end) or a reading of it."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > CHARS:
                yield from self._read(held)
                held, size = [], 0
        if held:
            yield from self._read(held)

    def _read(self, texts: list[str]):
        split = [t.lower().replace("\n", " \0 ").split() for t in texts]
        words = [w for s in split for w in (*s, _BREAK)]
        stop = np.cumsum([len(s) + 1 for s in split])
        start = stop - [len(s) + 1 for s in split]
        ids = self.look(words)
        worth, k = self.worth[ids], np.arange(len(ids))
        ends = self.ends[ids]
        first = np.maximum(k - WINDOW + 1, np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), k, 0)))
        value = worth.copy()
        for back in range(1, WINDOW):  # a word counts once in a window
            new = first[back:] <= k[:-back]
            for s in range(back):
                new &= ids[: len(ids) - back] != ids[back - s : len(ids) - s]
            value[back:] += np.where(new, worth[:-back], 0.0)
        most = np.maximum.reduceat(value, start)
        # letters spelled apart
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.single[ids], [False]])))
        said: dict[int, tuple[float, str]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= RUN:
                read = spelled("".join(self.letters[i] for i in ids[a:b]))
                worth = self.value(read)
                j, doc = int(worth.argmax()), int(np.searchsorted(stop, a, "right"))
                if worth[j] > max(most[doc], said[doc][0] if doc in said else -np.inf):
                    said[doc] = float(worth[j]), read[j]
        for doc in range(len(texts)):
            if doc in said:
                yield said[doc][0], [said[doc][1]]
            else:
                yield float(most[doc]), (ids, first, value, start[doc], stop[doc])

    def words_of(self, where) -> list[str]:
        """Words of a window that :meth:`read` gave, before the next batch is read."""
        if isinstance(where, list):
            return where
        ids, first, value, a, b = where
        j = a + int(value[a:b].argmax())
        return [w for w in dict.fromkeys(self.letters[i] for i in ids[first[j] : j + 1]) if w]

    def any_words(self, where, draw: int) -> list[str]:
        """Words of some window of the same text."""
        if isinstance(where, list):
            return []
        ids, first, _, a, b = where
        j = a + draw % (b - a)
        return [w for w in dict.fromkeys(self.letters[i] for i in ids[first[j] : j + 1]) if w]


# ---------------------------------------------------------------- training


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge loss and L2 penalty, by Newton steps on the active rows.

    Rows are read in blocks, so that no other array has their number of rows and columns.
    """
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge * weight.sum())
    penalty[-1] *= 1e-3
    for _ in range(30):
        square, right = np.diag(penalty), np.zeros(n)
        for i in range(0, len(x), 2048):
            z, sign, c = np.hstack([x[i : i + 2048].astype(float), np.ones((len(x[i : i + 2048]), 1))]), y[i : i + 2048], weight[i : i + 2048]
            active = 1 - sign * (z @ w) > 0
            za, ca = z[active], c[active]
            square += (za * ca[:, None]).T @ za
            right += za.T @ (ca * sign[active])
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | f), by Newton steps with smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, z = np.zeros(2), np.stack([f, np.ones_like(f)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(windows: list[list[str]], toxic: np.ndarray, landmarks: list[list[str]]) -> tuple[np.ndarray, float]:
    """Weight of each subsequence, and bias, of the SVM on windows mapped by their landmarks."""
    marks = Landmarks(landmarks)
    value, vector = np.linalg.eigh(marks.mapped(landmarks, np.eye(marks.n, dtype=np.float32)).astype(float))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    sign = np.where(toxic == 1, 1.0, -1.0)
    weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()) * len(sign)
    w, bias = fit_svm(marks.mapped(windows, root.astype(np.float32)), sign, weight)
    return marks.weights(root @ w), bias


@tidy
def _found(batches):
    """Each document's distinct beginnings."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            keys, toxic = [], []
            for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                mine = {k for w in {letters(w) for w in (text or "").lower().split()} for own in pieces(w) for k in beginnings(own)}
                keys += mine
                toxic += [y] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(toxic, pa.int32())], names=["k", "toxic"])


def _worst(value, extra: bool):
    """Mapper: each labelled document's worst window by ``value``, and some other one."""

    def each(batches):
        reader = Reader(value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                f, window, other = [], [], []
                for t, (v, where) in zip(texts, reader.read(texts)):
                    f.append(v)
                    window.append(reader.words_of(where))
                    other.append(reader.any_words(where, zlib.crc32(t.encode())) if extra else [])
                words = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("toxic"), pa.array(f, pa.float64()), pa.array(window, words), pa.array(other, words)], names=["doc", "toxic", "f", "w", "other"])

    return each


class Model:
    """A weight for each subsequence (None: none learned), the bias, and the calibration."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, f) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(f) + self.offset, -50, 50)))


def _evidence(text: DataFrame, scratch: Scratch, share: float) -> dict[int, float]:
    """The beginnings that toxic documents hold too often for chance, with nats of evidence."""
    stats = text.select("text", "toxic").mapInArrow(_found, "k long, toxic int").groupBy("k").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    n = F.col("p") + F.col("q")
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * s))).otherwise(0.0)
    stats = stats.where(F.col("p") > n * share).withColumn("g", part("p", share) + part("q", 1 - share))
    return {r["k"]: r["g"] for r in stats.orderBy(F.desc("g"), "k").limit(SEEDS).collect()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a model on the training fold of ``labels`` (doc_id, toxic) joined with ``docs``."""
    scratch = Scratch(docs.sparkSession, "toxic")
    known = labels.where(~in_fold(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    picked = known.where("toxic = 1").orderBy(order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(order).limit(MOST_CLEAN))
    picked = scratch.store(picked, "picked")
    text = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by the two limits
    text = text.groupBy(F.col("doc_id").cast("string").alias("doc"), "toxic").agg(F.min("text").alias("text"))
    text = scratch.store(text, "texts")
    count = {r["toxic"]: r["count"] for r in text.groupBy("toxic").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    base = Model(None, 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not count.get(1) or not count.get(0):
        return base
    value = Evidence(_evidence(text, scratch, share))
    draw = np.random.default_rng(0)
    clean: list[list[str]] = []  # the worst windows of clean documents so far
    for turn in range(ROUNDS + 1):
        got = text.mapInArrow(tidy(_worst(value, turn == 0)), "doc string, toxic int, f double, w array<string>, other array<string>")
        got = sorted(got.collect(), key=lambda r: r["doc"])  # a row for each document of the sample
        if turn == ROUNDS:
            break
        toxic = [r["w"] for r in got if r["toxic"] == 1 and r["w"]]
        worst = [r["w"] for r in got if r["toxic"] == 0 and r["w"]]
        clean += worst + [r["other"] for r in got if r["toxic"] == 0 and r["other"]]
        if not toxic or not worst:
            return base
        marks = [same[i] for same in (toxic, worst) for i in draw.permutation(len(same))[: LANDMARKS // 2]]
        weights, bias = fit(toxic + clean, np.array([1] * len(toxic) + [0] * len(clean)), marks)
        value = Linear(weights)
    slope, offset = fit_logistic(np.array([r["f"] for r in got]) + bias, np.array([float(r["toxic"]) for r in got]))
    return Model(weights, bias, slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability that ``text`` is toxic."""
    names = [c for c in docs.columns if c != "score"]
    at = names.index("text")

    def each(batches):
        reader = None if model.weights is None else Reader(Linear(model.weights))
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if reader is None:
                    f = np.zeros(part.num_rows)
                else:
                    f = np.array([v for v, _ in reader.read([t or "" for t in part.column(at).to_pylist()])]) + model.bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.probability(f), pa.float64())], names=[*names, "score"])

    d = docs.select(*names)
    return d.mapInArrow(tidy(each), T.StructType([*d.schema.fields, T.StructField("score", T.DoubleType())]))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from the training fold of ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
