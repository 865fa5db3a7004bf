"""Operator 10, byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings (one displacement for each
bucket of keys, as many slots as keys, each slot checked against its key) resolves pre-tokens that
are vocabulary entries themselves. Tier two: other pre-tokens are merged over a doubly linked list
of their bytes, with a heap of candidate pairs by (rank, place). Results of pre-tokens are kept in
a bounded memo of each worker.

Null texts are empty and give no tokens. Repeated rows stay, with equal tokens; an empty table gives
an empty result. A text is one value in a task, however long: its ids take up to four times its
bytes, and its decoded bytes as many again. Other columns pass through :meth:`Tokenizer.encode`, and
one named ``ids`` (or ``decoded``) is replaced; :func:`digest` ignores them.
Ids are little-endian: workers are taken to be so too.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, mix, table, tidy

#: Pre-tokens and pairs that a worker remembers, each, where it has other work too, and where it has none (some 200 MB).
MEMO, MEMO_ALONE = 150_000, 800_000
STEP = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank in a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for word, rank in pairs:
        out[int(rank)] = base64.b64decode(word)
    return out


def _mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: :meth:`get` gives a key's index or None.

    Keys fall into buckets by hash; buckets are placed largest first, each by the first displacement
    that sends its keys to free slots. Buckets of one key name a free slot outright (negative).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(size)])
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.full(n, -1, np.int64)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(-size, kind="stable"):
            own = order[begin[b] : begin[b + 1]]
            if len(own) < 2:
                break
            base = np.uint64(0)
            while True:
                slots = (mix(h[own] + (tries + base) * np.uint64(STEP)) % np.uint64(n)).astype(np.int64)
                srt = np.sort(slots, 1)
                good = ~taken[slots].any(1) & (srt[:, 1:] != srt[:, :-1]).all(1)
                if good.any():
                    d = int(good.argmax())
                    self.shift[b] = d + int(base)
                    slot_of[own] = slots[d]
                    taken[slots[d]] = True
                    break
                base += np.uint64(256)
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(size == 1):
            k = order[begin[b]]
            slot_of[k] = next(free)
            self.shift[b] = -1 - slot_of[k]
        self.index = np.empty(n, np.int64)
        self.index[slot_of] = np.arange(n)
        self.keys = [keys[i] for i in self.index]
        self.index = self.index.tolist()
        self.shift = self.shift.tolist()

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -1 - d if d < 0 else _mix(h + d * STEP & MASK) % self.n
        return self.index[slot] if self.keys[slot] == key else None


class Encoder(dict):
    """Memo of pre-token to its ids (little-endian unsigned 32-bit), resolved on first sight."""

    def __init__(self, words: list[bytes], found: PerfectHash, pattern: str, memo: int = MEMO):
        self.words, self.found, self.memo = words, found, memo
        self.split = regex.compile(pattern).findall
        self.byte = [found.get(bytes((i,))) for i in range(256)]
        self.pairs: dict[int, int | None] = {}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.found.get(raw)
        ids = array("I", (whole,) if whole is not None else self.merge(raw)).tobytes()
        if len(self) < self.memo and len(piece) < 64:
            self[piece] = ids
        return ids

    def pair(self, a: int, b: int) -> int | None:
        key = a << 32 | b
        try:
            return self.pairs[key]
        except KeyError:
            rank = self.found.get(self.words[a] + self.words[b])
            if len(self.pairs) < self.memo:
                self.pairs[key] = rank
            return rank

    def merge(self, raw: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until no neighbours make an entry."""
        ids = [self.byte[c] for c in raw]
        n, pair = len(ids), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them has been merged meanwhile
            ids[i], ids[j] = rank, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := pair(rank, ids[j])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[j]))
            if (p := before[i]) >= 0 and (r := pair(ids[p], rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, array("I", ids)))


_HELD: dict[tuple[str, str, int], Encoder] = {}


def _encoder(key: tuple[str, str, int], shared) -> Encoder:
    """This worker's encoder of a vocabulary file and pattern; its memo outlives the task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(*shared.value)
    return _HELD[key]


def _with(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])


class Tokenizer:
    """A vocabulary on the driver, broadcast to tasks: a few MB, bounded by the vocabulary file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, memo: int = MEMO):
        words = read_ranks(path)
        self.shared = spark.sparkContext.broadcast((words, PerfectHash(words), pattern, memo))
        self.key = (hashlib.sha256(b"\0".join(words)).hexdigest(), pattern, memo)

    def encode(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``ids``: the tokens of ``text`` as little-endian unsigned 32-bit integers."""
        docs = docs.drop("ids")
        shared, key, names = self.shared, self.key, docs.columns
        at = names.index("text")

        def each(batches):
            coder = _encoder(key, shared)
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    ids = pa.array([coder.encode(t or "") for t in part.column(at).to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, "ids"])

        return docs.mapInArrow(tidy(each), _with(docs, "ids"))

    def decode(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with ``decoded``: the bytes of ``ids``, null for null."""
        tokens = tokens.drop("decoded")
        shared, key, names = self.shared, self.key, tokens.columns
        at = names.index("ids")

        def each(batches):
            coder = _encoder(key, shared)
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    raw = [None if x is None else coder.decode(x) for x in part.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])

        return tokens.mapInArrow(tidy(each), _with(tokens, "decoded"))

    def digest(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``docs`` (doc_id, text)."""
        shared, key = self.shared, self.key

        def each(batches):
            coder = _encoder(key, shared)
            for b in batches:
                for i in range(0, b.num_rows, 128):
                    part = b.slice(i, 128)
                    n, ids_sha, decoded_sha = [], [], []
                    for text in part.column("text").to_pylist():
                        ids = coder.encode(text or "")
                        n.append(len(ids) // 4)
                        ids_sha.append(hashlib.sha256(ids).hexdigest())
                        decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        d = docs.select("doc_id", "text")
        long, string = T.LongType(), T.StringType()
        return d.mapInArrow(tidy(each), T.StructType([d.schema["doc_id"], T.StructField("n_tokens", long), T.StructField("ids_sha256", string), T.StructField("decoded_sha256", string)]))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, memo: int = MEMO) -> DataFrame:
    """Tokens of ``docs`` (doc_id, text), counted and hashed, and of their decoded bytes.

    Encodes and decodes in one pass, so that ids never leave the worker and only half as many
    workers hold a vocabulary as with :meth:`Tokenizer.encode` and :meth:`Tokenizer.decode`.
    """
    import public_tokenizers

    coder = Tokenizer(docs.sparkSession, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN, memo)
    return coder.digest(docs)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    return digest(table(spark, sf_dir, "documents"), memo=MEMO_ALONE)
