"""Operator 13, token counts with a whole-token shortcut.

For a vocabulary of words with word ends (byte-level BPE whose last symbol carries a suffix), it is
proved once, before any text is read, which vocabulary strings stand alone as one token: the string
keeps its form when normalised, is a single pre-token, and its own merges end in one symbol. In
texts a pre-token in that set counts one, without merging; only the others are merged, lowest rank
first, over linked symbols with a heap, and remembered in a bounded memo of each worker.

Texts are normalised (NFC, then lower case by character) and split as the vocabulary's file says;
a file that asks for anything else is refused. Strings of special tokens count one each, wherever
they stand, and split the text there, which is the library's default. Characters that this Python's
Unicode tables don't know yet may belong to other classes in the library's: a text with any is split
by the library's own steps.

Null texts are empty and have no tokens. Repeated rows stay, with equal counts; an empty table gives
an empty result. Other columns are ignored, whatever their names, and ``doc_id`` may have any type.
A text is one value in a task, however long; its pre-tokens are counted in pieces of the match
iterator, never held as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy

#: Documents with more tokens are over the limit.
LIMIT = 2048
#: Merged pre-tokens that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 200_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [c for c in range(256) if 33 <= c <= 126 or (161 <= c <= 255 and c != 173)]
    rest = iter(range(256, 512))
    return [chr(c) if c in own else chr(next(rest)) for c in range(256)]


def normal(text: str) -> str:
    """NFC and lower case; a capital sigma is lower-cased without regard to its place in a word."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def _library(pattern: str):
    """The library's own normaliser and split, for characters unknown here."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return lambda text: [piece for piece, _ in split.pre_tokenize_str(steps.normalize_str(text))]


class Vocabulary:
    """What the counts need of a tokenizer file, and the strings proved to be one token."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        kinds = [s["type"] for s in split["pretokenizers"]]
        odd = [t for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or odd or model["continuing_subword_prefix"] or model["unk_token"]:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        if spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:  # white space is dropped by the split, so what replaces it is, too
            raise ValueError("only white space may be replaced")
        self.pattern = split["pretokenizers"][0]["pattern"]["Regex"]
        self.special = "|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], byte_chars()
        self.inner = [vocab.get(c) for c in chars]
        self.last = [vocab.get(c + end) for c in chars]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        of = {c: i for i, c in enumerate(chars)}
        self.whole: list[str] = []
        counts = Counts(self)
        for word in vocab:
            if word.endswith(end) and all(c in of for c in word[: -len(end)]):
                try:
                    s = bytes(of[c] for c in word[: -len(end)]).decode()
                except UnicodeDecodeError:
                    continue  # part of a character
                if normal(s) == s and counts.split(s) == [s] and counts.merge(s) == 1:
                    self.whole.append(s)


class Counts(dict):
    """Number of tokens of a pre-token: proved ones from the start, others once they are merged."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.inner, self.last, self.pairs = vocabulary.inner, vocabulary.last, vocabulary.pairs
        self.most = len(self) + MEMO
        self.split = regex.compile(vocabulary.pattern).findall
        self.each = regex.compile(vocabulary.pattern).finditer
        self.special = regex.compile(vocabulary.special) if vocabulary.special else None
        self.pattern, self.known = vocabulary.pattern, set(map(chr, range(128)))

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= MEMO_CHARS and len(self) < self.most:
            self[piece] = n
        return n

    def merge(self, piece: str) -> int:
        """Symbols left when no neighbours merge any more; pairs merge by rank, then from the left."""
        raw = piece.encode()
        ids = [x for x in (*(self.inner[c] for c in raw[:-1]), self.last[raw[-1]]) if x is not None]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pairs.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them is part of another symbol by now
            ids[i], ids[j], left = new, -1, left - 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if m := pairs.get(new << 32 | ids[j]):
                    heapq.heappush(heap, (*m, i, new, ids[j]))
            if (k := before[i]) >= 0 and (m := pairs.get(ids[k] << 32 | new)):
                heapq.heappush(heap, (*m, k, ids[k], new))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens are one each and part what stands around them."""
        if self.special is None or "<" not in text:
            return self._count(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + self._count(text[at : m.start()])
            at = m.end()
        return n + self._count(text[at:])

    def unknown(self, text: str) -> bool:
        """Whether a text holds characters without a category."""
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.known |= new
        return False

    def _count(self, text: str) -> int:
        if not text.isascii() and self.unknown(text):
            return sum(map(self.__getitem__, _library(self.pattern)(text)))
        text = normal(text)
        if len(text) < 1_000_000:
            return sum(map(self.__getitem__, self.split(text)))
        return sum(self[m.group()] for m in self.each(text))


_HELD: dict[str, Counts] = {}


def _counts(key: str, shared) -> Counts:
    """This worker's counts of a vocabulary; its memo outlives the task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Counts(shared.value)
    return _HELD[key]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text).

    The vocabulary is broadcast: a few MB, bounded by its file.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        raw = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(Vocabulary(json.loads(raw))), hashlib.sha256(raw).hexdigest()

    @tidy
    def each(batches):
        counts = _counts(key, shared)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n = [counts.count(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    d = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    long = T.LongType()
    out = d.mapInArrow(each, T.StructType([d.schema["doc_id"], T.StructField("n_bytes", long), T.StructField("n_tokens", long)]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"))
