"""Token counts against the library."""

import json
import random

import public_tokenizers
import pytest
from catalograph.llm import counts
from tokenizers import Tokenizer

from .helpers import clashing, docs, empty, odd, passage

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbzΣςσİıé́'sStrvemldl0١٣²½ \n\t\xa0 ​<|endoftext|>中日가각😀.,!?-_ǅŉßﬁ\x00\x1c\x1fꟋꟜ\U00032808ퟻ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH) as f:
        return counts.Counts(counts.Vocabulary(json.load(f)))


def _lib(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_strings(library, own):
    r = random.Random(0)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    texts += ["<|endoftext|>a<|startoftext|><|startoftext|>", "x <|endoftext|> 's", "<|ENDOFTEXT|>", "<|endof<|endoftext|>text|>", "don't I'LL we'VE", "a" * 3000, "ab" * 700_000 + " <|endoftext|> " + "!?" * 5000]
    assert [own.count(t) for t in texts] == _lib(library, texts)


def test_whole_tokens_are_one_token_and_no_other_is(library, own):
    """The proved strings are the vocabulary's strings that the library gives one token for."""
    with open(PATH) as f:
        vocabulary = counts.Vocabulary(json.load(f))
    assert len(vocabulary.whole) > 30_000 and set(_lib(library, vocabulary.whole)) == {1}
    ended = [w[: -len("</w>")] for w in library.get_vocab() if w.endswith("</w>") and w.isascii() and w == w.lower()]
    one = {w for w, e in zip(ended, library.encode_batch(ended, add_special_tokens=False)) if len(e.ids) == 1}
    assert one <= set(vocabulary.whole)


def test_table(spark, library):
    df = docs(spark, [(k, passage(k, 3 + 50 * k) + " Don't STOP 123 <|endoftext|> naïvé") for k in range(30)]).unionByName(odd(spark))
    got = sorted(map(tuple, counts.count_tokens(df).collect()), key=repr)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    n = _lib(library, [t for _, t in rows])
    assert got == sorted(((i, len(t.encode()), k, k > 2048) for (i, t), k in zip(rows, n)), key=repr)
    assert {r[3] for r in got} == {True, False}
    assert sorted(map(tuple, counts.count_tokens(clashing(df)).collect()), key=repr) == got
    assert counts.count_tokens(empty(spark)).count() == 0


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    with pytest.raises((ValueError, TypeError, KeyError)):
        counts.Vocabulary(spec)
