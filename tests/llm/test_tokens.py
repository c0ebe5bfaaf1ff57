"""Ids against the tokenizers library, text by text."""

import hashlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from layerscan.llm import bpe
from layerscan.llm.queries import tokenizer_file
from layerscan.llm.tokens import Words, library_words
from tests.llm import samples

PIECES = st.sampled_from(
    [" ", "\n", "\t", "\r", "  ", "a", "The", "ing", "é", "ß", "İ", "Σ", "J̌", "1", "23", ".", "'s",
     "!", "<|endoftext|>", "\x1c", " ", "\U0001f600", "́", "日本"]
)
TEXTS = st.lists(PIECES, max_size=25).map("".join) | st.text(max_size=30)


def library_ids(name: str, text: str) -> bytes:
    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_backtracking_gives_the_ids_of_the_library(text):
    tokenizer = _cached("byte_bpe_50k.json")
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    vocabulary = bpe.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    assert vocabulary.encode(text) == array("I", ids).tobytes()
    assert vocabulary.decode(vocabulary.encode(text)) == tokenizer.decode(
        ids, skip_special_tokens=False
    )


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(["byte_bpe_50k.json", "word_bpe_49k.json"]))
def test_words_in_front_of_the_library_change_nothing(text, name):
    ids = _cached(name).encode(text, add_special_tokens=False).ids
    assert library_words(tokenizer_file(name), "I").text(text) == array("I", ids).tobytes()


_tokenizers: dict[str, Tokenizer] = {}


def _cached(name: str) -> Tokenizer:
    if name not in _tokenizers:
        _tokenizers[name] = Tokenizer.from_file(tokenizer_file(name))
    return _tokenizers[name]


def test_forgetting_words_changes_nothing():
    seen = []
    words = Words(lambda t: (seen.append(t), t.encode())[1], remembered=2)
    text = "a b c d a b c d"
    assert words.text(text) == text.encode()
    assert words.text(text) == text.encode() and len(words) <= 2


def test_any_ids_decode_as_the_library_does(byte_level):
    vocabulary = bpe.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    for ids in ([200, 220, 50256, 187], [127] * 3, []):
        coded = array("I", ids).tobytes()
        assert vocabulary.decode(coded) == byte_level.decode(ids, skip_special_tokens=False)


def test_round_trip_of_odd_rows(spark, byte_level):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = bpe.round_trip(samples.odd_documents(spark), path).collect()
    assert len(rows) == len(samples.odd_rows())
    for row in rows:
        text = row["text"] or ""
        assert row["decoded"] == text and row["score"] == "taken"
        ids = byte_level.encode(text, add_special_tokens=False).ids
        assert hashlib.sha256(row["ids"]).digest() == hashlib.sha256(array("I", ids)).digest()
    assert bpe.round_trip(samples.no_documents(spark), path).count() == 0
