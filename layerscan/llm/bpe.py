"""Exact byte-pair encoding without replaying merges, and decoding by an offset table.

Encoding goes left to right. One Aho-Corasick pass notes the longest token that starts at
each byte. The encoder takes it if it may follow the token before, else the longest token
that is a prefix of it; when none is left, it takes back the token before and tries that
one's prefixes. A position found to lead nowhere is never entered again, so the
work is linear in the text. Two tokens may stand side by side exactly if merging the text of
both would leave their border alone; that is looked up in a pair table that fills as it goes.

Decoding gathers from one block of token bytes through a table of offsets.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.llm.tokens import Words

#: A word that needs no cutting.
_ONE_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Answers kept in the table of pairs.
REMEMBERED_PAIRS = 400_000
#: Words as the byte-level tokenizers cut them; white space by its Unicode property.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary: encoder and decoder.

    Inside, a token's number is its rank: bytes first, then merges in their order.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        texts = [bytes([b]) for b in range(256)]
        rank = {text: b for b, text in enumerate(texts)}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = rank[as_bytes(left)], rank[as_bytes(right)]
            text = as_bytes(left + right)
            if text not in rank:
                rank[text] = len(texts)
                texts.append(text)
                self.parts.append(pair)
            self.joined[pair] = rank[text]
        self.length = [len(t) for t in texts]
        in_file = {as_bytes(token): i for token, i in vocabulary.items()}
        file_id = [in_file[t] for t in texts]
        self.id_bytes = [struct.pack("<I", i) for i in file_id]

        self.automaton = ahocorasick.Automaton()
        for number, text in enumerate(texts):
            self.automaton.add_word(text.decode("latin-1"), number)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(t, rank) for t in texts]
        self.may_follow: dict[tuple[int, int], bool] = {}

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_words = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )
        self.word = regex.compile(WORD)
        self.words = Words(self._encode_part, keep_whole=self.special)

        size = 1 + max([*file_id, *self.special.values()])
        of_id = [b""] * size
        for number, text in zip(file_id, texts, strict=True):
            of_id[number] = text
        for content, number in self.special.items():
            of_id[number] = content.encode()
        self.block = np.frombuffer(b"".join(of_id), np.uint8)
        self.sizes = np.array([len(t) for t in of_id], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))

    @staticmethod
    def _longest_prefix(text: bytes, rank: dict[bytes, int]) -> int:
        return next((rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in rank), -1)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border of the two tokens alone.

        Walks back through the merges that made both, latest first; the border would be
        crossed if the pieces that touch it at some time have a merge of their own which
        comes before the next merge that was in fact made.
        """
        before = len(self.parts)
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < before:
                return False
            # Undo the later of the two merges; on equal rank the left one was made first.
            if left > right and left > 255:
                before, left = left, self.parts[left][1]
            elif right > 255:
                before, right = right + 1, self.parts[right][0]
            elif left > 255:
                before, left = left, self.parts[left][1]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        """The answer for a pair that the table doesn't have yet."""
        if len(self.may_follow) >= REMEMBERED_PAIRS:
            self.may_follow.clear()
        known = self.may_follow[left, right] = self._compatible(left, right)
        return known

    def encode_word(self, text: bytes) -> list[int]:
        """Ranks of the tokens of one word."""
        size, length, may_follow = len(text), self.length, self.may_follow
        longest = [-1] * size
        for end, token in self.automaton.iter(text.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # a later end means a longer token
        token = longest[0]
        if length[token] == size:
            return [token]
        usable = bytearray(b"\x01") * (size + 1)
        tokens: list[int] = []
        at, last = 0, -1
        while True:
            end = at + length[token]
            if usable[end]:
                fits = last < 0 or may_follow.get((last, token))
                if fits is None:
                    fits = self._fits(last, token)
                if fits:
                    tokens.append(token)
                    if end == size:
                        return tokens
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:
                usable[at] = 0
                last = tokens.pop()
                at -= length[last]
                token = self.shorter[last]
                last = tokens[-1] if tokens else -1

    def _encode_part(self, text: str) -> bytes:
        id_bytes = self.id_bytes
        if _ONE_WORD.fullmatch(text):
            return b"".join([id_bytes[x] for x in self.encode_word(text.encode())])
        ids: list[bytes] = []
        special = self.special_words and any(x in text for x in self.special)
        for piece in self.special_words.split(text) if special else [text]:
            if piece in self.special:
                ids.append(struct.pack("<I", self.special[piece]))
            elif piece:
                for word in self.word.findall(piece):
                    ids += [id_bytes[x] for x in self.encode_word(word.encode())]
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.words.text(text)

    def decode(self, ids: bytes | None) -> str:
        """Text of such ids; bytes that are no UTF-8 become the replacement character."""
        numbers = np.frombuffer(ids or b"", "<u4")
        if not len(numbers):
            return ""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        where = np.repeat(self.offsets[numbers] - (ends - sizes), sizes)
        where += np.arange(ends[-1])
        return self.block[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(path: str, text: Column) -> Column:
    """Ids of each text as binary: little-endian unsigned 32-bit integers. Null: empty."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(path: str, ids: Column) -> Column:
    """The text of binary ids. Null: empty."""

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([bpe.decode(v) for v in values], dtype=object)

    return texts(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Documents with ``ids`` (binary) and ``decoded`` (string) added.

    Null and empty texts have no ids and an empty decoded text. Rows stay as they are and
    are never moved: repeated ones are encoded again. Columns already called ``ids`` or
    ``decoded`` are replaced; all others are kept.
    """
    coded = documents.withColumn("ids", encode(path, F.col("text")))
    return coded.withColumn("decoded", decode(path, F.col("ids")))
