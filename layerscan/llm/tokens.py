"""Ids of whole texts, one word at a time, with a memory of words already seen.

A BPE tokenizer that first cuts text into words never joins what lies before a space with
the space. So a text may be cut in front of every space that a visible character follows, and
the parts encoded on their own. Most parts repeat, and a repeated one costs a
dictionary look-up. The memory has a fixed size: it keeps the parts that come first, among which are
the common ones, and starts anew when it has missed very many. Forgetting only costs time.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import lru_cache

#: Parts kept in the memory.
REMEMBERED = 600_000
REMEMBERED_LIBRARY = 600_000
#: A full memory starts anew after so many times its size of parts that it doesn't hold.
STALE = 4
_SAFE = re.compile(r" (?=\S)")
_LINE = re.compile(r"(?<=\S)(?=\n)")
_TAIL = re.compile(r"(.*[A-Za-z])([!-/:-@\[-^`{-~]+)", re.S)
_PLAIN_CASE = re.compile(r"[\x00-į]*")


class _Unsafe(Exception):
    """A part that begins with white space, or has nothing: what lies before it matters."""


class Words(dict):
    """Ids, as bytes, of a space followed by the key.

    ``encode`` gives the ids of any text as bytes. ``fold`` says that the tokenizer lowers
    case anyway, so that all spellings of a word share one entry.
    """

    def __init__(self, encode, keep_whole=(), fold: bool = False, remembered: int = REMEMBERED):
        super().__init__()
        self.encode = encode
        self.keep_whole = tuple(keep_whole)
        self.fold = fold
        self.remembered = remembered
        self.missed = 0
        self.starts: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise _Unsafe
        found = self._ids(part)
        if len(self) < self.remembered:
            self[part] = found
        else:
            self.missed += 1
            if self.missed > STALE * self.remembered:
                self.clear()
                self.starts.clear()
                self.missed = 0
        return found

    def _ids(self, part: str) -> bytes:
        if part.isalpha():
            if self.fold and (low := part.lower()) != part and _PLAIN_CASE.fullmatch(part):
                return self[low]
            return self.encode(" " + part)
        if any(x in part for x in self.keep_whole):
            return self.encode(" " + part)
        if "\n" in part:
            first, *lines = _LINE.split(part)
            if lines:
                return self[first] + b"".join(map(self._start, lines))
        elif tail := _TAIL.fullmatch(part):
            return self[tail[1]] + self._start(tail[2])
        if self.fold and (low := part.lower()) != part and _PLAIN_CASE.fullmatch(part):
            return self[low]
        return self.encode(" " + part)

    def _start(self, text: str) -> bytes:
        """Ids of a text that no space comes before."""
        found = self.starts.get(text)
        if found is None:
            found = self.encode(text)
            if len(self.starts) < self.remembered // 8:
                self.starts[text] = found
        return found

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text; null is taken as empty."""
        if not text:
            return b""
        try:
            return self._joined(text.split(" "))
        except _Unsafe:
            return self._joined(_SAFE.split(text))

    def _joined(self, parts: list[str]) -> bytes:
        rest = iter(parts)
        first = next(rest)
        return b"".join([self.encode(first) if first else b"", *map(self.__getitem__, rest)])


@lru_cache(maxsize=4)
def library_words(path: str, code: str) -> Words:
    """The memory in front of a tokenizer file of the tokenizers library.

    ``code`` is the array type of an id: ``I`` for 32 bits, ``H`` for 16.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    fold = tokenizer.normalizer is not None and "Lowercase" in str(tokenizer.normalizer)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    plain, spelled, before = _plain_words(tokenizer)
    merge = tokenizer.model.tokenize
    as_is = all(chr(c) == s for c, s in spelled.items() if c < 128)  # ASCII letters stand for themselves

    def encode(text: str) -> bytes:
        if plain is not None and text[0] == " " and plain(text, 1):
            word = text[1:] if as_is and text.isascii() else text[1:].translate(spelled)
            return array(code, [t.id for t in merge(before + word)]).tobytes()
        return array(code, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    return Words(encode, added, fold, REMEMBERED_LIBRARY)


def forget() -> None:
    """Drop the memories of this process: for tasks that encode nothing, in workers that have done so before."""
    if library_words.cache_info().currsize:
        library_words.cache_clear()
        gc.collect()


def _plain_words(tokenizer):
    """What words go straight to the model of a byte-level tokenizer: a test for them, how
    their letters are spelled for the model, and what stands for the space before.

    Only letters that the tokenizer's normalizer leaves alone, and that it does not cut between.
    """
    letters = [c for c in map(chr, range(33, 256)) if c.isalpha()]
    if tokenizer.normalizer is not None:
        letters = [c for c in letters if tokenizer.normalizer.normalize_str(c) == c]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str(" " + "".join(letters))
    spelled = {c: tokenizer.pre_tokenizer.pre_tokenize_str("a" + c)[0][0][1:] for c in letters}
    whole = "".join(spelled.values())
    if len(cut) != 1 or not cut[0][0].endswith(whole):
        return None, {}, ""
    plain = re.compile("[" + "".join(letters) + "]+").fullmatch
    return plain, str.maketrans(spelled), cut[0][0].removesuffix(whole)
