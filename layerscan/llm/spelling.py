"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary of the corpus is counted first, with sums inside the tasks. Its words go into
blocked Bloom filters, one shard for each length. Then every word throws its edits at the
shards: replacements at that of its own length, deletions at that of one less. An insertion is another
word's deletion, and a replacement by a greater letter another word's by a smaller one, so
these two find each pair once. Only edits that a filter lets pass are shuffled, to an exact
join with the vocabulary that takes the false ones out.

Filters are sent to every executor a round at a time. A round has a fixed size; a
vocabulary with larger filters takes more rounds, by length and, for a length with very many
words, by ranges of its blocks. A word's neighbourhood is bounded by its letters, and no
group is gathered anywhere.

A word's form is its commonest neighbour, if that is commoner by far. Forms lead upwards by a
factor each, so the chains to a root are short and their longest length is known from the counts.

Rows: a null or empty text has no words; a null id is written as an empty one where ids matter.
Repeated rows count again. Words that are equally common are taken in code point order. Words and
texts of any length are taken whole. An empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.session import shared_folder

#: Code points of a word and its occurrences, at least.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How much commoner a form is.
FORM_FACTOR = 10
#: Bits of filter for each word; words of 64 bits in a block; blocks built by one task.
BITS_PER_WORD = 24
LANES = 8
SLICE_BLOCKS = 1 << 11
#: Bytes of filters sent at once.
ROUND_BYTES = 32 << 20
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
#: Edits probed at once.
PROBES = 1 << 18

#: A run of letters in lower case, and which occurrences lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
NOISE = 31

_U = np.uint64


# --- vocabulary -------------------------------------------------------------------


def vocabulary(documents: DataFrame, noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words of ``documents`` (``doc_id``, ``text``).

    A word is a run of letters with A-Z lowered. Where ``noise`` divides the checksum of id and run,
    the occurrence lacks one letter; 0 for none.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a shorter run never becomes longer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                if not text:
                    continue
                named = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    if noise and (check := zlib.crc32(word.encode(), named)) % noise == 0:
                        at = check % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= COUNTED_WORDS:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n"])


# --- filters ----------------------------------------------------------------------


def factors(length: int) -> np.ndarray:
    """An odd 64-bit factor for each place of a word."""
    h = np.arange(1, length + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return (h ^ (h >> _U(31))) | _U(1)


def code_points(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(_U)


def hashes(codes: np.ndarray) -> np.ndarray:
    """A word's hash is the sum of its code points times its places' factors, modulo 2^64."""
    return codes @ factors(codes.shape[1])


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)


def lanes_and_bits(h: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which word of its block a hash sets bits in, and these three bits: the first or the second time."""
    y = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93) >> _U(8 + 21 * second)
    bits = np.zeros(1, _U)
    for shift in (3, 9, 15):
        bits = bits | _U(1) << (y >> _U(shift) & _U(63))
    return (y & _U(LANES - 1)).astype(np.int64), bits


class Shard:
    """The blocks from ``first`` up to ``end`` of the filter of one length, of ``blocks`` in all."""

    def __init__(self, blocks: int, first: int, lanes: np.ndarray):
        self.blocks = blocks
        self.first, self.end = first, first + len(lanes) // LANES
        self.lanes = lanes

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be of words of these blocks."""
        block = block_of(h, self.blocks)
        if self.first > 0 or self.end < self.blocks:
            at = np.flatnonzero((block >= self.first) & (block < self.end))
        else:
            at = np.arange(len(h))
        for second in (False, True):
            lane, bits = lanes_and_bits(h[at], second)
            held = self.lanes[(block[at] - self.first) * LANES + lane]
            at = at[(held & bits) == bits]
        return at


def blocks_for(words: int) -> int:
    return max(1, -(-words * BITS_PER_WORD // (64 * LANES)))


def _slices(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """The filters in slices of ``SLICE_BLOCKS`` blocks: ``length``, ``slice``, ``lanes``."""

    @F.pandas_udf("long")
    def hashed(found: pd.Series) -> pd.Series:
        out = np.empty(len(found), np.int64)
        sizes = found.str.len().to_numpy()
        for size in np.unique(sizes):
            mine = sizes == size
            out[mine] = hashes(code_points(found[mine].tolist(), int(size))).view(np.int64)
        return pd.Series(out)

    @F.pandas_udf("int")
    def slice_of(length: pd.Series, h: pd.Series) -> pd.Series:
        out = np.empty(len(h), np.int64)
        for size in length.unique():
            mine = (length == size).to_numpy()
            out[mine] = block_of(h[mine].to_numpy().view(_U), blocks[size]) // SLICE_BLOCKS
        return pd.Series(out)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        length, number = key
        first = number * SLICE_BLOCKS
        lanes = np.zeros((min(blocks[length], first + SLICE_BLOCKS) - first) * LANES, _U)
        h = rows["h"].to_numpy().view(_U)
        for second in (False, True):
            lane, bits = lanes_and_bits(h, second)
            np.bitwise_or.at(lanes, (block_of(h, blocks[length]) - first) * LANES + lane, bits)
        return pd.DataFrame({"length": [length], "slice": [number], "lanes": [lanes.tobytes()]})

    rows = words.select("length", hashed("word").alias("h"))
    rows = rows.select("length", "h", slice_of("length", "h").alias("slice"))
    return rows.groupBy("length", "slice").applyInPandas(build, "length int, slice int, lanes binary")


def rounds_of(blocks: dict[int, int], round_bytes: int) -> list[list[tuple[int, int, int]]]:
    """The slices (length, first, end) of the filters that are sent together, round by round."""
    most = max(SLICE_BLOCKS, round_bytes // (LANES * 8))
    rounds: list[list[tuple[int, int, int]]] = [[]]
    room = most
    for length, left in sorted(blocks.items()):
        first = 0
        while left:
            if room < min(left, SLICE_BLOCKS):
                rounds.append([])
                room = most
            taken = left if left <= room else room // SLICE_BLOCKS * SLICE_BLOCKS
            end = first + -(-taken // SLICE_BLOCKS)
            rounds[-1].append((length, first, end))
            first, room, left = end, room - taken, left - taken
    return rounds


# --- edits ------------------------------------------------------------------------


def _spread(count: int, each: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``count`` items of ``each`` probes that stay near ``PROBES``."""
    step = max(1, PROBES // max(1, each))
    for low in range(0, count, step):
        yield low, min(count, low + step)


def replacements(words: list[str], length: int, letters: np.ndarray, shard: Shard) -> Iterator[tuple[int, str]]:
    """Words, by number, and what they become by one letter greater in code point order that may be a word."""
    codes = code_points(words, length)
    factor, h = factors(length), hashes(codes)
    flat = codes.ravel()
    for low, high in _spread(flat.size, letters.size):
        word, place = np.divmod(np.arange(low, high), length)
        here = flat[low:high]
        pair, letter = np.nonzero(letters[None, :] > here[:, None])
        edited = h[word[pair]] + (letters[letter] - here[pair]) * factor[place[pair]]
        for n in shard.passes(edited).tolist():
            w, i = int(word[pair[n]]), int(place[pair[n]])
            yield w, words[w][:i] + chr(int(letters[letter[n]])) + words[w][i + 1 :]


def deletions(words: list[str], length: int, shard: Shard) -> Iterator[tuple[int, str]]:
    """Words, by number, and what they become without one letter that may be a word. Of equal letters side by
    side only the first is left out."""
    step = max(1, PROBES // length)
    for low in range(0, len(words), step):
        part = words[low : low + step]
        codes = code_points(part, length)
        factor = factors(length)
        before = np.cumsum(codes * factor, 1) - codes * factor
        shifted = codes[:, 1:] * factor[:-1]
        after = np.zeros_like(codes)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], 1)[:, ::-1]
        other = np.ones(codes.shape, bool)
        other[:, 1:] = codes[:, 1:] != codes[:, :-1]
        word, place = np.nonzero(other)
        for n in shard.passes((before + after)[word, place]).tolist():
            w, i = int(word[n]), int(place[n])
            yield low + w, part[w][:i] + part[w][i + 1 :]


def _candidates(words: DataFrame, letters: np.ndarray, filters: dict[int, Shard]) -> DataFrame:
    """``word``, ``n`` and ``candidate`` of the edits that the filters of one round let pass."""
    shared = words.sparkSession.sparkContext.broadcast(filters)  # ROUND_BYTES at most

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in batch.groupby("length"):
                found, counts = rows["word"].tolist(), rows["n"].to_numpy()
                if length in shared.value:
                    edits = replacements(found, length, letters, shared.value[length])
                    yield from _probed(edits, found, counts)
                if length - 1 in shared.value:
                    edits = deletions(found, length, shared.value[length - 1])
                    yield from _probed(edits, found, counts)

    near = words.filter(F.col("length").between(min(filters), max(filters) + 1))
    return near.mapInPandas(probe, "word string, n long, candidate string")


def _probed(edits: Iterator[tuple[int, str]], words: list[str], counts: np.ndarray) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for at, candidate in edits:
        rows.append((words[at], counts[at], candidate))
        size += len(candidate)
        if size > 1 << 20:
            yield pd.DataFrame(rows, columns=["word", "n", "candidate"])
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["word", "n", "candidate"])


def near_words(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Pairs of words one edit apart, each once: ``word``, ``n``, ``other``, ``other_n``.

    ``words`` has distinct ``word``s with ``n``. It is read more than once, so give a written table.
    """
    spark = words.sparkSession
    sized = words.select("word", "n", F.char_length("word").alias("length"))
    # One row for each length, and one for each letter.
    blocks = {r["length"]: blocks_for(r["count"]) for r in sized.groupBy("length").count().collect()}
    used = sized.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    letters = np.array(sorted(ord(r["letter"]) for r in used.collect() if r["letter"]), _U)
    folder = shared_folder(spark, "spelling")
    _slices(sized, blocks).write.parquet(f"{folder}/filters")
    slices = spark.read.schema("length int, slice int, lanes binary").parquet(f"{folder}/filters")
    if not blocks:
        return sized.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    for number, members in enumerate(rounds_of(blocks, round_bytes)):
        # Lengths between the first and the last are whole.
        wanted = F.col("length").between(members[0][0] + 1, members[-1][0] - 1)
        for length, first, end in (members[0], members[-1]):
            wanted = wanted | ((F.col("length") == length) & F.col("slice").between(first, end - 1))
        built = {(r["length"], r["slice"]): r["lanes"] for r in slices.filter(wanted).collect()}
        filters = {}
        for length, first, end in members:
            size = min(blocks[length], end * SLICE_BLOCKS) - first * SLICE_BLOCKS
            lanes = np.zeros(size * LANES, _U)
            for n in range(first, end):
                if (length, n) in built:  # a slice without words is not there
                    part = np.frombuffer(built[length, n], _U)
                    at = (n - first) * SLICE_BLOCKS * LANES
                    lanes[at : at + len(part)] = part
            filters[length] = Shard(blocks[length], first * SLICE_BLOCKS, lanes)
        _candidates(sized, letters, filters).write.parquet(f"{folder}/candidates/round={number}")
    candidates = spark.read.schema("word string, n long, candidate string").parquet(f"{folder}/candidates")
    exact = words.select(F.col("word").alias("candidate"), F.col("n").alias("other_n"))
    return candidates.drop("round").join(exact, "candidate").withColumnRenamed("candidate", "other")


# --- forms ------------------------------------------------------------------------


def _forms(words: DataFrame, pairs: DataFrame, factor: int) -> DataFrame:
    """``n_near``, ``form`` and ``form_n`` of the words with a neighbour."""
    way = lambda a, n, b, m: F.struct(a.alias("word"), n.alias("n"), b.alias("near"), m.alias("near_n"))
    a, n, b, m = (F.col(c) for c in ("word", "n", "other", "other_n"))
    both = pairs.select(F.inline(F.array(way(a, n, b, m), way(b, m, a, n))))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    return found.select(
        "word",
        "n_near",
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def variants(words: DataFrame, factor: int = FORM_FACTOR, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of a vocabulary (``word``, ``n``).

    ``n_near`` counts the words one edit away. ``form`` is the commonest of them, if it comes ``factor`` times
    as often at least, and ``root`` the end of the chain of forms from the word.
    """
    spark = words.sparkSession
    folder = shared_folder(spark, "spelling")
    words.select("word", "n").write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    _forms(words, near_words(words, round_bytes), factor).write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    most, least = words.agg(F.max("n"), F.min("n")).first()
    # Each form comes `factor` times as often as the word before it: so many steps at most.
    steps = int(math.log(most / least, factor)) + 1 if most else 1
    roots = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for number in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots.write.parquet(f"{folder}/roots-{number}")
        roots = spark.read.parquet(f"{folder}/roots-{number}")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )
