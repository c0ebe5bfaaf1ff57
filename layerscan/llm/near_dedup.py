"""Near duplicates by DartMinHash signatures, banded joins and exact checks.

A document is the set of its shingles (five words in a row, lower case; a shorter text is one
shingle). Over each element of weight w lies a region of height w; hashed darts fall on it in
the order of their rank, as many as a Poisson process gives, the same for every document. A
signature coordinate keeps the earliest dart that hits the document's regions; two documents agree
in a coordinate with a chance of their weighted Jaccard similarity. Only about
k (ln k + 2) darts are looked at however large the document is.

Texts are reduced to one each first. Bands of the signature make buckets. In a bucket every
text is compared, exactly and by its whole shingle set, with one leader: the one that meets most
others in its buckets, which in a group of copies is the text they were made from. Links make
classes. Only texts outside the largest class of a bucket then meet others, and by a prefix
filter: ordered from the rarest, similar texts share one of their first shingles, at places
that leave enough of both to share. So a large group costs its size in each bucket, its
pairs are not listed, and yet no two similar texts that share a bucket stay apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.session import shared_folder

WORDS = 5
SIMILARITY = 0.8
#: A pair at the least similarity is missed with a chance of (1 - 0.8^5)^24, or 1 in 13,000.
BANDS, ROWS = 24, 5
SALTS = 8

#: Upper end of the first rank cell; each next cell ends at twice that.
FIRST_CELL = 1 / 64
#: Elements whose darts are thrown at once.
BLOCK = 1 << 17
_GOLDEN = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _even(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """Chances of at most 0, 1, 2, ... darts."""
    chance, total, steps = math.exp(-mean), 0.0, []
    for n in range(int(mean + 12 * math.sqrt(mean) + 24)):
        total += chance
        steps.append(total)
        chance *= mean / (n + 1)
    return np.array(steps)


_STEPS: dict[float, np.ndarray] = {}


def signatures(
    sets: list[np.ndarray], k: int = BANDS * ROWS, weights: list[np.ndarray] | None = None
) -> np.ndarray:
    """A row of the ``k`` earliest darts for each weighted set.

    A set is an array of distinct uint64 elements, at least one; ``weights`` are positive
    (default: one each). All sets go through a rank cell together.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    regions = np.concatenate(sets)
    height = np.ones(len(regions))
    if weights is not None:
        heavy = np.concatenate(weights)
        units = np.ceil(heavy).astype(np.int64)  # regions of height one, the last may be less
        level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        height = np.minimum(np.repeat(heavy, units) - level, 1.0)
        regions = _mix(np.repeat(regions, units) + level.astype(np.uint64) * _U(_GOLDEN))
        owner = np.repeat(owner, units)
    result = np.zeros((len(sets), k), np.uint64)
    reach = k * (math.log(k) + 2) / np.bincount(owner, height, len(sets))
    todo = np.ones(len(sets), bool)
    while todo.any():
        best = np.full(len(sets) * k, np.inf)
        low, high, cell = 0.0, FIRST_CELL, 1
        active = np.flatnonzero(todo[owner])
        found = []
        while len(active):
            if high not in _STEPS:
                _STEPS[high] = _poisson_steps(high - low)
            own = _mix(regions[active] + _U(cell * _GOLDEN % 2**64))
            count = np.searchsorted(_STEPS[high], _even(own), side="right")
            hit = np.flatnonzero(count)
            many = count[hit]
            number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            dart = _mix(np.repeat(own[hit], many) + (number + 1).astype(np.uint64) * _U(_GOLDEN))
            rank = low + (high - low) * _even(_mix(dart + _U(1)))
            source = np.repeat(active[hit], many)
            whose = owner[source]
            inside = rank < reach[whose]
            if weights is not None:
                inside &= _even(_mix(dart + _U(2))) < height[source]
            dart, rank, whose = dart[inside], rank[inside], whose[inside]
            place = whose * k + (_mix(dart + _U(3)) % _U(k)).astype(np.int64)
            np.minimum.at(best, place, rank)
            found.append((place, rank, dart))
            active = active[reach[owner[active]] > high]
            low, high, cell = high, high * 2, cell + 1
        for place, rank, dart in found:
            first = best[place] == rank
            result.reshape(-1)[place[first]] = dart[first]
        # A coordinate without a dart: look twice as far in rank.
        todo &= np.isinf(best.reshape(-1, k)).any(axis=1)
        reach[todo] *= 2
    return result


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    rolled = hashes[: len(words) - size + 1].copy()
    for n in range(1, size):
        rolled *= _U(0x100000001B3)
        rolled ^= hashes[n : len(words) - size + 1 + n]
        rolled = _mix(rolled)
    return np.unique(rolled)


def bands(texts: list[str | None]) -> list[np.ndarray]:
    """One hash (int64) for each band of each text; none for a text without words."""
    result = [np.empty(0, np.int64)] * len(texts)
    sets: list[np.ndarray] = []
    places: list[int] = []

    def settle() -> None:
        rows = signatures(sets).reshape(len(sets), BANDS, ROWS)
        total = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_GOLDEN)
        for n in range(ROWS):
            total = _mix(total ^ rows[:, :, n]) * _U(0x100000001B3)
        for place, hashes in zip(places, total.view(np.int64), strict=True):
            result[place] = hashes
        sets.clear()
        places.clear()

    size = 0
    for place, text in enumerate(texts):
        elements = shingles(text)
        if len(elements):
            sets.append(elements)
            places.append(place)
            size += len(elements) + 256
        if size >= BLOCK:
            settle()
            size = 0
    if sets:
        settle()
    return result


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _doc_key() -> Column:
    """``doc_id``, with the least number for null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _bands_of(text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(bands(texts.tolist()), dtype=object)

    return of(text)


def _shingles_of(text: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    return of(text)


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: lost tasks don't go back further."""
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def _buckets(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``node`` and the node's ``degree`` for every bucket that has two nodes or
    more. A node's degree is how many others it meets in its buckets, summed."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    counts = members.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    shared = _written(_salted(members, counts, ["bucket"]), "buckets")
    degree = shared.groupBy("node").agg(F.sum("many").alias("degree"))
    return _written(shared.join(degree, "node").select("bucket", "node", "degree"), "buckets")


def _salted(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a table that has one row for each key, a frequent key dealt to several tasks."""
    salt = F.pmod(F.xxhash64("node.text_key"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    few = few.withColumn("salt", salts)
    return rows.withColumn("salt", salt).join(few, [*keys, "salt"]).drop("salt")


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingle sets are similar enough."""
    ours = sets.select(F.col("node").alias("a"), F.col("set").alias("ours"))
    theirs = sets.select(F.col("node").alias("b"), F.col("set").alias("theirs"))
    common = F.size(F.array_intersect("ours", "theirs"))
    return (
        pairs.join(ours, "a")
        .join(theirs, "b")
        .select("a", "b", F.size("ours").alias("m"), F.size("theirs").alias("n"), common.alias("c"))
        .filter(F.col("c") >= similarity * (F.col("m") + F.col("n") - F.col("c")))
        .select("a", "b")
    )


def links(documents: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of nodes (``a``, ``b``) whose texts are at least so similar: enough of them to
    connect all that some similar pair in a common bucket connects."""
    buckets = _buckets(nodes)
    texts = documents.select(
        F.struct(_doc_key().alias("first"), _text_key().alias("text_key")).alias("node"), "text"
    )
    sets = _written(
        texts.join(buckets.select("node").distinct(), "node", "left_semi")
        .dropDuplicates(["node"])
        .select("node", _shingles_of("text").alias("set")),
        "shingles",
    )
    rank = F.struct("degree", "node")
    leaders = buckets.groupBy("bucket").agg(F.max_by("node", rank).alias("leader"))
    pairs = (
        _salted(buckets, leaders, ["bucket"])
        .filter(F.col("node") != F.col("leader"))
        .select(F.col("node").alias("a"), F.col("leader").alias("b"))
        .distinct()
    )
    first = _written(_near(pairs, sets, similarity), "links")

    # What is not connected to the largest class of its bucket meets all others there.
    roots = components(first)
    placed = _written(
        buckets.join(roots, "node", "left").select(
            "bucket", "node", F.coalesce("root", "node").alias("root")
        ),
        "buckets",
    )
    held = placed.groupBy("bucket", "root").agg(F.count("*").alias("many"))
    largest = held.groupBy("bucket").agg(
        F.max_by("root", F.struct("many", "root")).alias("largest"), F.count("*").alias("roots")
    ).filter("roots > 1").select("bucket", "largest")
    mixed = _salted(placed, largest, ["bucket"])
    mixed = _written(
        mixed.groupBy("node", "root").agg(
            F.max(F.col("root") != F.col("largest")).alias("outside")
        ),
        "mixed",
    )
    starts = _written(_starts(mixed, sets, similarity), "starts")
    # The first shingle two texts share, in the common order, bounds how many they share.
    needed = similarity / (1 + similarity) * (F.col("m.n") + F.col("o.n"))
    reach = 1 + F.least(F.col("m.n") - F.col("m.at"), F.col("o.n") - F.col("o.at"))
    met = starts.alias("m").join(
        starts.filter("outside").alias("o"),
        (F.col("m.shingle") == F.col("o.shingle"))
        & (F.col("m.root") != F.col("o.root"))
        & (reach + 1e-6 >= needed),
    )
    more = met.select(
        F.least("m.node", "o.node").alias("a"), F.greatest("m.node", "o.node").alias("b")
    ).distinct()
    return first.union(_written(_near(more, sets, similarity), "links"))


def _starts(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each node, as many as similar texts must share one of:
    ``shingle``, its place ``at`` from 1 in order of rarity, and the node's size ``n``."""
    rows = sets.join(nodes, "node").select("node", "root", "outside", F.explode("set").alias("shingle"))
    rarity = rows.groupBy("shingle").agg(F.count("*").alias("nodes"))
    ranked = F.sort_array(F.collect_list(F.struct("nodes", "shingle")))
    ordered = (
        rows.join(rarity, "shingle")
        .groupBy("node", "root", "outside")
        .agg(ranked.alias("ranked"))  # a text's own shingles
        .withColumn("n", F.size("ranked"))
    )
    count = (F.col("n") - F.ceil(F.lit(similarity - 1e-9) * F.col("n")) + 1).cast("int")
    return (
        ordered.select(
            "node", "root", "outside", "n", F.posexplode(F.slice("ranked", F.lit(1), count)).alias("at", "e")
        )
        .filter("e.nodes > 1")
        .select("node", "root", "outside", "n", (F.col("at") + 1).alias("at"), F.col("e.shingle").alias("shingle"))
    )


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected with) of every node in ``pairs``.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to
    the least it knows. Every step is a grouped minimum and a join; a step's edges
    are written to the shared folder.
    """
    edges = _written(_pointed(pairs), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"))
        small = _star(large, F.lit(True))
        edges = _written(small, "edges")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a.text_key", "b.text_key").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _pointed(pairs: DataFrame) -> DataFrame:
    """Each edge once, from the larger node ``a`` to the smaller ``b``."""
    return (
        pairs.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(edges: DataFrame, moved: Column) -> DataFrame:
    """Join each neighbour ``b`` of ``a`` with the least of them all (and ``a``)."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
    kept = edges.filter(moved).withColumn(
        "salt", F.pmod(F.xxhash64("b.text_key"), F.lit(SALTS)).cast("int")
    )
    joined = kept.join(least.withColumn("salt", salts), ["a", "salt"])
    return _pointed(
        joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    )


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``text_key`` and ``class_id`` (the least ``doc_id`` of the class) of every row,
    with ``first``: the ``doc_id`` that stands for the row's text.

    Equal texts are in one class, also empty ones, as which null texts count. Repeated rows get
    a row each. Null ids sort first and give a null ``class_id``. An empty table gives none.
    """
    keyed = _written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            _text_key().alias("text_key"),
            _bands_of("text").alias("bands"),
        ),
        "signatures",
    )
    texts = keyed.groupBy("text_key").agg(
        F.min(_doc_key()).alias("first"), F.first("bands").alias("bands")
    )
    nodes = _written(texts.select(F.struct("first", "text_key").alias("node"), "bands"), "texts")
    roots = components(links(documents, nodes, similarity))
    rooted = _written(
        nodes.select("node").join(roots, "node", "left").select(
            F.col("node.text_key").alias("text_key"),
            F.col("node.first").alias("first"),
            F.coalesce("root", "node").alias("root"),
        ),
        "classes",
    )
    number = F.col("root.first")
    return keyed.select("doc_id", "text_key").join(rooted, "text_key").select(
        "doc_id", "text_key", "first", "root",
        F.when(number != -(1 << 63), number).alias("class_id"),
    )


def keep(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the one with the least ``doc_id``.

    Of rows with the same id and text, one stays.
    """
    found = classes(documents, similarity)
    stays = (
        found.filter((F.col("root.text_key") == F.col("text_key")))
        .select(F.col("first").alias("__doc"), F.col("text_key").alias("__text"))
        .distinct()
    )
    return (
        documents.withColumns({"__doc": _doc_key(), "__text": _text_key()})
        .dropDuplicates(["__doc", "__text"])
        .join(stays, ["__doc", "__text"], "left_semi")
        .select(*documents.columns)
    )
