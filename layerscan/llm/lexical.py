"""Ranked lexical search with range-maximum tables over posting lists.

The corpus is dealt into blocks of a fixed number of documents, ordered by id within a block. A
block holds, for each term that a query asks for, a posting list of impacts (what the term adds to a
document's score), and a sparse table over it that gives the place of the greatest impact in any
stretch of the list at once.

A query searches a block best first. An interval of documents is bounded by the sum of its
terms' greatest impacts there. The interval with the highest bound is split at the document
of its greatest single impact: that document is scored exactly, and what lies left and right of
it goes back with new bounds. The search ends when no interval can reach the k-th best score, equal
scores going to the smaller id. Several intervals are split at a time, which only
looks at a few more of them. The k-th best of a few documents is a floor for all blocks from the start.

Scores are whole numbers in 64 bits, so ranks are exact. Counts that scores need (documents,
terms, documents of a term) cover all documents.

Rows: a null or empty text has no term, is not counted and not found. Documents with one id each
have a rank; a null id is found like any other and stands before the smallest. Queries that share an
id are one query with the terms of all, each as often as it comes. A query without a known term
finds nothing. Texts of any length are read whole. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerscan.session import shared_folder

#: Documents of a block, about.
BLOCK_DOCUMENTS = 8192
#: One in so many documents of one block is searched first, for the floors.
SAMPLE_SHARE = 4
#: Terms, repeats included, of the queries that go through the corpus together: what is
#: sent to every executor. More queries take more rounds.
ROUND_TERMS = 200_000
#: Intervals split at a time.
AT_ONCE = 32

#: What a term is, and the constants of the score.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WEIGHT_UNIT, IMPACT_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 25


def terms(text: str | None) -> list[str]:
    """The terms of a text, in order. Of bytes, only A-Z have a lower case."""
    return TERM.findall(text.encode().lower().decode()) if text else []


@dataclass(frozen=True)
class Queries:
    """Terms by number, and for each query its terms' numbers and how often each comes."""

    ids: list
    vocabulary: dict[str, int]
    items: list[tuple[np.ndarray, np.ndarray]]


def gather(rows: list, id_column: str, text_column: str) -> Queries:
    by_id: dict = {}
    for row in rows:
        by_id.setdefault(row[id_column], Counter()).update(terms(row[text_column]))
    vocabulary: dict[str, int] = {}
    items = []
    for counts in by_id.values():
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        items.append((np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
    return Queries(list(by_id), vocabulary, items)


class Block:
    """Posting lists of one block, end to end in order of term and document, with their tables."""

    def __init__(self, term: np.ndarray, document: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((document, term))
        self.documents = documents
        self.impact = impact[order]
        self.document = document[order]
        self.place = term[order] * documents + self.document
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.tables = [np.arange(len(term), dtype=np.int32)]
        # A table's entry is the place of the greatest of 2^level impacts, the leftmost of equals.
        for level in range(longest.bit_length() - 1):
            low, step = self.tables[-1], 1 << level
            left, right = low[:-step], low[step:]
            self.tables.append(np.where(self.impact[left] >= self.impact[right], left, right))

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impact of each stretch from ``low`` up to ``high``, and its place; 0 for an empty one."""
        at = np.zeros(low.shape, np.int64)
        length = high - low
        level = np.frexp(np.maximum(length, 1).astype(float))[1] - 1
        for n, table in enumerate(self.tables):
            chosen = (level == n) & (length > 0)
            if chosen.any():
                left, right = table[low[chosen]], table[high[chosen] - (1 << n)]
                at[chosen] = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(length > 0, self.impact[at] if len(self.impact) else 0, 0), at

    def search(self, term: np.ndarray, times: np.ndarray, k: int, floor: int = 1) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, document)`` with a score of ``floor`` (above 0) or more, best first, the
        first of equal ones first."""
        low = np.searchsorted(self.place, term * self.documents)
        high = np.searchsorted(self.place, (term + 1) * self.documents)
        term, times, low, high = (x[high > low] for x in (term, times, low, high))
        best: list[tuple[int, int]] = []  # a heap of (score, -document)
        if not len(term):
            return best
        waiting: list[tuple] = []
        number = 0

        def put(starts: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
            nonlocal number
            impacts, at = self.greatest(lows, highs)
            bounds = impacts @ times
            widest = (impacts * times).argmax(1)
            rows = np.arange(len(lows))
            split = self.document[at[rows, widest]]
            for n in np.flatnonzero(bounds >= floor).tolist():
                number += 1
                entry = -int(bounds[n]), int(starts[n]), number, int(split[n]), lows[n], highs[n]
                heapq.heappush(waiting, entry)

        def hopeless(bound: int, start: int) -> bool:
            return len(best) == k and (bound, -start) < best[0]

        put(np.zeros(1, np.int64), low[None], high[None])
        while waiting:
            taken = []
            while waiting and len(taken) < AT_ONCE:
                entry = heapq.heappop(waiting)
                if hopeless(-entry[0], entry[1]):
                    if len(best) == k and -entry[0] < best[0][0]:
                        waiting.clear()  # so are all that are left: their bounds aren't higher
                    continue
                taken.append(entry)
            if not taken:
                continue
            _, starts, _, split, lows, highs = zip(*taken, strict=True)
            split, lows, highs = np.array(split), np.array(lows), np.array(highs)
            wanted = term * self.documents + split[:, None]
            at = np.searchsorted(self.place, wanted)
            held = at < highs
            held &= self.place[np.minimum(at, len(self.place) - 1)] == wanted
            scores = np.where(held, self.impact[np.minimum(at, len(self.place) - 1)], 0) @ times
            for score, document in zip(scores.tolist(), split.tolist(), strict=True):
                if score >= floor and not hopeless(score, document):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -document))
            put(
                np.concatenate([np.array(starts), split + 1]),
                np.concatenate([lows, at + held]),
                np.concatenate([at, highs]),
            )
        return [(score, -document) for score, document in sorted(best, reverse=True)]


def _digests(documents: DataFrame, queries: Queries) -> DataFrame:
    """``known`` (whether it has an id), ``doc_id``, ``n`` (its terms) and the asked terms (``term``,
    ``tf``) of documents with a term."""
    shared = documents.sparkSession.sparkContext.broadcast(queries.vocabulary)

    @F.pandas_udf("n long, term array<int>, tf array<int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        vocabulary = shared.value
        rows = []
        for text in texts:
            found = terms(text)
            counts = Counter(filter(vocabulary.__contains__, found))
            rows.append((len(found), [vocabulary[t] for t in counts], list(counts.values())))
        return pd.DataFrame(rows, columns=["n", "term", "tf"])

    counted = documents.select("doc_id", of("text").alias("__of"))
    known_id = F.col("doc_id").isNotNull().alias("known")  # pandas would turn longs with nulls into doubles
    return counted.select(known_id, F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "__of.*").filter("n > 0")


def _impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, words: int) -> np.ndarray:
    length = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // words
    return weight * ((IMPACT_UNIT * tf) // (1000 * tf + 12 * length))


def _searcher(queries: Queries, weight: np.ndarray, documents: int, words: int, k: int, shared, floors):
    """The search of one block's digests, as a function of a data frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked: Queries = shared.value
        floor = floors.value if floors is not None else {}
        rows = rows.sort_values(["known", "doc_id"], ignore_index=True)  # the order of equal scores
        sizes = rows["term"].map(len).to_numpy()
        term = np.concatenate([*rows["term"], np.empty(0, np.int32)]).astype(np.int64)
        tf = np.concatenate([*rows["tf"], np.empty(0, np.int32)]).astype(np.int64)
        document = np.repeat(np.arange(len(rows)), sizes)
        n = rows["n"].to_numpy(np.int64)[document]
        block = Block(term, document, _impacts(n, tf, weight[term], documents, words), len(rows))
        found = [
            (item, score, place)
            for item, (numbers, times) in enumerate(asked.items)
            for score, place in block.search(numbers, times, k, floor.get(item, 1))
        ]
        items, scores, places = zip(*found, strict=True) if found else ((), (), ())
        chosen = rows[["known", "doc_id"]].take(list(places)).reset_index(drop=True)
        ids = chosen["doc_id"].astype("Int64").where(chosen["known"].astype(bool))
        return pd.DataFrame({"item": items, "doc_id": ids, "score": scores})

    return run


def _round(documents: DataFrame, queries: Queries, k: int, block_documents: int) -> DataFrame:
    """The best of every block for the queries of one round: ``item`` (its number), ``doc_id``, ``score``."""
    spark = documents.sparkSession
    context = spark.sparkContext
    folder = shared_folder(spark, "lexical")
    numbered = _digests(documents, queries).withColumn("__row", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    table = spark.read.parquet(folder)
    total = table.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    count, words = total["documents"], max(1, total["words"])
    holders = np.zeros(len(queries.vocabulary), np.int64)
    # One row for each term of the round, which are bounded.
    for term, held in table.select(F.explode("term").alias("term")).groupBy("term").count().toPandas().itertuples(index=False):
        holders[term] = held
    weight = np.floor(WEIGHT_UNIT * np.log((2 * count + 2) / (2 * holders + 1))).astype(np.int64)

    blocks = max(1, -(-count // block_documents))
    dealt_to = lambda many: F.pmod(F.xxhash64("__row"), F.lit(many).cast("long"))
    dealt = table.withColumn("block", dealt_to(blocks)).drop("__row")
    shared = context.broadcast(queries)  # ROUND_TERMS at most
    first = _searcher(queries, weight, count, words, k, shared, None)
    result = "item int, doc_id long, score long"

    def one_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield first(pd.concat(rows))

    few = table.filter(dealt_to(blocks * SAMPLE_SHARE) == 0).drop("__row")  # a part of one block
    sample = few.repartition(1).mapInPandas(one_block, result)
    floors: dict[int, int] = {}
    for row in sample.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
        if row["n"] == k:  # the k-th best of any documents is no better than that of all
            floors[row["item"]] = row["least"]
    search = _searcher(queries, weight, count, words, k, shared, context.broadcast(floors))
    return dealt.groupBy("block").applyInPandas(search, result)


def search(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 20,
    query_id: str = "item_id",
    block_documents: int = BLOCK_DOCUMENTS,
    round_terms: int = ROUND_TERMS,
) -> DataFrame:
    """The ``k`` best documents (``doc_id``, ``text``) of each query (``query_id``, ``text``): ``query_id``,
    ``rank`` from 1, ``doc_id``, ``score``. Only scores above 0 count.

    Queries are dealt into rounds by a hash of their id, so that a round's terms are bounded;
    one query of more terms is a round of its own.
    """
    spark = documents.sparkSession
    asked = queries.select(query_id, "text")
    size = asked.agg(F.sum(F.regexp_count("text", F.lit(TERM.pattern)))).first()[0] or 0
    rounds = max(1, -(-size // round_terms))
    found = None
    for number in range(rounds):
        mine = F.pmod(F.xxhash64(query_id), F.lit(rounds).cast("long")) == number
        gathered = gather(asked.filter(mine).collect(), query_id, "text")
        part = _round(documents.select("doc_id", "text"), gathered, k, block_documents)
        names = spark.createDataFrame(list(enumerate(gathered.ids)), f"item int, {query_id} {queries.schema[query_id].dataType.simpleString()}")
        part = part.join(F.broadcast(names), "item").select(query_id, "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", "doc_id", "score")
