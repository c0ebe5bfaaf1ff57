from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layerscan.llm import packing
from layerscan.llm.queries import tokenizer_file
from layerscan.llm.tokens import library_words
from tests.llm import samples


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_every_length_is_packed_and_the_search_never_adds_bins(lengths):
    first = packing.best_fit(lengths, 100)
    bins = packing.improve([list(b) for b in first], 100)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert all(b and sum(b) <= 100 for b in bins)
    assert len(bins) <= len(first)


def test_exchanges_empty_bins_that_best_fit_leaves_open():
    # Best fit decreasing needs one bin more than the total asks for.
    saved = 0
    for seed in range(300):
        lengths = np.random.default_rng(seed).integers(20, 60, 30).tolist()
        first = packing.best_fit(lengths, 100)
        saved += len(first) - len(packing.improve([list(b) for b in first], 100))
    assert saved > 20


def test_two_for_one_exchange():
    # 6 in the first bin for 3 + 4 of the second; then 6 fits where 3 + 4 were.
    bins = packing.improve([[6, 3], [3, 4, 1], [2, 1]], 10)
    assert len(bins) == 2


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_odd_documents(spark):
    words = library_words(tokenizer_file("word_bpe_49k.json"), "I")
    documents = samples.odd_documents(spark)
    pieces = packing.token_pieces(documents, tokenizer_file("word_bpe_49k.json"), capacity=64)
    packed = packing.pack(pieces.withColumn("offset", F.lit("taken")), 64, group_rows=10)
    rows = packed.collect()
    check_places(rows, 64)
    whole = defaultdict(int)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["start"] == 64 * r["piece"]
        whole[r["doc_id"]] += r["length"]
    expected = defaultdict(int)
    for doc_id, text, *_ in samples.odd_rows():
        expected[doc_id] += len(words.text(text)) // 4 + 1
    assert whole == expected
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * sum(expected.values())


def test_many_groups_stay_near_the_least_number(spark):
    pieces = spark.range(3000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).alias("length")
    )
    rows = packing.pack(pieces, 200, group_rows=500).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    least = -(-sum(r["length"] for r in rows) // 200)
    assert check_places(rows, 200) <= 1.03 * least


def test_no_pieces_and_wrong_lengths(spark):
    empty = packing.token_pieces(samples.no_documents(spark), tokenizer_file("word_bpe_49k.json"))
    assert packing.pack(empty).count() == 0
    for wrong in (None, 0, 2049):
        with pytest.raises(Exception, match="out of range"):
            packing.pack(spark.createDataFrame([(wrong,)], "length long")).count()
