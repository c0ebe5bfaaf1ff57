import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerscan.llm import lexical, oracles, queries
from tests.compare import connect, differences
from tests.llm import samples

SF = "/root/testdata/sf0.001"


def brute_search(documents, asked, k):
    docs = [(i, Counter(lexical.terms(t)), len(lexical.terms(t))) for i, t in documents]
    docs = [d for d in docs if d[2]]
    count, words = len(docs), sum(n for *_, n in docs)
    holders = Counter(t for _, c, _ in docs for t in c)
    terms = {}
    for item, text in asked:
        terms.setdefault(item, Counter()).update(lexical.terms(text))
    out = []
    for item, wanted in terms.items():
        scored = []
        for doc_id, c, n in docs:
            m = 75 + (25 * n * count) // words
            score = 0
            for term, times in wanted.items():
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * holders[term] + 1)))
                score += times * w * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


def table(spark, data, name="doc_id"):
    return spark.createDataFrame(data, f"{name} long, text string")


@pytest.fixture(scope="module")
def corpus():
    docs = [(n, samples.prose(n % 60, 5 + n % 50)) for n in range(400)]  # copies: equal scores
    docs += [(n, f"rare{n % 7} " * (n % 5) + samples.prose(n, 20)) for n in range(1000, 1100)]
    return docs + [(5, docs[9][1]), (5, docs[9][1]), (None, docs[3][1]), (None, None), (2**60 + 1, docs[3][1])]


ASKED = [(1, samples.prose(3, 12)), (2, "rare1 rare3 RARE3 the"), (3, "nothing of this"), (4, None), (5, ""),
         (6, samples.prose(9, 30)), (6, "rare2"), (None, "rare5 É"), (7, "rare1")]


@pytest.mark.parametrize("k, block, terms", [(20, 8192, 10**6), (3, 50, 10**6), (20, 100, 15), (1000, 90, 10**6)])
def test_like_brute_force(spark, corpus, k, block, terms):
    found = lexical.search(
        table(spark, corpus).repartition(3), table(spark, ASKED, "item_id"), k, block_documents=block, round_terms=terms
    )
    assert rows(found) == brute_search(corpus, ASKED, k)


def test_odd_rows_and_empty_tables(spark):
    documents = samples.odd_documents(spark).withColumns({c: F.lit("x") for c in ("n", "tf", "block", "known", "rank")})
    asked = table(spark, [(1, samples.prose(2, 30)), (2, "endoftext x é")], "item_id").withColumn("score", F.lit("x"))
    expected = brute_search([r[:2] for r in samples.odd_rows()], [tuple(r)[:2] for r in asked.collect()], 20)
    assert rows(lexical.search(documents, asked)) == expected and expected
    assert lexical.search(samples.no_documents(spark), asked).count() == 0
    assert lexical.search(documents, asked.limit(0)).count() == 0


def test_the_tables_answer_ranges():
    rng = np.random.default_rng(1)
    term, document = np.divmod(np.flatnonzero(rng.random(7 * 300) < 0.4), 300)
    impact = rng.integers(1, 9, len(term))
    block = lexical.Block(term, document, impact, 300)
    for _ in range(300):
        t = rng.integers(0, 7)
        places = np.flatnonzero(term == t)
        low, high = sorted(rng.integers(places[0], places[-1] + 2, 2))
        value, at = (int(x[0]) for x in block.greatest(np.array([low]), np.array([high])))
        if low == high:
            assert value == 0
        else:
            assert value == impact[low:high].max() and at == low + impact[low:high].argmax()


@pytest.mark.parametrize("at_once", [1, 4, 64])
def test_best_first_looks_at_few_documents(monkeypatch, at_once):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    term, document = np.divmod(np.flatnonzero(rng.random(5 * 5000) < 0.3), 5000)
    impact = (rng.pareto(1.0, len(term)) * 100).astype(np.int64) + 1
    block = lexical.Block(term, document, impact, 5000)
    scores = np.bincount(document, impact, 5000).astype(np.int64)
    expected = sorted(((int(s), d) for d, s in enumerate(scores) if s), key=lambda x: (-x[0], x[1]))
    seen = []
    greatest = block.greatest
    block.greatest = lambda low, high: (seen.append(len(low)), greatest(low, high))[1]
    assert block.search(np.arange(5), np.ones(5, np.int64), 10) == expected[:10]
    assert sum(seen) < 2500 * 2
    floor = expected[4][0]
    assert block.search(np.arange(5), np.ones(5, np.int64), 10, floor) == [x for x in expected[:10] if x[0] >= floor]


def test_query(spark):
    found = queries.op12_lexical(spark, SF)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert differences(found, connect(SF), oracles.ORACLES["op12_lexical"]) == []
