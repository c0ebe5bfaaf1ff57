import random
from collections import defaultdict

import numpy as np

from layerscan.llm import near_dedup
from tests.llm import samples


def brute_classes(rows, similarity):
    """The least id of each row's class, comparing all pairs."""
    sets = [set(near_dedup.shingles(text).tolist()) for _, text in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for n, (_, text) in enumerate(rows):
        for m in range(n):
            both = len(sets[n] & sets[m])
            if (text or "") == (rows[m][1] or "") or (
                both and both >= similarity * (len(sets[n]) + len(sets[m]) - both)
            ):
                root[find(n)] = find(m)
    members = defaultdict(list)
    for n, (doc_id, _) in enumerate(rows):
        members[find(n)].append(doc_id)
    return {
        (d, t): min(members[find(n)], key=lambda x: (x is not None, x)) for n, (d, t) in enumerate(rows)
    }


def edited(text, seed, edits):
    rnd, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return " ".join(words)


def test_agreement_follows_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.3, 0.8):
        cut = int(400 * share)
        one, other = near_dedup.signatures([elements, elements[:cut]], 3000)
        assert abs((one == other).mean() - share) < 0.04
    heavy = rng.random(60) * 4 + 0.1
    light = heavy * rng.random(60) + 1e-6
    one, other = near_dedup.signatures([elements[:60]] * 2, 3000, [heavy, light])
    expected = np.minimum(heavy, light).sum() / np.maximum(heavy, light).sum()
    assert abs((one == other).mean() - expected) < 0.04


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 300, 5000)]
    together = near_dedup.signatures(sets)
    for n, own in enumerate(sets):
        assert (near_dedup.signatures([own])[0] == together[n]).all()


def test_classes_are_those_of_all_pairs(spark):
    rows = []
    for group in range(6):
        base = samples.prose(group, 200)
        rows += [(100 * group + n, edited(base, n, n % 5)) for n in range(25)]
    # A chain: each text is close to the next only.
    chain = samples.prose(77, 240).split()
    rows += [(1000 + n, " ".join(chain[8 * n : 8 * n + 120])) for n in range(10)]
    rows += [(2000 + n, samples.prose(500 + n, 100)) for n in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.classes(frame).join(frame, "doc_id").select("doc_id", "text", "class_id")
    expected = brute_classes(rows, near_dedup.SIMILARITY)
    assert {(r[0], r[1]): r[2] for r in found.collect()} == expected
    kept = near_dedup.keep(frame).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(expected.values()))


def test_odd_documents(spark):
    documents = samples.odd_documents(spark)
    rows = [(r[0], r[1]) for r in samples.odd_rows()]
    expected = brute_classes(rows, near_dedup.SIMILARITY)
    found = near_dedup.classes(documents).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert by_id == {d: c for (d, _), c in expected.items() if d is not None}
    kept = near_dedup.keep(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # Null comes first: it stands for the empty texts and for its own text.
    assert sorted(i for i in ids if i is not None) == [-10, 1, 3, 6, 7, 8, 9]
    assert ids.count(None) == 2


def test_no_documents(spark):
    assert near_dedup.classes(samples.no_documents(spark)).count() == 0
    assert near_dedup.keep(samples.no_documents(spark)).count() == 0
