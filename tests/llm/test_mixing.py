import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from layerscan.llm import mixing, oracles, queries
from tests.compare import connect, differences
from tests.llm import samples

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights, most):
    """Targets by the words of the contract: share, cap, share the excess anew until none is above."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / share for s in sizes}
        above = {s for s in sizes if s not in full and target[s] >= most * sizes[s]}
        if not above or not total:
            return target
        full |= above


def brute_mix(rows, most=3):
    """(doc_id, text, source) to the sorted rows of the result."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    members = defaultdict(list)
    for doc_id, text, source in rows:
        members[source].append((doc_id, text))
    sizes = {s: sum(size(t) for _, t in members[s]) for s in names}
    target = brute_targets(sizes, weights, most)
    out = []
    for s in names:
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        keyed = []
        for doc_id, text in members[s]:
            digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 16**13
            n = size(text)
            symbols = sum(c in "#*$%&|<>" for c in text or "")
            keyed.append((-math.log(u) / ((n + 1) / (n + 1 + 10 * symbols)), u, doc_id is not None, doc_id or 0, n))
        for _, _, known, doc_id, n in sorted(keyed):
            drawn = min(n, rest)
            rest -= drawn
            out.append((doc_id if known else None, n, sizes[s], target[s], epochs * n + drawn))
    return sorted(out, key=str)


def mixed(documents, **options):
    found = mixing.mix(documents, **options).select("doc_id", "size", "source_size", "target", "taken")
    return sorted(map(tuple, found.collect()), key=str)


def near(found, expected):
    assert [(*r[:3], r[4]) for r in found] == [(*r[:3], r[4]) for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected])


def test_odd_rows(spark):
    rows = [r[:2] + (r[3],) for r in samples.odd_rows()]
    documents = samples.odd_documents(spark).withColumns({c: F.lit("x") for c in (*mixing.RESULTS, "key", "range")})
    near(mixed(documents), brute_mix(rows))
    assert mixed(samples.no_documents(spark)) == []
    assert mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_a_hot_source_and_repeated_rows(spark, ranges):
    rows = [(n, samples.prose(n, 1 + n % 40), "hot" if n % 3 else f"s{n % 12}") for n in range(400)]
    rows += [(n % 5, "same words here", "hot") for n in range(100)] + [(7, "$ # " * 30, "s0")] * 3
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        near(mixed(documents), brute_mix(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_small_sources_stop_at_their_epochs(spark):
    rows = [(n, "a b c d", "big") for n in range(200)] + [(1000 + n, "a b", s) for n in range(3) for s in "cde"]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near(mixed(documents), brute_mix(rows))
    taken = mixing.mix(documents).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert {r[0]: r[1] for r in taken} == {"big": 818 - 54, "c": 18, "d": 18, "e": 18}
    assert mixing.mix(documents, most_epochs=1).filter("taken <> size").count() == 0


def test_better_documents_come_first(spark):
    documents = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"),
        F.when(F.col("id") % 4 < 2, 9.0).when(F.col("id") % 40 == 3, None).otherwise(1.0).alias("w"),
    )
    got = mixing.mix(documents, weights=(1, 3), quality=documents["w"], carry=["w"])
    part = got.filter("source = '0'")  # half of it is taken
    share = {r["w"]: r["s"] for r in part.groupBy("w").agg((F.sum("taken") / F.sum("size")).alias("s")).collect()}
    assert share[9.0] > 0.75 > 0.3 > share[1.0] and (None not in share or share[None] == 0)


def test_the_mix_itself(spark):
    rows = [(n, f"w{n}\n\tx  y{n} z", "abc"[n % 3]) for n in range(90)] + [(99, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(documents, carry=["text"])
    copies = mixing.expand(found).collect()
    words = Counter()
    for r in copies:
        assert rows[r["doc_id"]][1].startswith(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in found.collect() if r["taken"]}
    assert len({(r["doc_id"], r["epoch"]) for r in copies}) == len(copies)


def test_query(spark):
    found = queries.op11_mixing(spark, SF)
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    assert differences(found, connect(SF), oracles.ORACLES["op11_mixing"]) == []
