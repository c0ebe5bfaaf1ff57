import numpy as np
from pyspark.sql import functions as F

from layerscan.llm import nearest, queries


def brute(ids, vectors, query_id, query, k):
    rows = [n for n, i in enumerate(ids) if i != query_id]
    apart = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
    best = np.lexsort((ids[rows], apart))[:k]
    return ids[rows][best], apart[best]


def clustered(count, size=32):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, size))
    return centres[rng.integers(0, 12, count)] + 0.4 * rng.normal(size=(count, size))


def test_probing_finds_every_code_within_the_radius():
    vectors = clustered(600)
    codes = nearest.learn(vectors, 10)
    index = nearest.Index(codes, np.arange(600), vectors, np.ones(600, int))
    for n in range(0, 600, 50):
        apart = nearest._BITS_SET[index.bits ^ index.bits[n]].sum(axis=1)
        for radius in (0, 7, 20, codes.radius):
            assert set(index.within(index.bits[n], radius)) == set(np.flatnonzero(apart <= radius))


def test_recall_and_scores(spark):
    vectors = clustered(3000)
    frame = spark.createDataFrame(
        [(n, v) for n, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>"
    )
    rows = nearest.usable(frame, "vec_id", "embedding")
    found = nearest.search(rows, rows.filter(F.col("id") % 50 == 0), block_rows=700).toPandas()
    ids, hits = np.arange(3000), 0
    for query_id, mine in found.groupby("query_id"):
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        true, _ = brute(ids, vectors, query_id, vectors[query_id], 10)
        hits += len(set(true) & set(mine["vec_id"]))
        apart = np.sqrt(((vectors[mine["vec_id"]] - vectors[query_id]) ** 2).sum(axis=1))
        assert np.allclose(apart, mine["score"], rtol=0, atol=1e-12)
        assert (np.diff(mine["score"]) >= 0).all()
    assert found["query_id"].nunique() == 60
    assert hits / 600 >= 0.9


def all_by_rank(found):
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]),
        (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (9, [1.0, 2.0, 3.0]), (10, []), (None, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = nearest.usable(frame.withColumn("vector", F.lit("taken")), "vec_id", "embedding")
    assert sorted((r["id"], r["copies"]) for r in rows.collect()) == [
        (0, 1), (1, 1), (2, 1), (3, 2), (9, 1)
    ]
    found = nearest.search(rows, rows, block_rows=2).collect()
    twice = [3, 3, 0, 0, 1, 1, 2, 2]  # both rows ask
    assert all_by_rank(found) == {0: [1, 2, 3, 3], 1: [0, 2, 3, 3], 2: [0, 1, 3, 3], 3: twice}
    none = nearest.usable(frame.filter("false"), "vec_id", "embedding")
    assert nearest.search(none, none).count() == 0
    assert nearest.search(rows, none).count() == nearest.search(none, rows).count() == 0


def test_sizes_and_repeated_ids(spark):
    # Every size is searched on its own; rows with one id are rows, also of the query's id.
    wide, narrow = clustered(300), clustered(90, 8)
    huge = 1 << 60
    rows = [(huge + n // 2, v) for n, v in enumerate(wide.tolist())]
    rows += [(huge + n, v) for n, v in enumerate(narrow.tolist())]
    rows += [(7, wide[0].tolist())] * 40 + [(huge + 400, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = nearest.usable(frame, "vec_id", "embedding")
    asked = usable.filter(f"id in ({huge}, {huge + 20}, 7, {huge + 400})")
    found = nearest.search(usable, asked, block_rows=100)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hits = {}, 0
    for n, (query_id, query) in enumerate(rows):
        if query_id in (huge, huge + 20, 7):
            others = [(i, v) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(query)]
            ids, apart = zip(*sorted(others, key=lambda x: (np.linalg.norm(np.subtract(x[1], query)), x[0]))[:10])
            far = [np.linalg.norm(np.subtract(v, query)) for v in apart]
            want.setdefault(query_id, []).extend(zip(range(1, 11), ids, far))
    assert set(got) == set(want)
    for query_id, lines in want.items():
        assert len(got[query_id]) == len(lines)
        assert sorted(r for r, _, _ in got[query_id]) == sorted(r for r, _, _ in lines)
        key = lambda x: (x[1], round(x[2], 9))
        hits += len(set(map(key, got[query_id])) & set(map(key, lines))) / len(set(map(key, lines)))
    assert hits / len(want) >= 0.9
    assert {v for _, v, _ in got[7]} == {7} and {d for _, v, d in got[7]} == {0.0}


def test_query_on_the_given_table(spark):
    """Recall and types of the contract."""
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op5_nearest(spark, sf_dir)
    assert dict(found.dtypes) == {
        "query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"
    }
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    table = table[table["embedding"].notna()]
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    hits, found = 0, found.toPandas()
    for query_id, mine in found.groupby("query_id"):
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        true, apart = brute(ids, vectors, query_id, vectors[ids == query_id][0], 10)
        hits += len(set(true) & set(mine["vec_id"]))
        assert (mine["score"].to_numpy() >= apart - 1e-12).all()
    assert set(found["query_id"]) == {i for i in ids.tolist() if i % 100 == 0}
    assert hits >= 0.9 * len(found)
