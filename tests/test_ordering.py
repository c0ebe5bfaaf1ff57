"""Positions, pages and match rings with many small buckets, against plain Python."""

from collections import Counter

import pytest

from layerscan.operators import ordering, paging
from layerscan.operators.search import match_ring, search_rows


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 16)


def bunched_keys():
    """A third of all keys close together, others far apart, some negative."""
    return sorted({*range(1000, 1200), *(i * i * 37 - 5000 for i in range(300)), 10**15, 10**15 + 2})


def layer(spark, keys):
    rows = [(k, f"name {k % 7}", None if k % 5 == 0 else k * 0.5) for k in keys]
    return spark.createDataFrame(rows, "fid bigint, name string, score double").repartition(5)


@pytest.mark.parametrize("keys", [list(range(333)), list(range(-50, 400)), bunched_keys(), [5], []])
def test_positions(spark, small_buckets, keys):
    df = layer(spark, keys)
    got = {r.fid: r.position for r in ordering.with_position(df, "fid").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


@pytest.mark.parametrize("keys", [list(range(333)), bunched_keys()])
@pytest.mark.parametrize("position", [0, 1, 17, 250, 332, 10**6])
def test_key_at(spark, small_buckets, keys, position):
    expected = ordering.Place(keys[position], position) if position < len(keys) else None
    assert ordering.key_at(layer(spark, keys), "fid", position) == expected


def test_bucket_count_is_bounded():
    layout = ordering.KeyLayout(10**13, 0, 10**13 - 1, dense=True)
    assert layout.buckets == ordering.MAX_BUCKETS


# Repeated and null keys, one of them on very many rows; and keys that only look dense.
REPEATED = {
    "hot": [None] * 40 + [1, 2, 2] + [7] * 200 + [8, 8, 9, 10**12],
    "looks dense": [0, 0, 1, 1, 4, 5],
    "one key": [3] * 100,
    "no key": [None] * 50,
    "null and few": [None, 1, 5, 9],
}


def repeated(spark, name):
    rows = [(k, f"name {n}", n % 3) for n, k in enumerate(REPEATED[name])]
    # Rows equal in everything as well.
    rows += [(7, "twin", 0)] * (30 if name == "hot" else 0)
    return spark.createDataFrame(rows, "fid bigint, name string, other int").repartition(3), rows


def sort_key(row):
    return (row[0] is not None, row[0] or 0)


@pytest.mark.parametrize("name", REPEATED)
def test_positions_with_repeated_keys(spark, small_buckets, name):
    df, rows = repeated(spark, name)
    got = sorted(ordering.with_position(df, "fid").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert [r.fid for r in got] == [r[0] for r in sorted(rows, key=sort_key)]
    again = sorted(ordering.with_position(df.repartition(7), "fid").collect(), key=lambda r: r.position)
    assert got == again


@pytest.mark.parametrize("name", REPEATED)
def test_previews_and_scans_share_the_rows_with_repeated_keys(spark, small_buckets, name):
    df, rows = repeated(spark, name)
    for count in sorted({0, 1, 3, len(rows) // 2, len(rows) - 1, len(rows), len(rows) + 5}):
        first = paging.preview(df, "fid", count).collect()
        assert [r.fid for r in first] == [r[0] for r in sorted(rows, key=sort_key)][:count]
        rest = paging.scan_from(df, "fid", count).collect()
        assert Counter(map(tuple, first)) + Counter(map(tuple, rest)) == Counter(rows)


def test_no_position_keeps_looking_within_one_key(spark, small_buckets):
    df, rows = repeated(spark, "hot")
    assert ordering.key_at(df, "fid", 20) == ordering.Place(None, 0)
    assert ordering.key_at(df, "fid", 150) == ordering.Place(7, 43)
    assert ordering.key_at(df, "fid", len(rows)) is None


def test_match_ring_numbers_rows_with_repeated_keys(spark, small_buckets):
    df, rows = repeated(spark, "hot")
    ring = match_ring(df, "fid", "name", ["name"]).collect()
    hits = [r for r in rows if r[1].startswith("name")]
    assert sorted(r.match_index for r in ring) == list(range(len(hits)))
    in_order = sorted(ring, key=lambda r: r.match_index)
    assert [r.fid for r in in_order] == [r[0] for r in sorted(hits, key=sort_key)]


@pytest.mark.parametrize("keys", [list(range(333)), bunched_keys()])
@pytest.mark.parametrize("query", ["name 3", "NAME", "name 9", ""])
def test_match_ring(spark, small_buckets, keys, query):
    hits = [k for k in keys if query and query.lower() in f"name {k % 7}"]
    expected = {k: (i, hits[(i + 1) % len(hits)], hits[i - 1]) for i, k in enumerate(hits)}
    ring = match_ring(layer(spark, keys), "fid", query, ["name"])
    assert {r.fid: (r.match_index, r.next_key, r.prev_key) for r in ring.collect()} == expected


def test_match_ring_searches_once(spark, small_buckets):
    ring = match_ring(layer(spark, bunched_keys()), "fid", "name")
    ring.collect()
    assert "ReusedExchange" in ring._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skip", [-1, 0, 1, 137, 500, 10**9])
def test_scan_from_counts_positions_not_keys(spark, small_buckets, skip):
    keys = bunched_keys()
    got = sorted(r.fid for r in paging.scan_from(layer(spark, keys), "fid", skip).collect())
    assert got == keys[max(skip, 0):]


@pytest.mark.parametrize("limit", [-3, 0, 2, 10, 10**6])
def test_preview(spark, small_buckets, limit):
    keys = bunched_keys()
    got = [r.fid for r in paging.preview(layer(spark, keys), "fid", limit).collect()]
    assert got == keys[: max(limit, 0)]


def test_preview_summary(spark):
    df = layer(spark, range(100))
    assert tuple(paging.preview_summary(df, 3).first()) == (100, 3)
    assert tuple(paging.preview_summary(df, 200).first()) == (100, 100)
    assert tuple(paging.preview_summary(df, -1).first()) == (100, 0)


@pytest.mark.parametrize("rows", [0, 1, 199, 200, 201, 700, 701, 1500])
def test_page_progress(spark, small_buckets, rows):
    keys = [k * 3 + k % 2 for k in range(rows)]
    pages, start, size = [], 0, 200
    while start < rows:
        part = keys[start : start + size]
        start, size = start + len(part), 500
        pages.append((len(pages), len(part), part[0], part[-1], start, rows))
    got = paging.page_progress(layer(spark, keys), "fid").orderBy("page")
    assert [tuple(r) for r in got.collect()] == pages


def test_reserved_names_get_a_suffix(spark):
    df = spark.createDataFrame([(1, 2, "x")], "key int, FID int, geometry string")
    assert paging.feature_rows(df, "key").columns == ["fid", "key", "FID_1", "geometry_1", "geometry"]


ROADS = [("Harbour Lane", "7.5"), ("Mill Road", "31"), ("North Quay", "12.5"), ("Old Lane", "3")]


@pytest.mark.parametrize(
    ("query", "hits"), [("LANE", [0, 3]), ("ROAD", [1]), ("o", [0, 1, 2, 3]), (".5", [0, 2]), ("bridge", []), ("", [])]
)
def test_search(spark, query, hits):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROADS)], "fid int, name string, width string")
    assert sorted(r.fid for r in search_rows(df, query, ["name", "width"]).collect()) == hits


def test_search_skips_nulls_and_bytes(spark):
    df = spark.createDataFrame([(None, bytearray(b"none")), ("None", None)], "s string, b binary")
    assert [r.s for r in search_rows(df, "none").collect()] == ["None"]


def test_search_is_one_filter_in_generated_code(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = search_rows(orders, "high")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Filter" in plan
    assert "Exchange" not in plan


def test_search_looks_at_numbers_only_for_number_queries(spark):
    df = spark.createDataFrame(
        [(1, 12345678.5, True, "x"), (-77, 1e-7, False, "y"), (None, float("nan"), None, None)],
        "n int, d double, b boolean, s string",
    )

    def found(query):
        return [r.n for r in search_rows(df, query).collect()]

    assert found("78.5") == [1] and found("1e-07") == [-77] and found("-7") == [-77] and found("nan") == [None]
    assert found("TRUE") == [1] and found("7x") == []
    plan = search_rows(df, "word")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(s" in plan and "cast(n" not in plan and "cast(d" not in plan


def test_rows_that_differ_in_a_map_alone_have_an_order(spark, small_buckets):
    rows = [(7, n % 3) for n in range(60)]
    plain = spark.createDataFrame(rows, "fid bigint, n int").repartition(4)
    df = plain.selectExpr(
        "fid",
        "CASE WHEN n = 0 THEN map('a', array(1), 'b', array(2)) WHEN n = 1 THEN map('b', array(2), 'a', array(1)) "
        "ELSE map('a', array(1), 'b', array(3)) END AS m",
        "array(named_struct('x', map(1, n))) AS nested",
        "parse_json(concat('{\"k\": ', n, '}')) AS v",
    )
    placed = ordering.with_position(df, "fid").selectExpr("position", "to_json(v) AS v").collect()
    assert sorted(r.position for r in placed) == list(range(60))
    order = [r.v for r in sorted(placed, key=lambda r: r.position)]
    assert len({tuple(order[i : i + 20]) for i in (0, 20, 40)}) == 3 and all(len(set(order[i : i + 20])) == 1 for i in (0, 20, 40))
    left = paging.scan_from(df, "fid", 25).selectExpr("to_json(v) AS v").collect()
    assert Counter(r.v for r in left) == Counter(order[25:])


def test_maps_are_hashed_in_order_of_their_keys(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT NULL")
    ties = ordering.with_ties(df).select(*ordering.TIES).collect()
    assert ties[0] == ties[1] != ties[2] and ties[0][0] != ties[0][1]
