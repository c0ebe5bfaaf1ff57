"""Searches by the filters of files: the same rows as without, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from layerscan.operators.search import search_rows
from layerscan.operators.search_index import build_index, files_that_may_match, run_bits, search_indexed


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("indexed")
    rnd = random.Random(3)
    alphabets = ["abc", "def", "ghi", "ÄÖé", "İıß", "123"]
    rows = [
        (n, None if n % 17 == 0 else "".join(rnd.choices(alphabets[n // 50] + " ", k=n % 40)), n * 1.5, bytearray(b"zzz"))
        for n in range(300)
    ]
    df = spark.createDataFrame(rows, "id long, text string, v double, raw binary")
    df.repartitionByRange(6, "id").write.parquet(f"{folder}/files")
    found = spark.read.parquet(f"{folder}/files")
    build_index(found, f"{folder}/index")
    return found, f"{folder}/index"


QUERIES = ["a", "AB", "abc", "b c", "äö", "É", "i", "ss", "ß", "12", "1.5", "7.5", "zzz", "q", "", "a b c a", "abd", "\U0001f600"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_without(spark, indexed, query):
    rows, index = indexed
    assert sorted(search_indexed(rows, index, query).collect()) == sorted(search_rows(rows, query).collect())


def test_fewer_files_are_read(spark, indexed):
    rows, index = indexed
    for query, most in (("abc", 1), ("DEF", 1), ("a", 2), ("qqq", 0)):
        assert files_that_may_match(spark, index, query).count() <= most
    read = search_indexed(rows, index, "abc").select(F.col("_metadata.file_path")).distinct().count()
    assert read == 1
    plan = search_indexed(rows, index, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan


def test_more_files_than_can_be_named(spark, indexed, monkeypatch):
    from layerscan.operators import search_index

    rows, index = indexed
    monkeypatch.setattr(search_index, "NAMED_FILES", 0)
    assert search_indexed(rows, index, "a").count() == search_rows(rows, "a").count() > 0


def test_every_run_of_a_part_is_a_run_of_the_whole():
    rnd = random.Random(1)
    text = "".join(rnd.choices("abcdeéß \U0001f600", k=500))
    whole = set(run_bits(text).tolist())
    for _ in range(200):
        low, high = sorted((rnd.randrange(500), rnd.randrange(500)))
        assert set(run_bits(text[low:high]).tolist()) <= whole
