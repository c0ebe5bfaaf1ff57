from collections import Counter

import pytest
from pyspark.sql import functions as F

from layerscan.llm import sharding
from layerscan.llm.sharding import Shard
from tests.llm import samples


def placed(spark, shards, count=6000):
    rows = spark.range(count).select("id", sharding.shard_of(F.col("id"), shards).alias("s"))
    return dict(map(tuple, rows.collect()))


def test_shares_follow_weights(spark):
    shards = [Shard(0, "a", "a1"), Shard(1, "a", "a1", 3.0), Shard(2, "a", "a2"), Shard(3, "b", "b1")]
    count = Counter(placed(spark, shards).values())
    for shard in shards:
        assert abs(count[shard.number] / 6000 - shard.weight / 6) < 0.025


def test_one_more_shard_takes_rows_only_into_itself(spark):
    shards = sharding.tree(8)
    before, after = placed(spark, shards), placed(spark, sharding.with_shard(shards))
    moved = {after[k] for k in before if before[k] != after[k]}
    assert moved == {8} and set(before.values()) == set(range(8))


def test_a_heavier_shard_moves_rows_only_into_its_subtrees(spark):
    shards = sharding.tree(8)
    grown = [Shard(0, "g0", "k0", 3.0), *shards[1:]]
    before, after = placed(spark, shards), placed(spark, grown)
    assert any(before[k] != after[k] for k in before)
    for key in before:
        if before[key] != after[key]:
            # From the other region into this one, from the other rack into this, or to shard 0.
            came, went = before[key], after[key]
            assert went // 4 == 0
            assert came // 4 == 1 or (went // 2 == 0 and (came // 2 == 1 or went == 0))


def test_slots_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    documents = samples.odd_documents(spark).select("doc_id", "text", "slot")
    documents = documents.union(spark.range(70).select(F.lit(1), F.lit("same"), F.lit("")))
    rows = sharding.with_slots(sharding.assign(documents, sharding.tree(8))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(
        (r["doc_id"], r["text"]) for r in documents.collect()
    )
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_no_documents_and_wrong_weights(spark):
    empty = sharding.assign(samples.no_documents(spark), sharding.tree(8))
    assert sharding.with_slots(empty).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.shard_of(F.lit(1), [Shard(0, "a", "a", 0.0)])


def test_written_shards(spark, tmp_path):
    documents = samples.odd_documents(spark)
    sharding.write(documents, f"file://{tmp_path}/out", sharding.tree(8))
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == documents.count()
