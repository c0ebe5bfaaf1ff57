"""Toxicity and quality: accuracy on labels that were held out, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerscan.llm import quality_model, queries, toxicity
from tests.llm import samples

SF = "/root/testdata/sf0.1"


def test_features_of_blocks_are_those_of_the_whole(monkeypatch):
    text = samples.prose(1, 500)
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert np.array_equal(toxicity.features(text), whole)
    assert len(toxicity.features("")) == 0 and len(toxicity.features("é")) == 0


def test_toxicity_on_held_out_labels(spark):
    found = queries.op10_toxicity(spark, SF).filter("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.97
    toxic, clean = rows[rows["toxic"] == 1]["score"], rows[rows["toxic"] == 0]["score"]
    above = (toxic.to_numpy()[:, None] > clean.to_numpy()[None]).mean()
    assert above > 0.97


def test_toxicity_by_plain_form(spark):
    """Scores of the query against dense Newton steps over sets of n-grams in plain Python."""
    rows, toxic = [], {}
    for n in range(300):
        toxic[n] = int(n % 3 == 0)
        words = ["vile muck", "rotten scum", "foul dregs"] if toxic[n] else ["kind folk", "fair play"]
        rows.append((n, f"{samples.prose(n, 30)} {words[n % len(words)]}"))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()) + [(-5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(documents, model).collect()}

    sets = {n: set(toxicity.features(text).tolist()) for n, text in rows}
    learned = [n for n in toxic if zlib.crc32(str(n).encode()) % 5]
    bad, every = Counter(), Counter()
    for n in learned:
        every.update(sets[n])
        bad.update(sets[n] if toxic[n] else ())
    n_bad = sum(toxic[n] for n in learned)
    ratio = {}
    for f, many in every.items():
        b, g = bad[f] + 1, many - bad[f] + 1
        r = math.log(b / (n_bad + 2)) - math.log(g / (len(learned) - n_bad + 2))
        if many >= toxicity.LEAST_DOCUMENTS and abs(r) / math.sqrt(1 / b + 1 / g) >= toxicity.LEAST_ERRORS:
            ratio[f] = r
    assert ratio
    value = lambda n: [ratio[f] * (f in sets[n]) for f in ratio] + [1.0]
    x, y = np.array([value(n) for n in learned]), np.array([toxic[n] for n in learned])
    share, weights = y.mean(), np.zeros(len(ratio) + 1)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(40):
        guess = 1 / (1 + np.exp(-x @ weights))
        curve = (x.T * (importance * guess * (1 - guess))) @ x + toxicity.RIDGE * np.eye(len(weights))
        weights -= np.linalg.solve(curve, x.T @ (importance * (guess - y)) + toxicity.RIDGE * weights)
    # The prior is that of all labels to learn from, also of those without a text.
    all_bad, all_labels = n_bad + (zlib.crc32(b"-5") % 5 != 0), len(learned) + (zlib.crc32(b"-5") % 5 != 0)
    prior = (all_bad + 0.5) / (all_labels + 1)
    for n in toxic:
        z = np.array(value(n)) @ weights + math.log(prior / (1 - prior))
        assert abs(found[n] - 1 / (1 + math.exp(-z))) < 1e-3


def test_labels_without_a_text_take_no_place_in_the_sample(spark):
    documents, labels = toy(spark)
    more = spark.range(1000, 1400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int"))
    known = toxicity.training_labels(labels.union(more))
    sample = toxicity._sample(documents, known, 10).collect()
    assert sorted(r["toxic"] for r in sample) == [0] * 10 + [1] * 10


def test_held_out_labels_are_not_learned(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn(
        "toxic",
        F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")),
    )
    one, other = (toxicity.training_labels(x).collect() for x in (labels, flipped))
    assert sorted(one) == sorted(other) and len(one)


def toy(spark):
    rows = [
        (n, samples.prose(n, 50) + (" vile muck" if n % 4 == 0 else ""), "en", "s") for n in range(80)
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = documents.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    return documents, labels


def test_toxicity_of_odd_rows(spark):
    documents, labels = toy(spark)
    # Null and repeated labels, and a repeated document.
    odd = labels.union(labels).union(spark.createDataFrame([(None, 1), (7, None)], "a long, b int"))
    model = toxicity.fit(documents.union(documents.limit(5)), odd)
    found = toxicity.scores(samples.odd_documents(spark), model).collect()
    assert len(found) == len(samples.odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if not r["text"]}) == 1
    kept = toxicity.keep(documents, model).collect()
    assert {r["doc_id"] for r in kept} == {n for n in range(80) if n % 4}
    assert toxicity.scores(samples.no_documents(spark), model).count() == 0


@pytest.mark.parametrize("kept", ["toxic = 0", "false"])
def test_toxicity_without_a_class(spark, kept):
    documents, labels = toy(spark)
    model = toxicity.fit(documents, labels.filter(kept))
    scores = {r["score"] for r in toxicity.scores(documents, model).collect()}
    assert len(scores) == 1 and max(scores) <= 0.5


def test_quality_on_held_out_labels(spark):
    found = queries.op6_quality(spark, SF).filter("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_sparse_hosts_are_shrunk_more(spark):
    good, bad = samples.prose(1, 80), "!!! ### $$$ " * 20
    rows, labels = [], []
    for n in range(400):
        host = f"h{n % 4}"
        poor = n % 10 < (8 if host == "h0" else 1)
        rows.append((n, bad if poor else f"{good} {n}", host, "p"))
        labels.append((n, 0 if poor else 1))
    rows += [(1000, bad, "sparse", "p"), (1001, bad, "sparse", "q")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality_model.scores(documents, known).join(documents, "doc_id").toPandas()
    host = found.groupby("source")["host_posterior"].mean()
    assert host["h0"] < host["sparse"] < host["h1"]


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (6, None), (7, 0)], "doc_id long, quality int")
    found = quality_model.scores(samples.odd_documents(spark), labels).collect()
    assert len(found) == len(samples.odd_rows())
    assert all(0 <= r["score"] <= 1 for r in found)
    assert quality_model.scores(samples.no_documents(spark), labels).count() == 0
    alone = quality_model.scores(samples.odd_documents(spark), labels.filter("false")).collect()
    assert {r["evidence"] for r in alone} == {0.0}


def test_bins_and_labels_are_never_collected_by_their_files_size(spark, tmp_path):
    """Tables whose files are far below the limit for sending a table to every executor."""
    ids = spark.range(1, 2001).withColumnRenamed("id", "doc_id")
    bins = F.array(*[F.lit(n) for n in range(quality_model.MEASURES - 1)], (F.col("doc_id") % 7).cast("int"))
    rows = ids.withColumn("bins", bins)
    again = rows.filter("doc_id <= 9").withColumn("bins", F.transform("bins", lambda x: x + 1))
    none = spark.createDataFrame([(None, [0] * quality_model.MEASURES)], "doc_id long, bins array<int>")
    rows.union(again).union(none).write.parquet(f"{tmp_path}/rows")
    labels = ids.filter("doc_id % 3 = 0").withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    odd = spark.createDataFrame([(6, 1), (9, 0), (9, None), (None, 1), (5000, 1)], "a long, b int")
    labels.union(odd).write.parquet(f"{tmp_path}/labels")

    found = quality_model._training(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("rows", "labels")))
    got = {r["doc_id"]: (r["bins"][-1], r["good"]) for r in found.collect()}
    good = {n: n % 2 for n in range(3, 2001, 3)} | {9: 0}
    assert got == {n: (n % 7, g) for n, g in good.items() if zlib.crc32(str(n).encode()) % 5}
    assert found.count() == len(got)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", ["FEW_ROWS", "FEW_BYTES"])
def test_records_are_sent_to_all_only_if_few(spark, monkeypatch, limit):
    rows = [(n, samples.prose(n, 30), f"h{n % 50}", f"p{n % 3}") for n in range(400)]
    rows += [(1000, "", None, "p1"), (1001, "one", "h1", None), (1001, "one", "h1", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    few = quality_model.scores(documents, labels)
    assert "BroadcastHashJoin" in plan(few)
    monkeypatch.setattr(quality_model, limit, 0)
    many = quality_model.scores(documents, labels)
    assert "Broadcast" not in plan(many)
    one, other = (sorted(map(tuple, x.collect())) for x in (few, many))
    assert len(one) == len(rows) and all(a == pytest.approx(b) for a, b in zip(one, other, strict=True))
