"""The pipeline against the plain form of each stage, and odd rows through every stage."""

import corpus_pipeline
from layerscan.llm import near_dedup, queries, toxicity
from tests.llm import samples
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_packing import check_places
from tests.llm.test_quality_rules import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.scores(documents, model).select("doc_id", "text", "source", "predicted")
    clean = [tuple(r)[:3] for r in scored.collect() if not r["predicted"]]
    kept = brute_kept(clean)
    good = [(d, t) for d, t, _ in clean if kept[d]]
    classes = brute_classes(good, near_dedup.SIMILARITY)
    left = {d for d, _ in good if d in set(classes.values())}

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == left and 0 < len(left) < documents.count()
    whole = queries.op1_packing(spark, SF).collect()
    pieces = lambda found: {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found}
    assert pieces(rows) == {p for p in pieces(whole) if p[0] in left}
    check_places(rows, 2048)


def test_stages_keep_columns_of_odd_rows(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "near_dedup", "packing"]
    for documents in (samples.odd_documents(spark), samples.no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, documents, SF)
            assert kept.schema.names == documents.schema.names, name
            assert kept.count() <= documents.count()
        corpus_pipeline.pack_sequences(spark, documents, SF).count()
