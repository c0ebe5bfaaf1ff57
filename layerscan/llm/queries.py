"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.llm import (
    bpe,
    html_text,
    lexical,
    mixing,
    near_dedup,
    nearest,
    packing,
    quality_model,
    quality_rules,
    records,
    sharding,
    spelling,
    toxicity,
)
from layerscan.llm.oracles import ORACLES  # noqa: F401  the SQL of those that SQL can express
from layerscan.session import configure, shared_folder


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows and bytes sent to a Python worker at once: few, as texts may be long.
ARROW_ROWS, ARROW_BYTES = "1000", "4m"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package on its executors and small batches for their workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return configure(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packed_documents(_table(spark, sf_dir, "documents"))


def packed_documents(documents: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(documents, tokenizer_file("word_bpe_49k.json"))
    digests = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return packing.pack(digests)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids, and of the text decoded from them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(documents, tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


SHARDS = 8


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard when there is one more."""
    shards = sharding.tree(SHARDS)
    grown = sharding.shard_of(F.col("doc_id"), sharding.with_shard(shards))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.with_slots(sharding.assign(sized, shards))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        grown.alias("grown_shard"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    found = near_dedup.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    rows = nearest.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest.search(rows, rows.filter(F.col("id") % 100 == 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels that are not held out."""
    documents, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    fold = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return quality_model.scores(documents, labels).select("*", fold)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, verdict and text without frequent lines of every document."""
    found = quality_rules.verdicts(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "text",
    )


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to framed files and read back from them."""
    documents = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "records")
    records.write(
        documents, folder, tokenizer_file("byte_bpe_50k.json"), end_id=2, id_bytes=2
    )
    found = records.read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_pages(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.scores(documents.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources to weights of 5, 2 and 1 takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(*(_table(spark, sf_dir, t) for t in ("documents", "benchmark")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commoner form and the root of every word."""
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_near_dedup": op4_near_dedup,
    "op5_nearest": op5_nearest,
    "op6_quality": op6_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_records": op8_records,
    "op9_html": op9_html,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_lexical": op12_lexical,
    "op13_spelling": op13_spelling,
}
