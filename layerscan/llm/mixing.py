"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

Sources weigh a fixed pattern of numbers in code point order, nulls last, and share the words of the
whole corpus by these weights. A source gives at most a fixed number of epochs; what it can't give
is shared anew by weight. The share is the water level at which the capped targets fill the sum.

A source's budget is spent on complete epochs first. The rest goes to documents in the order of an
exponential key, ``-ln(u) / weight``: the order in which weighted sampling without replacement
draws them. ``u`` is a hash of the document, so reruns draw alike. The document that crosses
the budget gives its first words only, so budgets are met to the word.

Rows are ordered by source and key over the whole cluster, in ranges of like size, so a source
with a third of all rows takes a third of the ranges. A running sum inside each range starts from
the sum of the ranges before it. Only tables with one row for each source or range go beyond that.

Rows: a null text has no words and takes nothing; a null source is a source of its own, the
last; a null id is hashed as an empty one. Repeated rows are rows of their own, and which of them is
cut makes no difference. A weight that is null or not above 0 puts a document behind all others.
A text of any length is counted whole. An empty table gives an empty result. Other columns are
left out unless asked for; those that are called as a result's column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerscan.session import shared_folder

#: Weights of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Epochs that a source gives at most.
MOST_EPOCHS = 3
#: Rows of a range, about; there are at least as many ranges as shuffle partitions.
RANGE_ROWS = 1 << 20

#: What separates words, and the characters that count as symbols.
WORD = r"[^\x20\x09-\x0D]+"
BEFORE_WORD = r"[\x20\x09-\x0D]*"
SYMBOLS = "#*$%&|<>"
HASH_DIGITS = 13

RESULTS = ("size", "source_size", "target", "epochs", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plainness(text: Column, size: Column) -> Column:
    """A document's quality weight from its text alone: near 1 for plain words, lower the more
    of ten symbols come with a word."""
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return (size + 1) / (size + 1 + 10 * F.coalesce(symbols, F.lit(0)))


def draw(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1, both excluded, from a hash of id and text."""
    named = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    digits = F.substring(F.md5(named.cast("binary")), 1, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(16**HASH_DIGITS)


def water_level(sources: DataFrame, most_epochs: float) -> float:
    """The words for each unit of weight at which the targets of ``sources`` (``source_size``,
    ``weight``), capped at ``most_epochs`` times their size, add up to all words.

    Each round caps those that are above and shares the rest anew, in one aggregate over the table.
    """
    cap = F.col("source_size") * most_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    capped = 0
    while True:
        level = (total - capped) / weight
        full = cap <= level * F.col("weight")
        capped, left = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if left is None or left == weight:
            return level
        weight = left


def targets(sources: DataFrame, most_epochs: float) -> DataFrame:
    """``sources`` with ``target``, the whole ``epochs`` in it and the ``rest`` in words."""
    level = water_level(sources, most_epochs)
    cap = (F.col("source_size") * most_epochs).cast("double")
    budget = F.floor(F.col("target") + 0.5)
    return (
        sources.withColumn("target", F.least(cap, level * F.col("weight")))
        .withColumn("epochs", F.coalesce(F.floor(budget / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )


def _numbered(by_range: DataFrame) -> DataFrame:
    """Sources of ``by_range`` (``range``, ``key_source``, ``words``) with their size and their number in
    order, from 0. Ranges follow the order of sources, so a source's number is how many begin in
    ranges before its first, and its place among those that begin there."""
    sources = by_range.groupBy("key_source").agg(
        F.min("range").alias("range"), F.sum("words").alias("source_size")
    )
    begin = sources.groupBy("range").count()  # one row for each range at most
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("key_source")) - 1
    return sources.join(begin, "range").select(
        "key_source", "source_size", (F.col("first") + within).alias("number")
    )


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    quality: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``source``, the columns named in ``carry``, ``size``, ``source_size``, ``target``, ``epochs`` and
    ``taken`` of every document.

    ``quality`` is a column of ``documents`` (default: ``plainness``); the higher, the likelier a
    document is in the part of an epoch. ``taken`` counts words, each epoch's anew. Rows
    and their order are written to the shared folder, so a task that runs again sums the same ones.
    """
    spark = documents.sparkSession
    kept = [c for c in dict.fromkeys(("doc_id", "source", *carry)) if c not in RESULTS]
    text = documents["text"]
    sized = documents.withColumn("__size", word_count(text))
    weight = plainness(text, F.col("__size")) if quality is None else quality.cast("double")
    sized = sized.withColumns({"__draw": draw(documents["doc_id"], text), "__weight": weight})
    usable = F.coalesce(F.col("__weight") > 0, F.lit(False)) & ~F.isnan("__weight")
    key = F.when(usable, -F.ln("__draw") / F.col("__weight")).otherwise(F.lit(float("inf")))

    folder = shared_folder(spark, "mix")
    sized.select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__draw").alias("key_draw"),
        key.alias("key"),
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("key_source"),
    ).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    order = ["key", "key_draw", "doc_id", "size"]
    rows.repartitionByRange(ranges, "key_source", *order).withColumn(
        "range", F.spark_partition_id()
    ).write.parquet(f"{folder}/ranges")
    rows = spark.read.parquet(f"{folder}/ranges")
    rows.groupBy("range", "key_source").agg(F.sum("size").alias("words")).write.parquet(f"{folder}/sums")
    by_range = spark.read.parquet(f"{folder}/sums")  # one row for each range and source in it
    weighing = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    _numbered(by_range).withColumn("weight", weighing).write.parquet(f"{folder}/sources")
    sources = targets(spark.read.parquet(f"{folder}/sources"), most_epochs)

    earlier = Window.partitionBy("key_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    starts = starts.join(sources.select("key_source", "source_size", "target", "epochs", "rest"), "key_source")
    within = Window.partitionBy("range", "key_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["range", "key_source"]).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    drawn = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + drawn).select(*kept, *RESULTS)


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy of each document of ``mixed`` (with ``text`` carried), its
    ``epoch`` from 1, and the ``text`` of that copy, cut after the words that the mix takes."""
    copies = F.ceil(F.col("taken") / F.nullif("size", F.lit(0))).cast("int")
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    heads = F.regexp_extract_all("text", F.lit(f"({BEFORE_WORD}{WORD})"))
    cut = F.array_join(F.slice(heads, F.lit(1), left.cast("int")), "")
    rows = mixed.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    return rows.withColumn("text", F.when(left < F.col("size"), cut).otherwise(F.col("text")))
