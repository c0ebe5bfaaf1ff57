"""Document quality by hierarchical empirical Bayes: the text's own evidence, its host's and
its path's record.

Evidence: a text's measures fall into bins, and the labelled documents tell for each bin how much
likelier good documents are to be in it than bad ones; the logs add up (naive Bayes).
Record: the expected quality of all documents of a host is averaged and shrunk towards the mean
of all; the same for each path below its host. How strongly is taken from the data: the more
hosts differ beyond chance, the less they are shrunk; sparse ones are shrunk most. A
document's own part is taken out of the record it is judged with.

All steps are columns and grouped sums. What reaches the driver is one row for each bin and one
for each level, whatever the size of the corpus, and the records of hosts and paths if they are few
by count, to be sent to every executor. Bins and labels are always shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.llm.quality_rules import FEW_ROWS, SPACE, let, words
from layerscan.llm.toxicity import held_out
from layerscan.session import shared_folder

BINS = 16
#: Characters whose shares are measured, and the number of all measures.
KINDS = ("0123456789", "#*$%&<>", "|", "!?", ".,;:", "/@_=+~^")
MEASURES = 6 + len(KINDS)
#: Rows of records that a host's or path's prior counts for, at least and at most.
STRENGTH = (2.0, 10_000.0)
#: Bytes of names in the records that are sent to every executor, at most.
FEW_BYTES = 8 << 20


def with_bins(rows: DataFrame) -> DataFrame:
    """``rows`` with ``bins``: a bin, from 0 to 15, for each thing measured in ``text``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    both = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))
    # Cut into words and into lines once.
    rows = rows.withColumns({"__words": let(words(text), both), "__lines": let(lines, both)})

    size = F.greatest(F.char_length(text), F.lit(1))
    count = lambda kept: F.char_length(text) - F.char_length(F.translate(text, kept, ""))
    share = lambda part: F.least(F.lit(BINS - 1), F.floor(F.sqrt(part) * BINS)).cast("int")
    log = lambda n: F.least(F.lit(BINS - 1), F.floor(F.log2(n + 1))).cast("int")
    n_words, n_lines = F.col("__words.n"), F.col("__lines.n")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}", ""))
    bins = [
        log(n_words),
        share(F.col("__words.d") / F.greatest(n_words, F.lit(1))),
        log(F.char_length(F.translate(text, SPACE, "")) / F.greatest(n_words, F.lit(1))),
        share(capitals / size),
        *[share(count(kind) / size) for kind in KINDS],
        share(F.col("__lines.d") / F.greatest(n_lines, F.lit(1))),
        log(n_lines),
    ]
    return rows.withColumn("bins", F.array(*bins)).drop("__words", "__lines")


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``bins`` and ``good`` of the labelled rows that may be learned from, one for each id.

    Both sides take a few bytes a row in files and a hundred in memory. By the size of its file
    Spark would collect a table of millions of rows to send it to all, so both are shuffled.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = (
        known.filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    )
    own = rows.groupBy("doc_id").agg(F.min("bins").alias("bins"))
    return own.join(known.hint("merge"), "doc_id")


def _evidence(rows: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """Log-likelihood ratio of every bin of every measure, and the log-odds of a good label."""
    counts = (
        _training(rows, labels)
        .select("good", F.posexplode("bins").alias("measure", "bin"))
        .groupBy("measure", "bin")
        .agg(F.sum("good").alias("good"), F.count("*").alias("all"))
        .collect()  # a row for each bin
    )
    good = sum(r["good"] for r in counts if r["measure"] == 0)
    bad = sum(r["all"] - r["good"] for r in counts if r["measure"] == 0)
    ratios = [[0.0] * BINS for _ in range(MEASURES)]
    for r in counts:
        ratios[r["measure"]][r["bin"]] = math.log((r["good"] + 0.5) / (good + 0.5 * BINS)) - math.log(
            (r["all"] - r["good"] + 0.5) / (bad + 0.5 * BINS)
        )
    return ratios, math.log((good + 0.5) / (bad + 0.5))


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many rows the prior counts for, by moments: what groups (``n``, ``s``) vary
    about their ``prior`` beyond chance. One row reaches the driver."""
    chance = prior * (1 - prior)
    row = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2).alias("seen"),
        F.sum(chance).alias("chance"),
        F.sum((F.col("n") - 1) * chance).alias("room"),
    ).first()
    if not row["room"]:
        return STRENGTH[1]
    share = max(0.0, (row["seen"] - row["chance"]) / row["room"])
    return min(STRENGTH[1], max(STRENGTH[0], 1 / share - 1 if share else STRENGTH[1]))


def _meet(rows: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a written table of records, one for each ``on``.

    Its rows and their names' bytes are counted: few are sent to every executor as they are, more
    are shuffled. Files tell neither, as they are compressed.
    """
    names = F.sum(sum((F.octet_length(n) for n in on), F.lit(0)).cast("long"))
    size = records.agg(F.count("*").alias("rows"), names.alias("bytes")).first()
    few = size["rows"] <= FEW_ROWS and (size["bytes"] or 0) <= FEW_BYTES
    return rows.join(records.hint("broadcast" if few else "merge"), on)


def scores(
    documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang"
) -> DataFrame:
    """``doc_id``, ``evidence`` (log-likelihood ratio), ``host_posterior``, ``path_posterior``,
    ``score`` (0 to 1, higher: better) and ``predicted`` of every row.

    Null and empty texts are measured as empty. Null hosts are one host, null paths one path of
    their host. Repeated rows get a row each. Without labels all evidence is zero.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "quality")
    named = documents.select(
        "doc_id",
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        "text",
    )
    with_bins(named).drop("text").write.parquet(f"{folder}/bins")
    rows = spark.read.parquet(f"{folder}/bins")
    ratios, odds = _evidence(rows, labels)
    parts = [F.get(F.lit(r), F.col("bins")[n]) for n, r in enumerate(ratios)]
    judged = rows.select("doc_id", "host", "path", sum(parts[1:], parts[0]).alias("evidence"))
    judged = judged.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + odds))))

    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths.write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts.write.parquet(f"{folder}/hosts")
    hosts = spark.read.parquet(f"{folder}/hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    m_host = _strength(hosts, F.lit(mean))
    hosts = hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"})
    shrunk = (F.col("host_s") + m_host * mean) / (F.col("host_n") + m_host)
    paths = _meet(paths, hosts, ["host"])
    m_path = _strength(paths, shrunk)
    paths.write.parquet(f"{folder}/records")
    records = spark.read.parquet(f"{folder}/records")

    # The record without the document itself.
    own = F.col("p")
    host_posterior = (F.col("host_s") - own + m_host * mean) / (F.col("host_n") - 1 + m_host)
    path_posterior = (F.col("s") - own + m_path * F.col("host_posterior")) / (
        F.col("n") - 1 + m_path
    )
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    return (
        _meet(judged, records, ["host", "path"])
        .withColumn("host_posterior", host_posterior)
        .withColumn("path_posterior", path_posterior)
        .withColumn("score", score)
        .select(
            "doc_id", "evidence", "host_posterior", "path_posterior", "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )
