"""Rows with nulls, empty, very long, equal and repeated values, and columns with taken names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that operators give to columns of their own.
TAKEN = (
    "ids decoded score predicted shard slot sequence_id offset class_id kept first node bucket "
    "leader host line words salt row bin group length block id vector p evidence features toxic"
).split()


def prose(seed: int, count: int) -> str:
    rnd = random.Random(seed)
    syllables = "an er the in on ou re st tion ly".split()
    words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(count)]
    return " ".join(words)


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a"),
        (2, prose(2, 60), "en", "a"),
        (3, prose(3, 60) + "\n" + prose(4, 40), None, None),
        (3, prose(3, 60) + "\n" + prose(4, 40), None, None),
        (4, "", "en", "a"),
        (5, None, "en", "b"),
        (None, prose(5, 40), "fr", "b"),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, "x" * 50_000, "en", "a"),
        (8, " \n\t \n", "en", "a"),
        (9, "<|endoftext|> a\n\n\n b 　 \U0001f600é  ", "en", "a"),
        (-10, "one two three", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    return rows.withColumns({name: F.lit("taken") for name in TAKEN})


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
