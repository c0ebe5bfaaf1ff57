"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the hashed 4-, 5- and 6-grams of its lower-cased text, each counted
once. For each feature, the ratio is the log of how much more frequent it is in toxic
documents than in clean ones. All features whose ratio is far enough from zero, measured in its
own standard errors, are kept with the ratio as their value, and a ridge logistic regression is
fitted on them, both classes weighing the same.

Fitting uses a sample with a fixed bound for each class, and holds of its documents the features
in use only. Its size does not grow with the corpus, so one task fits it. Scoring runs in the scan:
whole texts, in blocks, without a shuffle. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.llm.tokens import forget
from layerscan.session import shared_folder

SIZES = (4, 5, 6)
BITS = 20
#: Documents of each class that a classifier is fitted on, at most.
SAMPLE = 4096
#: Documents that must have a feature, and standard errors of its ratio from zero: of 2^BITS
#: features without any meaning some 185 are as far off by chance, but 2,800 are three errors.
LEAST_DOCUMENTS = 3
LEAST_ERRORS = 3.75
RIDGE = 1.0
#: Characters hashed at once.
BLOCK = 1 << 20
#: Counts handed on at once.
SLICE = 1 << 16

HELD_OUT_FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Weight of each feature (weight times ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept
        if text:
            z += float(self.weights[features(text, self.weights)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def features(text: str, weights: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a text; with ``weights``, only those that weigh anything."""
    text = f" {text} "
    found = []
    reach = max(SIZES) - 1
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(
            text[at : at + BLOCK + reach].lower().encode("utf-32-le", "surrogatepass"), np.uint32
        )
        rolled = codes
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in SIZES:
                mixed = (rolled ^ (rolled >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                bucket = mixed >> np.uint32(32 - BITS)
                found.append(bucket if weights is None else bucket[weights[bucket] != 0])
        found = [np.unique(np.concatenate(found))] if found else []  # of all blocks so far
    return found[0] if found else np.empty(0, np.uint32)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """One row (``doc_id``, ``toxic``) for each document that may be learned from.

    Null ids and labels are left out; a document with several labels is toxic if one says so.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return (
        known.filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )


def _sample(documents: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``toxic`` and ``text`` of at most ``per_class`` documents of each class.

    They are drawn from the labels that have a text.
    """
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text")
    labels = labels.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [
        labels.filter(F.col("toxic") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 x per_class ids
    return (
        texts.join(chosen, "doc_id")
        .groupBy("doc_id")  # one row of a repeated document
        .agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
        .select("toxic", "text")
    )


def _counts(sample: DataFrame) -> DataFrame:
    """``feature``, and how many toxic documents (``bad``) and ``documents`` have it: at most
    2^BITS rows, added up in each task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        bad, every = (np.zeros(1 << BITS, np.int64) for _ in range(2))
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                found = features(text)
                every[found] += 1
                bad[found] += toxic
        found = np.flatnonzero(every)
        for at in range(0, len(found), SLICE):
            some = found[at : at + SLICE]
            yield pd.DataFrame({"feature": some, "bad": bad[some], "documents": every[some]})

    return (
        sample.mapInPandas(count, "feature long, bad long, documents long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("documents").alias("documents"))
    )


def _regress(
    columns: np.ndarray, lengths: np.ndarray, ratios: np.ndarray, toxic: np.ndarray
) -> np.ndarray:
    """Weights of the features and of the intercept: ridge logistic regression by Newton's method,
    each step solved by conjugate gradients, with both classes weighing half.

    ``columns`` are the features of one document after the other, ``lengths`` their numbers.
    """
    rows = np.repeat(np.arange(len(toxic)), lengths)

    def guesses(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, (ratios * w[:-1])[columns], len(toxic)) + w[-1]

    def gathered(v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, v[rows], len(ratios)) * ratios, v.sum())

    def solved(bend: np.ndarray, slope: np.ndarray) -> np.ndarray:
        change, left, way = np.zeros_like(slope), slope.copy(), slope.copy()
        now = first = left @ left
        for _ in range(200):
            if now <= 1e-10 * first:
                break
            curved = gathered(bend * guesses(way)) + RIDGE * way
            step = now / (way @ curved)
            change += step * way
            left -= step * curved
            now, before = left @ left, now
            way = left + now / before * way
        return change

    share = toxic.mean()
    importance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    weights = np.zeros(len(ratios) + 1)
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(guesses(weights), -30, 30)))
        slope = gathered(importance * (guess - toxic)) + RIDGE * weights
        change = solved(importance * np.maximum(guess * (1 - guess), 1e-6), slope)
        weights -= change
        if np.abs(change).max() < 1e-4:
            break
    return weights


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """A model from the labelled ``documents`` (``doc_id``, ``text``).

    If either class has no labelled text, all scores are the share of toxic labels.
    """
    known = training_labels(labels)
    share = known.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    toxic_share = ((share["toxic"] or 0) + 0.5) / (share["all"] + 1)
    nothing = Model(np.zeros(1 << BITS, np.float32), float(np.log(toxic_share / (1 - toxic_share))))
    spark = documents.sparkSession
    folder = shared_folder(spark, "toxicity")
    _sample(documents, known, per_class).write.parquet(folder)
    sample = spark.read.parquet(folder)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return nothing

    counts = _counts(sample).filter(F.col("documents") >= LEAST_DOCUMENTS)
    bad, good = F.col("bad") + 1, F.col("documents") - F.col("bad") + 1
    ratio = F.log(bad / (sizes[1] + 2)) - F.log(good / (sizes[0] + 2))
    errors = F.abs(F.col("ratio")) / F.sqrt(1 / bad + 1 / good)
    used = (
        counts.withColumn("ratio", ratio)
        .withColumn("errors", errors)
        .filter(F.col("errors") >= LEAST_ERRORS)
        .select("feature", "ratio")
        .orderBy("feature")
        .toPandas()  # at most 2^BITS rows
    )
    if not len(used):
        return nothing
    numbers, ratios = used["feature"].to_numpy(), used["ratio"].to_numpy()
    in_use = np.zeros(1 << BITS, bool)
    in_use[numbers] = True
    shared = spark.sparkContext.broadcast(in_use)  # 1 MB, whatever the input

    @F.pandas_udf("array<int>")
    def used_only(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, shared.value).astype(np.int32) for t in texts], dtype=object)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, toxic = [], []
        for batch in batches:
            columns += [np.searchsorted(numbers, row).astype(np.int32) for row in batch["columns"]]
            toxic += batch["toxic"].tolist()
        if toxic:
            lengths = np.array([len(row) for row in columns])
            weights = _regress(np.concatenate(columns), lengths, ratios, np.array(toxic, float))
            yield pd.DataFrame({"weights": [weights]})

    learned = (
        sample.select("toxic", used_only("text").alias("columns"))
        .repartition(1)  # at most 2 x per_class rows
        .mapInPandas(learn, "weights array<double>")
        .first()["weights"]
    )
    weights = np.zeros(1 << BITS, np.float32)
    weights[numbers] = np.array(learned[:-1]) * ratios
    # Both classes weighed the same; the labels hold them in other shares.
    return Model(weights, learned[-1] + float(np.log(toxic_share / (1 - toxic_share))))


def score(documents: DataFrame, model: Model) -> Column:
    """The score (0 to 1) of the ``text`` of ``documents``, as a column of it.

    Null and empty texts get the score of a text without features.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        forget()
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return of(documents["text"])


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` (1 from 0.5 on).

    Rows do not move; repeated ones are scored again. Columns called ``score`` or
    ``predicted`` are replaced.
    """
    scored = documents.withColumn("score", score(documents, model))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return documents.filter(score(documents, model) < 0.5)
