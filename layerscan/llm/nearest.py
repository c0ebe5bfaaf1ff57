"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned so that the signs lose least
(iterative quantisation), on a sample with a fixed bound. A code is split into substrings, and
each has an index of its own. Codes within a Hamming radius agree with the query's, in one
substring at least, to within the radius over the number of substrings; so probing every index
for the values that near finds all of them. They are checked by their whole code,
and what stays is ranked by its exact distance.

The radius comes from the sample: nearly all of its true neighbours lie within it. In
more data neighbours are nearer, so the radius finds no fewer of them. Where a block of rows has
fewer than k codes within it, the radius grows there until k are found.

Rows are dealt into blocks, queries too, and every pair of blocks is searched on its own:
bounded memory, and only k rows for each query and block are passed on. Vectors of each size are
a space of their own, with codes learned from it; they travel as a row to the blocks of that size.

Every row is a candidate and may be a query, rows with one id too: a query leaves out one row, its
own. Rows equal in id and vector are counted once and given back as often as there are. Very long
vectors make smaller blocks. An empty table has no neighbours; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerscan.session import shared_folder

#: Vectors of a size that its rotations and radius are learned from, at most; of them, queries tried.
SAMPLE = 4096
TRIED = 512
#: Rotations (each gives as many bits as there are dimensions), and bits of a substring.
ROTATIONS = 4
SUBSTRING = 16
#: Share of the sample's true neighbours that lie within the radius.
WITHIN = 0.98
#: Rows and queries of a block at most, and components of its vectors.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
BLOCK_VALUES = 1 << 22

_BITS_SET = np.array([bin(n).count("1") for n in range(1 << SUBSTRING)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """What turns vectors into codes, and the radius to search."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (vectors - self.mean) @ self.rotation > 0
        spare = -signs.shape[1] % SUBSTRING
        packed = np.packbits(np.pad(signs, ((0, 0), (0, spare))), axis=1)
        return packed.view(np.uint16)


def learn(sample: np.ndarray, k: int) -> Codes:
    """Rotations by alternating signs and the best rotation onto them; then the radius."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    size = sample.shape[1]
    rotations = []
    for number in range(ROTATIONS):
        start = np.random.default_rng(number).normal(size=(size, size))
        rotation = np.linalg.qr(start)[0]
        for _ in range(20):
            left, _, right = np.linalg.svd(centred.T @ np.where(centred @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        rotations.append(rotation)
    codes = Codes(mean, np.hstack(rotations), 0)
    bits = codes.of(sample)
    apart = []
    for n in range(min(TRIED, len(sample))):
        square = ((sample - sample[n]) ** 2).sum(axis=1)
        near = np.argsort(square, kind="stable")[: k + 1]
        apart += _BITS_SET[bits[near[near != n]] ^ bits[n]].sum(axis=1).tolist()
    radius = int(np.ceil(np.quantile(apart, WITHIN))) if apart else codes.rotation.shape[1]
    return Codes(mean, codes.rotation, radius)


class Index:
    """One block of rows: for each substring, its values in order and the rows that have them."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        self.codes, self.ids, self.vectors, self.copies = codes, ids, vectors, copies
        self.bits = codes.of(vectors)
        self.tables = []
        for column in self.bits.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of one."""
        seen = np.zeros(len(self.ids), bool)
        each = radius // len(self.tables)
        for part, (values, starts, order) in zip(code, self.tables, strict=True):
            near = np.flatnonzero(_BITS_SET[values ^ part] <= each)
            many = starts[near + 1] - starts[near]
            place = np.arange(many.sum()) + np.repeat(starts[near] - np.cumsum(many) + many, many)
            seen[order[place]] = True
        rows = np.flatnonzero(seen)
        return rows[_BITS_SET[self.bits[rows] ^ code].sum(axis=1) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int):
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id."""
        radius = self.codes.radius
        same = np.flatnonzero(self.ids == query_id)
        own = same[(self.vectors[same] == query).all(axis=1)]
        left = self.copies
        if len(own):
            left = left.copy()
            left[own] -= 1
        wanted = min(k, left.sum())
        while True:
            rows = self.within(code, radius)
            rows = rows[left[rows] > 0]
            if left[rows].sum() >= wanted:
                break
            radius += SUBSTRING
        apart = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], apart))[:k]
        many = np.minimum(left[rows[best]], k)
        return np.repeat(self.ids[rows[best]], many)[:k], np.repeat(apart[best], many)[:k]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``vector`` (doubles) and ``copies`` of the rows that take part, written once.

    Left out: null ids; vectors that are null, empty, zero, or hold null or non-finite components.
    Rows equal in id and vector are one, with their number in ``copies``.
    """
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(vector, lambda x: x != 0)
    rows = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    folder = shared_folder(rows.sparkSession, "vectors")
    (
        rows.select(
            F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
        )
        .groupBy("id", "vector")
        .agg(F.count("*").alias("copies"))
        .write.parquet(folder)
    )
    return rows.sparkSession.read.parquet(folder)


def _sizes(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``size`` of vectors, their number, and of how many blocks they are."""
    each = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("size"))))
    counted = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias(f"n_{name}"))
    return counted.withColumn(name, F.ceil(F.col(f"n_{name}") / each))


def _mark(*seed: str) -> Column:
    return F.xxhash64(*(F.lit(x) for x in seed), "id", "vector")


_MODEL = "size int, radius int, mean binary, rotation binary"


def _learned(rows: DataFrame, k: int) -> DataFrame:
    """Codes of each size as a row, learned from the ``SAMPLE`` rows of least hash.

    Hashes below a share that about twice as many rows reach are all that is shuffled for it.
    """
    share = F.pmod(_mark(), F.lit(1 << 40)) / float(1 << 40)
    some = rows.withColumn("mark", _mark()).filter(share * F.col("n_blocks") < 2 * SAMPLE)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["mark", "id"]).head(SAMPLE)
        codes = learn(np.stack(sample["vector"]), k)
        model = (sample["size"].iloc[0], codes.radius, codes.mean.tobytes(), codes.rotation.tobytes())
        return pd.DataFrame([model], columns=["size", "radius", "mean", "rotation"])

    return some.select("size", "mark", "id", "vector").groupBy("size").applyInPandas(fit, _MODEL)


def _codes(model) -> Codes:
    mean = np.frombuffer(model["mean"])
    return Codes(mean, np.frombuffer(model["rotation"]).reshape(len(mean), -1), model["radius"])


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` nearest rows found.

    Both tables as ``usable`` gives them. A query's own row is no candidate; candidates have the
    size of its vector. Equal distances are ordered by id. Without rows or queries there are none.
    A query row that comes several times has its answer as often.
    """
    # One row for each size of vectors. Different sizes sum up to at most all components, so their
    # number is below the square root of twice that, and the table may go to every executor.
    sizes = F.broadcast(
        _sizes(rows, block_rows, "blocks").join(_sizes(queries, BLOCK_QUERIES, "parts"), "size")
    )
    rows = rows.withColumn("size", F.size("vector")).join(sizes, "size")
    # Columns of their own, as queries may be rows of the same table.
    queries = queries.select(*[F.col(c).alias(c) for c in ("id", "vector", "copies")])
    queries = queries.withColumn("size", F.size("vector")).join(sizes, "size")
    folder = shared_folder(rows.sparkSession, "codes")
    _learned(rows, k).write.parquet(folder)
    models = rows.sparkSession.read.parquet(folder).join(sizes, "size")

    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    dealt = rows.withColumn("block", F.pmod(_mark(), F.col("blocks"))).select(
        "size", "block", every("parts").alias("part"), "id", "vector", "copies"
    )
    kinds = {"radius": "int", "mean": "binary", "rotation": "binary"}
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    # Rows with a model have numbers, not nulls, so that pandas keeps long numbers whole.
    number = [F.lit(0).cast("long").alias(n) for n in ("id", "copies", "twin")]
    asked = (
        queries.withColumn("part", F.pmod(_mark(), F.col("parts")))
        .withColumn("twin", _mark("twin"))
        .select(
            "size", every("blocks").alias("block"), "part", "id", "vector", "copies", "twin", *nothing
        )
        .unionByName(
            models.withColumn("block", every("blocks")).select(
                "size", "block", every("parts").alias("part"), *number, "radius", "mean", "rotation"
            ),
            allowMissingColumns=True,
        )
    )

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        told = right["radius"].notna()
        right, model = right[~told], right[told]
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            codes = _codes(model.astype({"radius": int}).iloc[0])
            index = Index(
                codes, left["id"].to_numpy(), np.stack(left["vector"]), left["copies"].to_numpy()
            )
            asked_for = np.stack(right["vector"])
            for query_id, twin, copies, query, code in zip(
                right["id"].tolist(), right["twin"].tolist(), right["copies"].tolist(),
                asked_for, codes.of(asked_for), strict=True,
            ):
                ids, apart = index.nearest(query_id, query, code, k)
                found += [
                    (query_id, twin, copies, i, d)
                    for i, d in zip(ids.tolist(), apart.tolist(), strict=True)
                ]
        return pd.DataFrame(found, columns=["query_id", "twin", "copies", "vec_id", "score"])

    near = (
        dealt.groupBy("size", "block", "part")
        .cogroup(asked.groupBy("size", "block", "part"))
        .applyInPandas(find, "query_id long, twin long, copies long, vec_id long, score double")
    )
    # Queries with one id are told apart by a hash of their vector.
    order = Window.partitionBy("query_id", "twin").orderBy("score", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "query_id", "rank", "vec_id", "score"
    )
