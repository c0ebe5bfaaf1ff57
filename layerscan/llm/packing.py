"""Packing of token sequences: best fit, then a local search by exchanges.

Pieces are dealt into groups of bounded size and every group is packed on its own, so no
task sees more than one group however large the corpus is. A group falls short of the
best possible by a fraction of one sequence in the usual case.

Within a group pieces of equal length are interchangeable, so bins hold lengths only; rows are
put in at the end. Best fit decreasing comes first. While more bins are open than the
total length needs, the search moves a piece into a gap, exchanges one piece for
a longer one, or one for two, always so that the sum of squared fills rises. That drains the
emptiest bins until some of them are empty; it ends when no such step is left.
"""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.llm.tokens import library_words
from layerscan.session import shared_folder

CAPACITY = 2048
#: Pieces packed by one task.
GROUP_ROWS = 16_384


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins by best fit: longest first, each into the smallest gap that holds it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for length in sorted(lengths, reverse=True):
        fitting = gaps >> length
        if fitting:
            gap = length + (fitting & -fitting).bit_length() - 1
            place = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, place = capacity, len(bins)
            bins.append([])
        bins[place].append(length)
        if gap > length:
            by_gap[gap - length].append(place)
            gaps |= 1 << (gap - length)
    return bins


class _Underfull:
    """The bins with a gap, with an index of the lengths and sums of two that they hold."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.bins = bins
        self.fill = [sum(b) for b in bins]
        self.have: dict[int, set[int]] = {}  # sum of one or two lengths to its bins
        self.sums = 0  # bit s: some bin holds s
        self.holds: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]
        for place in range(len(bins)):
            self._index(place)

    def _index(self, place: int) -> None:
        """Bring the index of one bin up to date."""
        for total in self.holds[place]:
            self.have[total].discard(place)
            if not self.have[total]:
                self.sums &= ~(1 << total)
        items = self.bins[place]
        held: dict[int, tuple[int, ...]] = {}
        for i, one in enumerate(items):
            for other in items[:i]:
                held.setdefault(one + other, (one, other))
        held |= {one: (one,) for one in items}
        for total in held:
            self.have.setdefault(total, set()).add(place)
            self.sums |= 1 << total
        self.holds[place] = held

    def _donor(self, place: int, total: int, gain: int) -> int | None:
        """The emptiest other bin that holds the sum, if taking it raises the squares."""
        others = [p for p in self.have[total] if p != place]
        donor = min(others, key=self.fill.__getitem__, default=None)
        if donor is not None and self.fill[place] + gain > self.fill[donor]:
            return donor
        return None

    def step(self, place: int) -> int | None:
        """Fill a bin's gap as far as one exchange can; the bin that gave, or none."""
        gap = self.capacity - self.fill[place]
        best: tuple[int, int, int, int] | None = None
        for given in [0, *dict.fromkeys(self.bins[place])]:
            within = (self.sums >> (given + 1)) & ((1 << gap) - 1)
            while within:
                gain = within.bit_length()
                if best is not None and gain <= best[0]:
                    break
                donor = self._donor(place, given + gain, gain)
                if donor is not None:
                    best = gain, given, given + gain, donor
                    break
                within ^= 1 << (gain - 1)
        if best is None:
            return None
        gain, given, taken, donor = best
        for length in self.holds[donor][taken]:
            self.bins[donor].remove(length)
            self.bins[place].append(length)
        if given:
            self.bins[place].remove(given)
            self.bins[donor].append(given)
        self.fill[place] += gain
        self.fill[donor] -= gain
        self._index(place)
        self._index(donor)
        return donor


def improve(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins until bins empty or no exchange helps."""
    total = sum(map(sum, bins))
    spare = len(bins) - -(-total // capacity)
    full = [b for b in bins if sum(b) == capacity]
    state = _Underfull([b for b in bins if sum(b) < capacity], capacity)
    order: list[tuple[int, int]] = []  # (fill, bin), fullest last
    for place, fill in enumerate(state.fill):
        insort(order, (fill, place))
    while spare > 0 and order:
        fill, place = order.pop()
        if fill != state.fill[place] or fill in (0, capacity):
            continue
        donor = state.step(place)
        if donor is None:
            continue  # comes back when another exchange changes it
        if not state.bins[donor]:
            spare -= 1
        for changed in (donor, place):
            insort(order, (state.fill[changed], changed))
    return full + [b for b in state.bins if b]


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequence number and offset of every row (``row``, ``length``) of one group."""
    by_length: dict[int, list[int]] = {}
    for row, length in zip(rows["row"].tolist(), rows["length"].tolist(), strict=True):
        by_length.setdefault(length, []).append(row)
    for same in by_length.values():
        same.sort(reverse=True)
    out = []
    bins = improve(best_fit(rows["length"].tolist(), capacity), capacity)
    for number, items in enumerate(bins):
        offset = 0
        for length in sorted(items, reverse=True):
            out.append((by_length[length].pop(), number, offset))
            offset += length
    return pd.DataFrame(out, columns=["row", "bin", "offset"])


def token_pieces(
    documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document: ``doc_id``, ``piece``, ``start``,
    ``length`` and ``ids`` (binary, little-endian unsigned 32-bit).

    A document is its text's ids and ``end_id``; null and empty texts are ``end_id`` alone.
    Only longer ones are cut. Repeated rows give repeated pieces; a null ``doc_id`` stays
    null; other columns are left out.
    """
    end = end_id.to_bytes(4, "little")

    @F.pandas_udf("binary")
    def ids_of(texts: pd.Series) -> pd.Series:
        words = library_words(tokenizer, "I")
        return pd.Series([words.text(t) + end for t in texts], dtype=object)

    size = F.floor(F.length("ids") / 4)
    last = F.floor((size - 1) / capacity).cast("int")
    piece = lambda i: F.struct(
        i.alias("piece"),
        (i.cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), size - i.cast("long") * capacity).alias("length"),
        F.substring(F.col("ids"), i * (4 * capacity) + 1, F.lit(4 * capacity)).alias("ids"),
    )
    return (
        documents.select("doc_id", ids_of("text").alias("ids"))
        .select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), last), piece)))
    )


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to ``capacity``) with
    ``sequence_id`` and ``offset``.

    Sequences are gapless from 0 and hold at most ``capacity``. Every row gets a place,
    repeated rows one each. Full pieces are sequences of their own and are not sorted
    into groups. Columns ``sequence_id`` and ``offset`` that were there are replaced. An
    empty table gives none. A null, longer or shorter length is an error.

    The pieces are written to the shared folder first: they get their row number there, so a
    task that is run again deals the same rows to the same groups.
    """
    spark = pieces.sparkSession
    folder = shared_folder(spark, "pieces")
    wrong = F.col("length").isNull() | ~F.col("length").between(1, capacity)
    checked = F.when(wrong, F.raise_error(F.lit("a length is out of range"))).otherwise(
        F.col("length")
    )
    (
        pieces.drop("sequence_id", "offset")
        .withColumns({"length": checked, "__row": F.monotonically_increasing_id()})
        .write.parquet(folder)
    )
    table = spark.read.parquet(folder)
    full = F.col("length") == capacity
    groups = max(1, -(-table.filter(~full).count() // group_rows))
    part = table.filter(~full)
    packed = (
        part.select(F.col("__row").alias("row"), "length", _dealt("__row", groups).alias("group"))
        .groupBy("group")
        .applyInPandas(
            lambda key, rows: pack_group(rows, capacity).assign(group=key[0]),
            "row long, bin long, offset long, group long",
        )
        .select(
            F.col("row").alias("__row"),
            (F.col("group") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"),
            "offset",
        )
    )
    alone = table.filter(full).withColumns(
        {"sequence_id": -1 - F.col("__row"), "offset": F.lit(0).cast("long")}
    )
    return part.join(packed, "__row").unionByName(alone).drop("__row")


def _dealt(row: str, groups: int) -> Column:
    """A group for each row number, evenly."""
    return F.pmod(F.xxhash64(row), F.lit(groups).cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id`` and its ``ids`` (binary), in order of the
    offsets. A sequence is at most as long as the capacity, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts["ids"], F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"))
