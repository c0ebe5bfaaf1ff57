"""Quality rules by columns alone: word rules of each text, and lines repeated across documents.

Word rules look at one row and never move it. For the cross-document rule, lines are
normalised and hashed, and the distinct documents of a host that hold a line are counted.
Documents with the same text count once, so a text isn't held against its own copies. Lines
in more than a share of the host's distinct texts, and in more than a few, are removed, except in
the first document of the host that has them, so that of a group of near copies one stays whole.
As the limit is a share, it means the same in a host of any size. ``verdicts`` and ``keep`` give
texts without these lines. A document that has too little left is rejected; the word rules look at
its whole text.

Very long texts are cut into lines whole. Of several rows with the least ``doc_id`` among a line's
carriers, the one with the least text hash is the first; a null ``doc_id`` comes before all others.
An empty table gives no rows. Only ``doc_id``, ``text`` and the host are read, so other columns may
have any names but those that start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.session import shared_folder

#: White space between words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
WINDOW = 8
REPEATED_SHARE = 30

#: Share of a host's distinct texts that may hold a line, and the texts that always may.
MOST_SHARE = 0.05
FEW_DOCUMENTS = 10
#: Share of its text that a document must keep.
LEAST_LEFT = 0.3
#: Pieces that the rows of one line are dealt to.
SALTS = 32
#: The same, of one text.
COPY_SALTS = 8
#: Rows of a few numbers each that are sent to every executor, at most (some 10 MB).
FEW_ROWS = 100_000
#: Lists that the removed lines of a text are dealt to, so that looking one up stays short.
BUCKETS = 64


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, also where it is used in loops."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    plain = F.translate(text, SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(plain, " "), "")


def _pairs(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places on."""
    return let(
        hashes,
        lambda h: F.when(F.size(h) <= apart, F.array().cast("array<bigint>")).otherwise(
            F.zip_with(
                F.slice(h, 1, F.size(h) - apart),
                F.slice(h, apart + 1, F.size(h) - apart),
                lambda a, b: F.xxhash64(a, b),
            )
        ),
    )


def _repeated_words(windows: Column) -> Column:
    """Words in windows whose hash comes twice or more.

    Sorting by hash puts equal windows side by side. The places of those, in order, cover a
    whole window each, less what the next one covers as well.
    """

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda s: F.filter(
            F.transform(
                s,
                lambda x, n: F.when(
                    (F.get(s, n - 1)["h"] == x["h"]) | (F.get(s, n + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        places = F.sort_array(let(placed, twin))
        gaps = lambda p: F.zip_with(
            p,
            F.slice(p, 2, F.size(p)),
            lambda here, there: F.least(F.coalesce(there - here, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        total = F.aggregate(let(places, gaps), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            total
        )

    return let(windows, covered)


def with_measures(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` of their ``text``; columns of these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    count = lambda kept: F.char_length(text) - F.char_length(F.translate(text, kept, ""))
    # A text is cut into words once, for both of these.
    by_word = let(
        F.transform(words(text), lambda w: F.xxhash64(w)),
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            _repeated_words(_pairs(_pairs(_pairs(h, 1), 2), 4)).alias("n_repeat_words"),
        ),
    )
    with_words = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    lines = F.transform(with_words, lambda x: F.xxhash64(x))
    repeated_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    found = {
        "__by_word": by_word,
        "word_chars": F.char_length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": count(SYMBOLS).cast("long"),
        "n_dup_lines": repeated_lines.cast("long"),
    }
    names = {n: F.col("__by_word")[n] for n in ("n_words", "n_repeat_words")}
    return rows.withColumns(found).withColumns(names).drop("__by_word")


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_SHARE)


def depleted(
    documents: DataFrame,
    host: str = "source",
    most_share: float = MOST_SHARE,
    few_documents: int = FEW_DOCUMENTS,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """Texts of which the removal of frequent lines leaves too little: ``host`` and
    ``text_hash``, as ``keys`` makes them, and ``removed_share``."""
    found = removals(documents, host, most_share, few_documents).drop("gone")
    return found.filter(_too_little_left(least_left))


def _too_little_left(least_left: float = LEAST_LEFT) -> Column:
    return F.coalesce("removed_share", F.lit(0.0)) > 1 - least_left


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    folder = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _meet(rows: DataFrame, few: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join with a written table of a few numbers a row.

    Its rows are counted: few are sent to every executor as they are. More are shuffled, with
    ``rows`` of one key dealt out by ``spread``; the copies made for that are never sent to all.
    """
    if few.count() <= FEW_ROWS:
        return rows.join(F.broadcast(few), on)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge"), [*on, "__salt"]).drop("__salt")


def removals(
    documents: DataFrame,
    host: str = "source",
    most_share: float = MOST_SHARE,
    few_documents: int = FEW_DOCUMENTS,
) -> DataFrame:
    """Texts that lose frequent lines: ``host`` and ``text_hash``, as ``keys`` makes them, ``gone``
    with the hashes of those lines, and ``removed_share``.

    A normalised line is its lower-cased letters and digits, with one space in place of all
    between; lines without any stay. The share counts characters of normalised lines. A null host
    is a host of its own. Null and empty texts have no lines. Repeated rows are one document.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _normal)
    lines = F.transform(
        F.array_remove(lines, ""),
        lambda x: F.struct(F.xxhash64(x).alias("line"), F.char_length(x).alias("size")),
    )
    # One row for each line and text: copies of a text meet here, before lines are counted.
    carriers = _written(
        documents.select(*keys(host), "doc_id", F.inline(lines))
        .groupBy("host", "line", "text_hash")
        .agg(
            F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"),
            F.sum("size").alias("size"),
        ),
        "lines",
    )
    # All copies of a text are summed up here and below.
    texts = _written(
        carriers.groupBy("host", "text_hash").agg(F.sum("size").alias("size")), "line_texts"
    )
    hosts = _written(texts.groupBy("host").agg(F.count("*").alias("texts")), "line_hosts")
    repeated = (
        carriers.groupBy("host", "line")
        .agg(F.count("*").alias("documents"), F.min(F.struct("first", "text_hash")).alias("keeper"))
        .filter(F.col("documents") > few_documents)
    )
    frequent = _written(
        _meet(repeated, hosts, ["host"], "line")
        .filter(F.col("documents") > F.col("texts") * F.lit(float(most_share)))
        .select("host", "line", "keeper"),
        "frequent_lines",
    )
    removed = (
        _meet(carriers, frequent, ["host", "line"], "text_hash")
        .filter(F.struct("first", "text_hash") > F.col("keeper"))
        .groupBy("host", "text_hash")
        .agg(F.sum("size").alias("removed"), F.collect_list("line").alias("gone"))
    )
    return (
        removed.join(texts, ["host", "text_hash"])
        .withColumn("removed_share", F.col("removed") / F.col("size"))
        .select("host", "text_hash", "gone", "removed_share")
    )


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose hashes are in ``gone``, the others in order."""
    dealt = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.filter(gone, lambda x: F.pmod(x, F.lit(BUCKETS)) == b),
    )

    def stays(buckets: Column, line: Column) -> Column:
        return let(
            F.xxhash64(_normal(line)),
            lambda h: ~F.array_contains(F.get(buckets, F.pmod(h, F.lit(BUCKETS)).cast("int")), h),
        )

    left = let(
        dealt, lambda b: F.array_join(F.filter(F.split(text, "\n"), lambda x: stays(b, x)), "\n")
    )
    return F.when(gone.isNull(), text).otherwise(left)


def keys(host: str) -> list[Column]:
    """Hashes of a document's host and text."""
    return [
        F.xxhash64(F.coalesce(host, F.lit("")), F.col(host).isNull()).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    ]


def _spread(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Left join by host and text, with a text of very many copies dealt to several tasks."""
    salts = F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))
    found = found.withColumn("__salt", F.explode(salts))
    names = {"host": "__host", "text_hash": "__text_hash"}
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS)).cast("int")
    return (
        documents.withColumn("__salt", salt)
        .join(found.withColumnsRenamed(names), ["__host", "__text_hash", "__salt"], "left")
        .drop("__host", "__text_hash", "__salt")
    )


def verdicts(documents: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``removed_share``, ``kept`` and ``text``, less
    its frequent lines, of every row.

    A null text has no words, and so fails the base rules. Repeated rows get a row each.
    ``removed_share`` is null where nothing is removed.
    """
    mine = [k.alias(f"__{n}") for k, n in zip(keys(host), ("host", "text_hash"), strict=True)]
    base = with_measures(documents.select("doc_id", *mine, "text"))
    base = base.withColumn("base_failed", base_failed())
    joined = _spread(base, removals(documents, host))
    kept = ~F.col("base_failed") & ~_too_little_left()
    text = _without(F.col("text"), F.col("gone"))
    return joined.withColumns({"text": text, "kept": kept}).drop("gone")


def keep(documents: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns; ``text`` is without frequent lines."""
    mine = [k.alias(f"__{n}") for k, n in zip(keys(host), ("host", "text_hash"), strict=True)]
    whole = F.struct(*documents.columns).alias("__row")
    good = with_measures(documents.select(whole, "doc_id", *mine, "text")).filter(~base_failed())
    left = _spread(good.select("__row", "doc_id", "__host", "__text_hash"), removals(documents, host))
    row, gone = F.col("__row"), F.col("gone")
    columns = [
        _without(row[c], gone).alias(c) if c == "text" else row[c].alias(c) for c in documents.columns
    ]
    return left.filter(~_too_little_left()).select(*columns)
