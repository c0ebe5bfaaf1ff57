import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerscan.llm import queries, spelling
from tests.llm import samples

SF = "/root/testdata/sf0.001"


def brute_vocabulary(rows, least=7):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(counts, factor=10):
    near = {a: [b for b in counts if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] >= factor * counts[word]:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return sorted(
        (w, form.get(w) or "", root(w), n, len(near[w]), counts[form[w]] if w in form else -1) for w, n in counts.items()
    )


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def hard_words():
    rnd = random.Random(4)
    words = {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaaa", "abababab", "babababa", "ababab", "éléphant", "elephant",
             "élephant", "ÿ" * 7, "ÿ" * 8, "z" * 300, "z" * 299, "z" * 299 + "y"}
    for _ in range(120):
        word = "".join(rnd.choices("abcé", k=rnd.randint(7, 9)))
        words |= {word, word[:3] + rnd.choice("abcd") + word[4:], word[:2] + word[3:]}
    return {w: 2 * 11 ** rnd.randint(0, 4) for w in words if len(w) >= 6}


@pytest.mark.parametrize("round_bytes, slice_blocks", [(32 << 20, 1 << 11), (1, 1), (400, 2)])
def test_like_brute_force(spark, monkeypatch, round_bytes, slice_blocks):
    counts = hard_words()
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", slice_blocks)
    assert found(spelling.variants(vocabulary(spark, counts), round_bytes=round_bytes)) == brute_variants(counts)


def test_chains_lead_to_the_last_form(spark):
    words = ["abcdefgh", "xbcdefgh", "xycdefgh", "xyzdefgh", "xyzwefgh", "xyzwvfgh", "xyzwvugh", "xyzwvuth"]
    counts = {w: 2 * 10**n for n, w in enumerate(words)}
    rows = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(vocabulary(spark, counts)).collect()}
    assert rows[words[0]] == (words[1], words[-1], 1) and rows[words[-1]] == (None, words[-1], 1)
    assert all(rows[w][1] == words[-1] for w in words)


def test_filters_let_every_word_pass(spark):
    rnd = random.Random(1)
    words = list({"".join(rnd.choices("abcdefghij", k=9)) for _ in range(5000)})
    built = spelling._slices(
        vocabulary(spark, dict.fromkeys(words, 2)).withColumn("length", F.char_length("word")), {9: spelling.blocks_for(5000)}
    ).collect()
    assert len(built) == 1
    shard = spelling.Shard(spelling.blocks_for(5000), 0, np.frombuffer(built[0]["lanes"], np.uint64))
    assert len(shard.passes(spelling.hashes(spelling.code_points(words, 9)))) == len(words)
    other = list({"".join(rnd.choices("klmnopqrst", k=9)) for _ in range(20000)})
    assert len(shard.passes(spelling.hashes(spelling.code_points(other, 9)))) < 60


def test_rounds_cover_every_slice_once_and_stay_bounded():
    blocks = {7: 1, 8: 5 * spelling.SLICE_BLOCKS + 3, 9: 10, 10: spelling.SLICE_BLOCKS}
    rounds = spelling.rounds_of(blocks, 2 * spelling.SLICE_BLOCKS * spelling.LANES * 8)
    covered = defaultdict(list)
    for members in rounds:
        size = sum(min(blocks[n], b * spelling.SLICE_BLOCKS) - a * spelling.SLICE_BLOCKS for n, a, b in members)
        assert 0 < size <= 2 * spelling.SLICE_BLOCKS
        for length, a, b in members:
            covered[length] += range(a, b)
    assert covered == {n: list(range(-(-c // spelling.SLICE_BLOCKS))) for n, c in blocks.items()}


def test_odd_rows_and_empty_tables(spark, monkeypatch):
    documents = samples.odd_documents(spark).withColumns({c: F.lit("x") for c in ("n", "form", "root", "word")})
    rows = [r[:2] for r in samples.odd_rows()]
    assert {r["word"]: r["n"] for r in spelling.vocabulary(documents).collect()} == brute_vocabulary(rows)
    assert found(spelling.variants(spelling.vocabulary(documents))) == brute_variants(brute_vocabulary(rows))
    assert spelling.variants(spelling.vocabulary(samples.no_documents(spark))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling(spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert found(got) == brute_variants(brute_vocabulary(rows))
