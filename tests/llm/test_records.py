import io
from array import array

import pytest
from pyspark.sql import functions as F

from layerscan.llm import records
from layerscan.llm.queries import tokenizer_file
from layerscan.llm.tokens import library_words
from tests.llm import samples

PATH = tokenizer_file("byte_bpe_50k.json")


def expected_rows():
    words = library_words(PATH, "I")
    rows = samples.odd_rows()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    start, found = 0, []
    for doc_id, text, *_ in sorted(rows, key=key):
        ids = words.text(text) + array("I", [2]).tobytes()
        found.append((doc_id, start, len(ids) // 4, ids))
        start += len(ids) // 4
    return found


@pytest.mark.parametrize("id_bytes, seed", [(2, None), (4, 7)])
def test_what_is_read_is_what_was_written(spark, tmp_path, id_bytes, seed):
    folder = f"file://{tmp_path}/records"
    records.write(samples.odd_documents(spark), folder, PATH, 2, id_bytes, files=3)
    rows = records.read(spark, folder, seed).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected_rows()


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    records.write(samples.no_documents(spark), folder, PATH)
    assert records.read(spark, folder).count() == 0


def test_damage_is_noticed():
    data = records.frame(b"some payload")
    assert records.unframe(io.BytesIO(b"##" + data), 2) == b"some payload"
    for place in range(len(data)):
        bad = bytearray(data)
        bad[place] ^= 4
        with pytest.raises(ValueError, match="damaged|ends"):
            records.unframe(io.BytesIO(bytes(bad)), 0)
    with pytest.raises(ValueError, match="ends"):
        records.unframe(io.BytesIO(data[:5]), 0)


def test_an_attempt_that_was_not_committed_does_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    few = samples.no_documents(spark).union(
        spark.createDataFrame([(1, "a b", "en", "s", 3)], samples.SCHEMA)
    )
    records.write(few, folder, PATH, files=1)
    (tmp_path / "records" / "part-000000-other.rec").write_bytes(b"half a rec")
    assert records.read(spark, folder).select(F.sum("n_tokens")).first()[0] == 2
