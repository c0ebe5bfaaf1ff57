import re
from collections import Counter, defaultdict

from layerscan.llm import quality_rules
from tests.llm import samples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[n : n + 8]) for n in range(len(words) - 7)]
    count = Counter(windows)
    covered = {n + k for n, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    block = samples.prose(9, 12)
    texts = [r[1] for r in samples.odd_rows()] + [
        f"{block} {block}", f"{block} x {block} y {block}", "a " * 9, "a " * 8, "b " * 7,
        "l\nl\n \n \nl|#\nm", "\x0b\x0ca\x1cb c", f"{samples.prose(10, 50)} {block}\n{block}",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for n, *found in quality_rules.with_measures(frame).select("n", *names).collect():
        assert tuple(found) == brute(texts[n]), texts[n]


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def brute_kept(rows, share=0.05, few=10, left=0.3):
    """Verdicts by the rule as it is told in words."""
    carriers = defaultdict(set)
    first = {}
    for doc_id, text, host in rows:
        first[host, text] = min(doc_id, first.get((host, text), doc_id))
        for line in (text or "").split("\n"):
            if normal(line):
                carriers[host, normal(line)].add(text)
    texts = Counter(h for h, t in {(h, t) for (h, _), own in carriers.items() for t in own})
    kept = {}
    for doc_id, text, host in rows:
        words, *_, repeated = brute(text)
        gone = size = 0
        for line in (text or "").split("\n"):
            own = carriers[host, normal(line)] if normal(line) else ()
            size += len(normal(line))
            if len(own) > max(few, share * texts[host]) and first[host, text] != min(first[host, t] for t in own):
                gone += len(normal(line))
        base = words >= 20 and 100 * repeated <= 30 * words
        kept[doc_id] = base and gone <= (1 - left) * size
    return kept


def test_frequent_lines(spark):
    shared = [samples.prose(n, 20) for n in range(3)]
    rows = []
    for n in range(30):
        own = samples.prose(100 + n, 25)
        host = "a" if n % 3 else None
        rows.append((n, f"{shared[0].upper()}!\n{shared[1]}\n{shared[2]}\n{own}", host))
        rows.append((100 + n, "\n".join([*shared[: n % 4], own]), host))
    rows += [(200 + n, rows[1][1], rows[1][2]) for n in range(40)]  # copies count once
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, few, left in ((0.0, 5, 0.3), (0.0, 5, 0.7), (0.0, 25, 0.3), (0.6, 2, 0.7)):
        gone = quality_rules.depleted(frame, "source", share, few, left)
        base = frame.select("doc_id", *quality_rules.keys("source"))
        lost = {r[0] for r in base.join(gone, ["host", "text_hash"]).select("doc_id").collect()}
        kept = brute_kept(rows, share, few, left)
        assert 0 < sum(kept.values())
        assert lost == {d for d, k in kept.items() if not k}


def test_odd_documents(spark):
    documents = samples.odd_documents(spark)
    found = quality_rules.verdicts(documents).collect()
    assert len(found) == len(samples.odd_rows())
    for r in found:
        assert r["kept"] == (not r["base_failed"])
    kept = quality_rules.keep(documents)
    assert kept.columns == documents.columns
    texts = Counter(r[1] for r in samples.odd_rows() if brute_kept([(0, r[1], "")])[0])
    assert Counter(r["text"] for r in kept.collect()) == texts
    assert quality_rules.verdicts(samples.no_documents(spark)).count() == 0
    assert quality_rules.keep(samples.no_documents(spark)).count() == 0


def test_no_python(spark):
    plan = quality_rules.verdicts(samples.no_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_frequent_lines_leave_the_text(spark):
    # 102 texts share a line in two spellings; the first keeps it, copies count once.
    line = samples.prose(1, 20)
    own = [samples.prose(10 + n, 30) for n in range(103)]
    rows = [(n, f"{own[n]}\n{line.upper()}!\n\n{line}\n--\nend {n}", "a") for n in range(102)]
    rows += [(200, rows[7][1], "a"), (201, rows[0][1], "a"), (300, f"{own[102]}\n{line}", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    less = {n: f"{own[n]}\n\n--\nend {n}" for n in range(1, 102)} | {200: f"{own[7]}\n\n--\nend 7"}
    for n in (0, 201, 300):
        less[n] = next(t for d, t, _ in rows if d == n)
    found = {r["doc_id"]: r for r in quality_rules.verdicts(frame).collect()}
    assert {d: r["text"] for d, r in found.items()} == less
    assert {d for d, r in found.items() if r["removed_share"]} == set(less) - {0, 201, 300}
    passing = {d for d, r in found.items() if r["kept"]}
    assert {0, 201, 300} <= passing
    kept = quality_rules.keep(frame).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {d: less[d] for d in passing}


def test_limit_is_a_share_of_the_host(spark):
    # The same share of texts holds the line in a small host and in a large one; half of it does not.
    line, rows = samples.prose(1, 60), []
    for host, count in (("small", 220), ("large", 660)):
        for often, sort in ((15, "above"), (30, "below")):
            for n in range(count):
                own = samples.prose(1000 + len(rows), 20)
                text = f"{line}\n{own}" if n % often == 0 else own
                rows.append((len(rows), text, f"{host} {sort}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(frame).collect()}
    assert found == brute_kept(rows)
    hosts = Counter(host for d, _, host in rows if not found[d])
    assert hosts == {"small above": 220 // 15, "large above": 660 // 15 - 1}


def test_many_frequent_lines_are_not_sent_to_all(spark, monkeypatch):
    line = samples.prose(1, 20)
    rows = [(n, f"{samples.prose(10 + n, 30)}\n{line}", "a") for n in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = quality_rules.removals(frame).select("text_hash", "removed_share").collect()
    monkeypatch.setattr(quality_rules, "FEW_ROWS", 0)
    many = quality_rules.removals(frame)
    assert "merge" in many._jdf.queryExecution().analyzed().toString()
    assert sorted(many.select("text_hash", "removed_share").collect()) == sorted(few) != []


def test_query_on_the_given_table(spark):
    """Types of its contract, and lines that do leave texts."""
    from layerscan.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    found = queries.op7_quality_rules(spark, sf_dir)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    types = dict(found.dtypes)
    assert [types[n] for n in measures] == ["bigint"] * 5
    assert types["base_failed"] == types["kept"] == "boolean"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    kept, texts = brute_kept(rows), {d: t for d, t, _ in rows}
    got = found.collect()
    assert {r["doc_id"]: r["kept"] for r in got} == kept and len(got) == len(rows)
    assert {r["doc_id"]: tuple(r[n] for n in measures) for r in got} == {
        d: brute(t) for d, t in texts.items()
    }
    assert any(r["text"] != texts[r["doc_id"]] for r in got)
