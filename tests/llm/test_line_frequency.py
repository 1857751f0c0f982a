import re
from collections import Counter

from cases import words_of

from tidemark.llm import line_frequency


def base(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return re.sub("[0-9]+", "0", re.sub("[ \t\x0b\x0c\r]+", " ", line.lower())).strip(" ")


def lines_of(text):
    """(normalised, as it stands) of each line with a word."""
    return [(normal(x), x) for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]


def frequent(rows, share, least):
    n = Counter((host, x) for _, text, host in rows for x in {x for x, _ in lines_of(text)})
    size = Counter(host for _, _, host in rows)
    return {k for k, v in n.items() if v > least and v > share * size[k[0]]}


def brute(rows, share=0.01, least=10):
    over, out = frequent(rows, share, least), []
    for i, text, host in rows:
        b = base(text)
        gone = [(x, raw) for x, raw in lines_of(text) if (host, x) in over]
        left = b[0] - sum(len(x.split(" ")) for x, _ in gone)
        out.append((i, *b, not b[-1] and left >= 20 and left >= 0.5 * b[0], sum(len(raw) for _, raw in gone)))
    return out


def told(df):
    return sorted(((r[0] if r[0] is not None else -1, *r[1:]) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_chars").collect()))


def test_query_against_brute_force(spark, data):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/{sf}/documents.parquet").collect()]
        want = sorted(brute(rows))
        assert told(line_frequency.op8_line_frequency(spark, f"{data}/{sf}")) == want
    # the largest table has frequent lines, and documents that they deplete
    assert any(r[-1] for r in want) and any(not r[-2] and not r[-3] for r in want)


def test_texts_without_frequent_lines(spark, data):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/sf0.1/documents.parquet").collect()]
    over = frequent(rows, 0.01, 10)
    want = {i: "\n".join(x for x in text.split("\n") if (host, normal(x)) not in over) for i, text, host in rows if text is not None}
    got = {r.doc_id: r.text for r in line_frequency.without_frequent_lines(spark.read.parquet(f"{data}/sf0.1/documents.parquet")).collect()}
    assert len(got) == len(rows) and all(got[i] == want.get(i) for i, _, _ in rows)
    assert any(got[i] != text for i, text, _ in rows)


def test_frequent_lines_deplete_documents(spark):
    menu = "Home | About | Contact 12\nTerms and  conditions 2024"
    rows = [(k, " ".join(words_of(30, k)) + "\n" + menu, "a") for k in range(8)] + [(100 + k, menu + "\n" + menu + "\n" + " ".join(words_of(21, 99 + k)[:21])[:60], "a") for k in range(4)]
    rows += [(200, menu, "b"), (201, " ".join(words_of(30, 300)), None), (201, " ".join(words_of(30, 300)), None), (None, " ".join(words_of(30, 301)), None), (202, None, None)]
    rows += [(7, rows[7][1], "a")] * 2  # rows that repeat
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, least in ((0.0, 3), (0.0, 11), (0.5, 3), (0.99, 1), (0.01, 100)):
        want = sorted((i if i is not None else -1, *b) for i, *b in brute(rows, share, least))
        assert told(line_frequency.line_quality(df, share=share, min_documents=least)) == want
    assert {r[0] for r in told(line_frequency.line_quality(df, min_documents=3)) if not r[7] and not r[6]} <= {100, 101, 102, 103}
    clean = {(r.doc_id, r.text) for r in line_frequency.without_frequent_lines(df, min_documents=3).collect()}
    assert (0, " ".join(words_of(30, 0))) in clean and (202, None) in clean and (200, menu) in clean


def test_lines_that_are_all_digits_deplete_as_well(spark):
    """A line above the limit goes whole, however short it is once normalised."""
    line = " ".join(f"{k}{k}0123456789" for k in range(40))
    rows = [(k, line, "a") for k in range(101)] + [(500, " ".join(words_of(40, 1)), "a")]
    got = {r.doc_id: r for r in line_frequency.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[k].kept and got[k].n_removed_chars == len(line) for k in range(101)) and got[500].kept


def test_depletion_counts_words_on_one_basis(spark):
    ids = "\n".join(f"ID 2024010{k % 10} 0012345{k % 10}\t99887766\r\n   x{k} y z" for k in range(5))
    few = " ".join(words_of(22, 5))
    menu = "about these pages and others"
    rows = [(k, ids, "digits") for k in range(6)] + [(100 + k, ids.replace("\r", "").replace("\t", "  "), "digits") for k in range(6)]
    rows += [(200 + k, " ".join(words_of(19, k)) + "\n" + menu, "few") for k in range(6)]
    rows += [(300 + k, few + "\n\n" + " ".join(words_of(30, 50 + k)), "most") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.line_quality(df, min_documents=5).collect()}
    assert not any(r.base_failed for r in got.values())
    # every line is above the limit; the digits and blanks of the text as it stands are no words that stay
    assert not any(got[k].kept for k in (*range(6), *range(100, 106)))
    assert not any(got[200 + k].kept for k in range(6))  # 19 words stay
    assert all(got[300 + k].kept for k in range(6))  # 30 of 52 words stay
    # a carriage return or tab makes no other line: with a limit that only both spellings together pass, all go
    both = line_frequency.line_quality(df, min_documents=11).where("doc_id < 200").collect()
    assert len(both) == 12 and not any(r.kept for r in both)


def test_joined_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(k, " ".join(words_of(30, k)) + "\nfooter line", "a") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(line_frequency, "BROADCAST_LINES", 0)
    assert told(line_frequency.line_quality(df, min_documents=3)) == sorted(brute(rows, 0.01, 3))


def test_awkward_and_empty(awkward, empty):
    rows = [(r.doc_id if r.doc_id is not None else -1, r.text, r.source) for r in awkward.select("doc_id", "text", "source").collect()]
    assert told(line_frequency.line_quality(awkward)) == sorted(brute(rows))
    assert line_frequency.line_quality(empty).count() == 0


def test_native(spark, data):
    plan = line_frequency.op8_line_frequency(spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD|MapElements", plan)
