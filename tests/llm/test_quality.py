import re
from collections import Counter

from trustframe.llm.common import QUERIES, ORACLE
from trustframe.llm.quality import AdaptiveQuality, features

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines))


TEXTS = [None, "", " \t\n\x0b ", "a", "a b", "a b c a b c", "x\n\nx\n x\nx", "é ß é ß é ß ü", "a|b <c> # %", "\n" * 50, "w " * 40000,
         "line one\nline two\nline one\n\n", "a b c d a b c e a b"]


def test_counts_match_brute_force(spark, docs_of):
    texts = TEXTS + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"))
           for r in features(docs_of(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_limits_adapt_and_fall_back(spark, docs_of):
    clean = " ".join(f"word{i}" for i in range(60))
    marked = " ".join(f"w{i}&&" for i in range(60))
    rows = [(i, clean, "en", "plain") for i in range(40)] + [(100 + i, marked, "en", "code") for i in range(40)]
    rows += [(200, marked, "en", "plain"), (201, clean, None, None), (202, None, "en", "plain"), (203, "too short", "en", "few")]
    got = {r["doc_id"]: r for r in AdaptiveQuality().score(docs_of(rows)).collect()}
    assert all(got[i]["kept"] for i in range(40)) and all(got[100 + i]["kept"] for i in range(40))  # usual in its source
    assert not got[200]["kept"] and not got[200]["base_failed"]  # unusual in its source
    assert got[201]["kept"] and got[202]["base_failed"] and not got[203]["kept"]
    assert AdaptiveQuality().filter(docs_of(rows)).count() == 81


def test_extra_columns_repeated_rows_and_empty(spark, docs_of):
    df = docs_of([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", None, None)])
    df = df.selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS Q1")
    assert AdaptiveQuality().score(df).count() == 3
    assert AdaptiveQuality().score(df.limit(0)).count() == 0


def test_query_has_sql():
    assert "op1_quality" in QUERIES and "op1_quality" in ORACLE
