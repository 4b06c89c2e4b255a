import random
import re

import pytest

from trustframe.llm.substrings import SubstringDedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        d, t = rows[i]
        w = W.findall(t or "")
        keep = [True] * len(w)
        for a in range(len(w) - n + 1):
            g = tuple(w[a:a + n])
            if g in seen:
                keep[a:a + n] = [False] * n
            seen.add(g)
        out.append((d, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return sorted(out, key=repr)


def cases(vocabulary, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 40, 70]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p) // 2)
                w += p[a:] if rng.random() < 0.5 else p
        rows.append((i * 7919 % 1009, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "a " * 500), (2003, "a\tb\n" * 300), (2004, "A b " * 300), (2005, "x" * 100000 + " " + " ".join(passages[0])),
                   (None, " ".join(passages[1])), (2006, " ".join(passages[1]))]


@pytest.mark.parametrize("vocabulary,seed", [(5000, 1), (2, 2), (30, 3)])
@pytest.mark.parametrize("held,hot", [(1 << 20, 1 << 16), (5, 1 << 16), (1 << 20, 1), (5, 40)])
def test_removed_words_match_brute_force(spark, docs_of, vocabulary, seed, held, hot):
    rows = cases(vocabulary, seed)
    df = docs_of(rows).selectExpr("*", "1 AS d", "2 AS th", "3 AS runs").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if held == 5 else "10000")
    try:
        got = SubstringDedup(held=held, hot=hot, sampled=1).dedup(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows)
    text = {d: W.findall(t or "") for d, t in rows}
    for r in got:  # each factor is a copy of text that comes earlier, and together they are what goes
        gone = set()
        for f in r["factors"]:
            src = text[f["ref_doc_id"]]
            assert f["n_words"] >= 20 and text[r["doc_id"]][f["start"]:f["start"] + f["n_words"]] == src[f["ref_start"]:f["ref_start"] + f["n_words"]]
            assert f["ref_doc_id"] is None or f["ref_doc_id"] < (r["doc_id"] if r["doc_id"] is not None else -1) or f["ref_doc_id"] == r["doc_id"] and f["ref_start"] < f["start"]
            gone |= set(range(f["start"], f["start"] + f["n_words"]))
        assert len(gone) == r["n_removed"]


def test_repeated_rows_are_one_document_and_empty(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    got = SubstringDedup().dedup(docs_of([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30)]
    assert SubstringDedup().dedup(docs_of([(1, "x")]).limit(0)).count() == 0


def test_windows_with_equal_short_hashes_are_not_copies(spark, docs_of):
    # real collisions of the low 40 bits of the window hash, with one anchor at one place
    head = " ".join(f"w{i}" for i in range(19))
    ends = [(2755762, 1179167), (1498108, 865109), (2509040, 3256293)]
    rows = [(2 * i + j, f"{head} v{v}") for i, pair in enumerate(ends) for j, v in enumerate(pair)]
    for held in (1 << 20, 1):
        # each document in a slice of its own, so that the blocks compare them
        got = SubstringDedup(held=held).dedup(docs_of(rows).repartition(6, "doc_id")).collect()
        assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, 0) for i in range(6)]


def test_a_frequent_anchor_is_spread_and_keeps_the_result(spark, docs_of):
    rng = random.Random(5)
    phrase = [f"p{i}" for i in range(19)]
    rows = []
    for i in range(600):  # one phrase between other words, so hundreds of different windows share an anchor
        around = [f"w{rng.randrange(10 ** 9)}" for _ in range(60)]
        rows.append((i, " ".join(around[:30] + phrase + around[30:])))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 600, 50)]
    df = docs_of(rows).repartition(4)
    keyed = df.selectExpr("doc_id AS d", "xxhash64(text) AS th", "text")
    spread, plain = SubstringDedup(hot=300, sampled=1), SubstringDedup()
    assert len(spread._frequent(keyed)) >= 1 and len(plain._frequent(keyed)) == 0 and len(SubstringDedup(hot=1, sampled=1, most=3)._frequent(keyed)) == 3
    largest = [x._sent(keyed).filter("kind = 0").groupBy("h").count().agg({"count": "max"}).first()[0] for x in (spread, plain)]
    assert largest[0] < 50 <= largest[1]
    got = [sorted((tuple(r) for r in x.dedup(df).collect()), key=repr) for x in (spread, plain)]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == 12 * 79
