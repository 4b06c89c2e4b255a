import hashlib
from collections import defaultdict

import duckdb
import numpy as np

from trustframe.llm.cuckoo import Cuckoo
from trustframe.llm.lines import OP4_SQL, LineIndex

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=20, docs=3):
    key = lambda x: x.strip(SPACE).translate(LOW)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(d)
    gone = {}
    for k, own in held.items():
        if len(own) >= docs:
            ids = [d for d in own if d is not None]
            gone[k] = max(ids) if ids else None
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (key(x) in gone and gone[key(x)] != d)]
        out.append((d, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


A, B, C = "A line of more than twenty characters", "éééééééééééééééééééé", "\tanother line that is long enough \r"
ROWS = [(1, f"{A}\nshort\n{A}"), (2, f"{A.upper()}\n{B}"), (3, f"  {A}  \n{B}\nx"), (4, B + "\n" + C), (5, C), (6, None), (7, ""), (8, "\n\n"),
        (9, "short\nshort"), (10, f"{C}\n{A}"), (11, "É" * 20), (12, "x" * 100000 + "\n" + A), (None, A), (4, "again " + A)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_apply_matches_brute_force(spark, docs_of):
    df = docs_of(ROWS).selectExpr("*", "1 AS key", "2 AS keys")
    assert rows_of(LineIndex.build(df).apply(df)) == brute(ROWS)
    many = [(i, "\n".join(f"this is the common line number {j}" for j in range(i % 40))) for i in range(300)]
    df = docs_of(many)
    small = LineIndex.build(df, keys_per_shard=8, salts=3)
    assert small.shards > 1 and rows_of(small.apply(df)) == brute(many)
    empty = df.limit(0)
    assert LineIndex.build(empty).apply(empty).count() == 0


def test_insert_and_delete_are_inverse(spark, docs_of):
    one = [(i, "\n".join(f"this is the common line number {j}" for j in range(i % 30))) for i in range(100)]
    two = [(500 + i, "\n".join(f"this is a line of the second batch {j % 50}" for j in range(i, i + 60))) for i in range(100)]
    a, b = docs_of(one), docs_of(two)
    start = LineIndex.build(a, keys_per_shard=16)
    both = start.insert(b)
    assert rows_of(both.counts) == rows_of(LineIndex.build(a.union(b)).counts)
    assert rows_of(both.apply(a.union(b))) == brute(one + two)
    back = both.delete(b)
    assert rows_of(back.counts) == rows_of(start.counts)
    assert rows_of(back.apply(a)) == brute(one)
    # what the filters hold is what the counts say: the lines of the second batch are out again
    hot = {bytes(r["key"]) for r in back.counts.filter("n >= 3").collect()}
    passed = {bytes(r["key"]) for r in back.probe(both.counts.selectExpr("key", "1L AS doc_id")).collect()}
    assert hot <= passed and len(passed - hot) <= 2


def test_cuckoo_filter():
    keys = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(5000)), np.uint64).reshape(-1, 2)
    f = Cuckoo.of(keys[:3000])
    assert f.contains(keys[:3000]).all() and f.contains(keys[3000:]).mean() < 0.01
    f = Cuckoo.load(f.dump())
    assert f.update(keys[:1500], np.zeros(1500, bool))
    assert f.contains(keys[1500:3000]).all() and f.contains(keys[:1500]).mean() < 0.01
    tiny = Cuckoo.for_keys(1)
    assert not tiny.update(keys[:200], np.ones(200, bool))  # full, and says so


def test_sql_agrees_on_repeated_ids(spark, docs_of):
    rows = ROWS + [(1, A), (20, C + "\nonly here twice, in two rows of one id"), (20, "only here twice, in two rows of one id"), (21, "only here twice, in two rows of one id")]
    got = sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in (tuple(r) for r in LineIndex.build(docs_of(rows)).apply(docs_of(rows)).collect())), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(OP4_SQL).fetchall(), key=repr)
    assert got == sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows)), key=repr)
    assert all(g == 0 for d, _, g, _ in got if d == 21)  # two ids only hold it
