import random
import re
from collections import Counter

import numpy as np

from trustframe.llm import kernels as K
from trustframe.llm.decontaminate import Decontaminator, HammingIndex, simhash

TOK = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, pc=80):
    """Every window of every item's length, by counted shingles."""
    out = []
    for row, (_, text) in enumerate(docs):
        w = TOK.findall((text or "").translate(LOW))
        for item, it in items:
            v = TOK.findall((it or "").translate(LOW))
            k, n = min(5, len(v)), len(v)
            if not n:
                continue
            want, best = Counter(tuple(v[i:i + k]) for i in range(n - k + 1)), None
            for a in range(len(w) - n + 1):
                c = Counter(tuple(w[i:i + k]) for i in range(a, a + n - k + 1))
                small, large = sum((c & want).values()), sum((c | want).values())
                if 100 * small >= pc * large and (best is None or small / large > best[0]):
                    best = (small / large, a)
            if best:
                out.append((row, item, best[1], n, round(best[0], 9)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 20, 20, 33, 60])))) for i in range(25)]
    items += [(100, "Two Words"), (101, "solo"), (102, None), (103, ""), (104, "..."), (105, "a b c d e " * 6), (106, items[3][1].upper()), (None, "null id item with some words in it")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 150))]
        _, t = rng.choice(items[:25])
        p = t.split()
        if i % 3 == 0:  # as it is, or with a word more, less, or another at an end or in the middle
            kind = rng.randrange(5)
            at = rng.randrange(len(p))
            p = [p, p[1:], p[:-1] + [word()], p[:at] + [word()] + p[at + 1:], p[:at] + p[at + 1:]][kind]
            w[len(w) // 2:len(w) // 2] = p
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "here are two WORDS, and Solo"), (203, "a b c d e " * 2000), (204, items[3][1].title().replace(" ", ", ")), (None, items[0][1]),
             (205, "null id item with some words in it"), (7, items[1][1]), (7, items[1][1])]
    return docs, items


def test_matches_equal_brute_force(spark, docs_of):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(docs).selectExpr("*", "1 AS matches", "2 AS item_id").coalesce(1)
    for op in (Decontaminator(), Decontaminator(block_bytes=700)):
        marked, column = op.mark(df, bench)
        assert marked.columns == [*df.columns, "matches_"]
        got = [(i, m["item_id"], m["start"], m["n_words"], round(m["similarity"], 9)) for i, r in enumerate(marked.collect()) for m in r[column]]
        assert sorted(got, key=repr) == brute(docs, items)
        clean = op.clean(df, bench)
        assert clean.columns == df.columns and clean.count() == len(docs) - len({g[0] for g in got})


def test_empty_tables(spark, docs_of):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Decontaminator().clean(docs_of(docs).limit(0), bench).count() == 0
    assert Decontaminator().clean(docs_of(docs), bench.limit(0)).count() == len(docs)


def test_index_misses_none_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    index = HammingIndex(prints, 31)
    near = []
    for i in range(400):
        bits = np.unpackbits(prints[i % 40])
        bits[rng.choice(128, rng.integers(0, 45), replace=False)] ^= 1
        near.append(np.packbits(bits))
    near = np.array(near)
    want = {(i, j, int(d)) for i in range(400) for j in range(40) if (d := np.unpackbits(near[i] ^ prints[j]).sum()) <= 31}
    assert set(index.within(near)) == want and len(want) > 200


def near_pair(rng, n, k=5, pc=80):
    """Word hashes of an item and of a window with as many changed shingles as ``pc`` allows: words replaced in the
    middle, each losing k shingles, then at the end, each losing one."""
    m = n - k + 1
    lose = m * (100 - pc) // (100 + pc)  # (m - lose) / (m + lose) >= pc / 100
    item = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    window = item.copy()
    middle = rng.integers(0, lose // k + 1)
    at = k + np.arange(middle) * (m // (middle + 1))
    window[at] ^= np.uint64(0x5555)
    window[n - (lose - k * middle):] ^= np.uint64(0x3333)
    return item, window


def recall(n, pairs=2000, radius=31, k=5):
    """The share of pairs at the threshold whose fingerprints lie within the radius, and their worst similarity."""
    rng = np.random.default_rng(n)
    found, worst = 0, 1.0
    for _ in range(pairs):
        a, b = (K.windows(w, np.array([0, n]), k) for w in near_pair(rng, n))
        a, b = a[0][a[1]], b[0][b[1]]
        same = len(np.intersect1d(a, b))
        worst = min(worst, same / (2 * len(a) - same))
        d = np.bitwise_count(simhash(a[None]).view(np.uint64) ^ simhash(b[None]).view(np.uint64)).sum()
        found += d <= radius
    return found / pairs, worst


def test_recall_of_the_radius_at_the_threshold():
    for n in (13, 14, 20, 40, 80, 150):
        share, worst = recall(n, 400)
        assert worst >= 0.8 and share >= 0.99, (n, share, worst)
