import random
import zlib

from trustframe.llm.common import QUERIES
from trustframe.llm.sharding import OVERHEAD, Sharding, difference


def test_difference_is_a_partition_and_beats_greedy():
    rng = random.Random(3)
    sizes = [rng.randint(1, 10**6) for _ in range(500)]
    parts = difference([[(s, i)] for i, s in enumerate(sizes)], 7)
    assert sorted(i for _, ids in parts for i in ids) == list(range(500))
    assert all(sum(sizes[i] for i in ids) == total for total, ids in parts)
    greedy = [0] * 7
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(t for t, _ in parts) - min(t for t, _ in parts) <= max(greedy) - min(greedy)
    # the textbook case of two parts: 8 7 6 5 4 leaves a difference of 2
    two = difference([[(s, i)] for i, s in enumerate([8, 7, 6, 5, 4])], 2)
    assert sorted(t for t, _ in two) == [14, 16]
    assert difference([], 3) == []


def test_query(spark):
    got = QUERIES["op2_karmarkar_karp"](spark, "/root/testdata/sf0.01").toPandas()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(got["doc_id"]) == sorted(text)
    assert all(s == len(text[d].encode()) + OVERHEAD and c == zlib.crc32(text[d].encode()) for d, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    by = got.groupby("shard")
    assert set(got["shard"]) == set(range(40)) and (got["law"] == "bytes").all() and got["grown_shard"].isna().all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    total = by["size"].sum()
    assert total.max() - total.min() <= 0.01 * total.mean()
    got["text"] = [text[d] for d in got["doc_id"]]
    assert (got.groupby("text")["shard"].nunique() == 1).all()


def test_levels_hot_group_nulls_and_clashes(spark, docs_of):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(900)] + [(2000 + i, "copy " * 30) for i in range(450)]
    rows += [(5, None), (5, None), (None, ""), (7, "same"), (7, "same")]
    df = docs_of(rows).selectExpr("*", "9 AS shard", "8 AS SLOT", "7 AS rid").coalesce(2)
    out = Sharding(shards=8, cell=64, fan=3, rows_per_cell=20).shard(df)
    assert out.columns[:8] == df.columns and len(out.columns) == 10
    got = out.toPandas()
    assert len(got) == len(rows) and got["doc_id"].isna().sum() == 1
    shard, slot = out.columns[8:]
    got["size"] = [len((t or "").encode()) + OVERHEAD for t in got["text"]]
    total = got.groupby(shard)["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 0.05 * total.mean()  # also with a third of the bytes in one group
    assert all(sorted(g[slot]) == list(range(len(g))) for _, g in got.groupby(shard))
    assert Sharding(shards=4).shard(df.limit(0)).count() == 0
    one = Sharding(shards=4).shard(docs_of(["only"])).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_no_row_is_lost_when_the_files_are_split_anew(spark, docs_of, save, monkeypatch):
    """A lost or added executor changes how files are split, also between two readings of one plan."""
    path = save(documents=docs_of([(i, f"text {i} " * 5) for i in range(3000)]).repartition(4)) + "/documents.parquet"
    key = "spark.sql.files.minPartitionNum"
    assign = Sharding.assign

    def moved(self, rows):
        put = assign(self, rows)
        spark.conf.set(key, "64")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        return put

    monkeypatch.setattr(Sharding, "assign", moved)
    try:
        spark.conf.set(key, "1")
        out = Sharding(shards=8, cell=64).shard(spark.read.parquet(path))
        got = out.toPandas()
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got["doc_id"]) == list(range(3000))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
