from collections import Counter

import corpus_pipeline
from trustframe.llm import queries
from trustframe.llm.decontaminate import Decontaminator
from trustframe.llm.neardup import MinHashDedup
from trustframe.llm.toxicity import ToxicPassages

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import draws
from tests.llm.test_neardup import brute as classes

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    # toxicity: what the model says of each document (its own parts are tested by themselves)
    op = ToxicPassages()
    scored = op.passages(docs, op.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")), ["doc_id"])
    kept = {r["doc_id"] for r in scored.filter("score < 0.5").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    # near-duplicates, then benchmark items, by brute force
    stay = {d for d, _, _, k in classes([(d, r["text"]) for d, r in rows.items()], 5, 80) if k}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = [(d, rows[d]["text"]) for d in sorted(stay)]
    leaked = {left[m[0]][0] for m in leaks(left, items)}
    final = [d for d, _ in left if d not in leaked]
    # Poisson draws at each source's rate
    size = Counter()
    for d in final:
        size[rows[d]["source"]] += max(1, len((rows[d]["text"] or "").encode()))
    weight = {s: b ** 0.7 for s, b in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / b for s, b in size.items()}
    want = {d: n for d in final if (n := draws(d, rate[rows[d]["source"]]))}
    out = got.toPandas()
    assert out.groupby("doc_id").size().to_dict() == want
    assert all(t == rows[d]["text"] for d, t in zip(out["doc_id"], out["text"]))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_stages_on_nulls_and_empty(spark, docs_of):
    df = docs_of([(None, None, None, None), (1, "", None, "s"), (1, "", None, "s"), (2, "some words here", "en", None)]).selectExpr("*", "1 AS shard_", "2 AS score")
    for name, stage in corpus_pipeline.STAGES:
        for part in (df, df.limit(0)):
            out = stage(spark, part, SF)
            assert out.columns[:len(df.columns)] == df.columns, name
            out.collect()


def test_registered():
    assert {"pipeline", *(f"op{i}_" for i in range(1, 11))} <= {q if q == "pipeline" else q.split("_")[0] + "_" for q in queries.QUERIES}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert MinHashDedup().words == 5 and Decontaminator().percent == 80
