"""The local surrogate's query against brute force."""
import numpy as np

from trustframe.plans.catalog import QUERIES, load_all
from trustframe.sources import workloads as W

SF001 = "/root/testdata/sf0.001"


def brute(x, n_perturb, rng):
    """Mean |coefficient| of each feature over ridge fits around every row, with draws of its own."""
    std, width, total = x.std(0, ddof=1), 0.75 * 2 ** 0.5, np.zeros(2)
    for row in x:
        z = rng.standard_normal((n_perturb, 2))
        z[0] = 0
        at = row + z * std
        y = ((at[:, 0] > 200000) & (at[:, 1] > 5000)).astype(float)
        w = np.exp(-(z ** 2).sum(1) / width ** 2)
        a = np.column_stack([np.ones(n_perturb), z])
        total += abs(np.linalg.solve(a.T @ (a * w[:, None]) + np.diag([0, 1, 1]), a.T @ (w * y))[1:])
    return total / len(x)


def test_query_fits_a_thousand_perturbations_a_row(spark):
    load_all()
    x = W.orders_dataset(spark, SF001).select("o_totalprice", "c_acctbal").toPandas().to_numpy(float)
    want = brute(x, 1000, np.random.default_rng(1))
    got = {r["feature"]: r["importance"] for r in QUERIES["attribution_local_surrogate"](spark, SF001).collect()}
    np.testing.assert_allclose([got["o_totalprice"], got["c_acctbal"]], want, rtol=0.015)


def test_null_model_values_and_one_matrix_for_all_rows(spark):
    from pyspark.sql import functions as F

    from trustframe.operators.attribution import local_surrogate, surrogate_fit
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 4.0, -1.0), (None, 0.5, 0.0)], "_c0 long, a double, b double")
    model = lambda x: F.when(x["a"].isNotNull(), x["a"] * x["b"])
    rows = local_surrogate(df, "_c0", ["a", "b"], model, n_perturb=50)
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # not summed draw by draw
    got = {(r["_c0"], r["feature"]): r["coefficient"] for r in rows.collect()}
    assert got[2, "a"] is None and got[2, "b"] is None
    z, g = (np.array(x) for x in surrogate_fit(2, 50))
    s = np.array([np.std([1.0, 4.0, 0.5], ddof=1), np.std([2.0, 3.0, -1.0, 0.0], ddof=1)])
    for i, at in ((1, (1.0, 2.0)), (3, (4.0, -1.0)), (None, (0.5, 0.0))):
        y = (at[0] + z[:, 0] * s[0]) * (at[1] + z[:, 1] * s[1])
        np.testing.assert_allclose([got[i, "a"], got[i, "b"]], y @ g, rtol=1e-9)
