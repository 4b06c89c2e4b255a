"""Datasets written, registered and read back through the registry."""
import pytest
from pyspark.sql import functions as F

from trustframe.sources.registered import export_datasets, plain_path, profile, read_owned, read_registered


def rows(spark):
    return spark.createDataFrame([("a b/c", 1, "N/A", 1.5), ("a b/c", 2, "x,\"y\"", None), ("Ö#1+%", 3, "", 2.0), (None, 4, "z", 3.0)],
                                 "id string, n long, t string, v double")


def test_paths_lose_scheme_host_and_escapes(spark):
    got = spark.createDataFrame([("file:///a%20b/c+d",), ("hdfs://h:9/x%23y",), ("/p/q",)], "p string").select(plain_path(F.col("p")).alias("p"))
    assert [r["p"] for r in got.collect()] == ["/a b/c+d", "/x#y", "/p/q"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip_of_many_datasets_in_one_read(spark, fmt):
    registry = export_datasets(rows(spark), "id", F.lit(7), fmt)
    assert registry.count() == 3
    kinds = read_registered(spark, registry)
    assert len(kinds) == 1 and kinds[0][0] == ["n", "t", "v"]
    got = {(r["_id"], r["n"]): (r["t"], r["v"]) for r in kinds[0][1].collect()}
    missing = (lambda t: None if fmt == "csv" and t in ("N/A", "") else t)
    assert got == {("a b/c", 1): (missing("N/A"), 1.5), ("a b/c", 2): ('x,"y"', None), ("Ö#1+%", 3): (missing(""), 2.0), ("-", 4): ("z", 3.0)}
    assert dict(kinds[0][1].dtypes)["n"] == "bigint" and dict(kinds[0][1].dtypes)["v"] == "double"
    p = {r["dataset_id"]: r for r in profile(*kinds[0]).collect()}
    assert p["a b/c"]["null_count"] == (2 if fmt == "csv" else 1) and p["a b/c"]["target"] == "v" and p["a b/c"]["features"] == "n,t"
    assert p["-"]["target_total"] == 3.0


def test_only_the_owner_reads_a_dataset(spark):
    registry = export_datasets(rows(spark), "id", F.col("n") * 0 + F.when(F.col("id") == "a b/c", 1).otherwise(2), "csv")
    assert sorted(r["n"] for r in read_owned(spark, registry, "a b/c", 1).collect()) == [1, 2]
    with pytest.raises(LookupError):
        read_owned(spark, registry, "a b/c", 2)
    assert read_registered(spark, registry.limit(0)) == []


def test_a_file_as_a_dataset_and_a_wrong_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("n,v\n1,2\n3,NA\n")
    (tmp_path / "two.csv").write_text("n,v\n5,6\n")
    schema = "dataset_id string, user_id long, location string, format string, columns array<string>"
    reg = spark.createDataFrame([("one", 1, f"{tmp_path}/one.csv", "csv", ["n", "v"]), ("two", 1, f"{tmp_path}/two.csv", "csv", ["n", "v"])], schema)
    (_, data), = read_registered(spark, reg)
    assert {tuple(r) for r in data.collect()} == {("one", 1, 2), ("one", 3, None), ("two", 5, 6)}
    wrong = spark.createDataFrame([("one", 1, f"{tmp_path}/one.csv", "csv", ["n", "w"])], schema)
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_registered(spark, wrong)
