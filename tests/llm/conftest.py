import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from a list of texts, or of (doc_id, text[, lang, source])."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            d, t, lang, source = (*r, *("en", "src0")[len(r) - 2:])[:4]
            full.append((d, t, lang, source, len(t) if t is not None else None))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def save(tmp_path_factory):
    """Writes tables into a folder as a query reads them."""

    def put(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(str(path / f"{name}.parquet"))
        return str(path)

    return put


def sample(spark, sf="/root/testdata/sf0.001", n=None):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    return rows if n is None else rows[:n]
