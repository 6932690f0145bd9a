import pytest
from pyspark.sql import types as T

from studbook.llm.queries import on_workers


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) rows, in a few partitions."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

    def build(rows, partitions=3):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)
    return build


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]
