import datetime

import pytest
from odd_texts import TEXTS
from pyspark.sql import types as T

CLASHING = ("row", "key", "keep_id", "label", "token", "part", "score", "kept", "words", "url")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns of clashing names."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(name, T.DateType()) for name in CLASHING],
        ]
    )
    day = datetime.date(2020, 1, 1)
    rows = [(i, t, lang, None, None, *[day] * len(CLASHING)) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def texts(spark, folder):
    """(doc_id, text) of the test documents."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}
