import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("n", T.StringType()), T.StructField("h", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("shard", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text[, lang]) with the columns of `documents` and clashing ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "y", "z", "q", "w") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def tokenizers():
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
