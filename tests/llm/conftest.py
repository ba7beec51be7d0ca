import os

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return made


@pytest.fixture
def frame(spark):
    """A table from rows, with extra columns whose names clash with those of the operators."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for name in ("pos", "line", "h1", "seed", "n", "part", "rank", "key", "component", "block", "kept_text", "score", "rule"):
            if name not in df.columns:
                df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def tokenizer():
    found = os.environ.get("TOKENIZER_FILE")
    if not found:
        found = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return found
