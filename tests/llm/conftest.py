import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) or (id, text, lang) or full rows."""

    def make(rows, partitions=3):
        full = [tuple(r) + (("en", "s", len(r[1] or "")) if len(r) == 2 else ("s", len(r[1] or "")) if len(r) == 3 else ()) for r in rows]
        return spark.createDataFrame(full, FIELDS).repartition(partitions)

    return make


#: names that operators use inside or return
CLASHES = ["score", "lang_pred", "language", "ids", "block", "shard", "slot", "node", "component_id", "kept", "licence", "judged", "toxic_score", "key", "size", "words", "n", "_keep_id"]


@pytest.fixture(scope="session")
def with_clashes():
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
