import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]) as a table of documents over several partitions, with clashing extra columns."""
    def make(rows, extra=False, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(partitions)
        if extra:
            df = df.selectExpr("*", "'x' AS shard", "'y' AS id", "1 AS n", "'z' AS doc", "2.5 AS size", "'k' AS key", "array(1) AS spans")
        return df
    return make


@pytest.fixture
def prose():
    """prose(seed, words): invented text, the same for a seed."""
    import random

    def make(seed, n, vocabulary=4000):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
        return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)
    return make
