import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(pairs):
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in pairs]


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text) pairs, with columns whose names clash with those of the operators."""

    def make(pairs, **extra):
        df = spark.createDataFrame(rows_of(pairs), SCHEMA)
        return df.repartition(3) if len(pairs) > 3 else df

    return make


@pytest.fixture
def clash(docs):
    from pyspark.sql import functions as F

    names = ("doc", "fp", "key", "hash", "score", "size", "spans", "state", "start", "row_number", "predicted", "drop", "place", "regions", "statistics", "component_id", "n_lines")

    def make(pairs):
        return docs(pairs).select("*", *[F.lit("x").alias(n) for n in names])

    return make


@pytest.fixture
def prose():
    """Random prose: n words from a small vocabulary, so that chance repeats happen."""

    def make(seed, n, vocabulary=2000):
        rng = np.random.default_rng(seed)
        return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))

    return make


#: Nulls, empty and blank texts, one very long one, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (None, None), (5, "x " * 200_000), (6, "A b\nC d\n" * 3), (7, "éß 中文 \U0001f600"), (8, "\n\n\n")]


@pytest.fixture
def odd():
    return ODD
