import pytest

#: Columns that documents may carry beside their own, with names that the operators use inside.
EXTRA = ["gram", "keep", "score", "fp", "component", "ids", "h1", "n_words", "spans", "key", "order", "shard"]


@pytest.fixture(scope="session")
def documents(spark):
    """Make documents (doc_id, text) with extra columns of clashing names."""

    def make(rows):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in EXTRA])

    return make


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(documents):
    """Null, empty, blank, very long and repeated texts, a null id and a repeated row."""
    shared = "this very line stands in several documents"
    return documents([
        (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, LONG), (6, f"{shared}\nown line of six is here now"), (7, f"  {shared.upper()} \nß"), (8, shared),
        (8, shared), (None, f"{shared}\n\n"), (9, "kurz"), (10, "日本語 é \U0001f600 text\r\nmore"), (11, "a" * 700),
    ])
