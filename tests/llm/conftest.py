import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with the odd cases: null, blank, short, long, repeated, tied and clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = [f"t{i}" for i in range(60)]
    near = [*base[:30], "changed", *base[31:]]
    rows = [
        (1, " ".join(base), "en", "a", 9), (2, " ".join(base), "en", "a", 9), (3, " ".join(near), "en", "b", 9), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, "  \n\t ", "en", "a", 5), (7, "one two", "en", "a", 7), (8, "one  two", "en", "a", 7), (9, long, "en", "a", 1), (10, "é ß 世 \U0001f600 ␛ </s>", "fr", "b", 1),
        (None, "no id here at all", "en", "c", 1), (1, " ".join(base), "en", "a", 9), (11, " ".join(reversed(base)), "de", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("kept", "host", "score", "ids", "spans", "k1", "label", "band", "rank")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
