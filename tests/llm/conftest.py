import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words, repeated by no other seed's order."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 3)) % 24]}{(seed + i * i) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""
    long = prose(1, 4000)
    near = prose(2, 200)
    rows = [
        (1, long, "en", "a", 10),
        (2, near, "en", "a", 10),
        (3, near.replace("alpha", "other", 1), None, "a", None),
        (4, near.upper(), "fr", None, 5),
        (5, None, None, None, None),
        (6, "", "de", "b", 0),
        (7, " \t\n ", "de", "b", 3),
        (8, "one", "de", "b", 3),
        (8, "one", "de", "b", 3),
        (8, "other", "de", "b", 5),
        (None, "one", "de", "b", 3),
        (None, None, None, None, None),
        (9, "the end <|endoftext|> Straße ÉCOLE ΣΑΣ \x1c x", "xx", "c", 1),
        (10, "x" * 3000 + " y", "xx", "c", 1),
        (11, "a b c a b c a b c\nline two\nline two\n\nline two", "xx", "c", 1),
        *[(100 + i, prose(50, 120), "en", "hot", 700) for i in range(30)],
        *[(200 + i, prose(60 + i, 80), "en", "a", 500) for i in range(20)],
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", "1 AS key", "2 AS row", "3 AS node", "4 AS label", "5 AS kept", "'6' AS q_words", "7 AS _key", "8 AS k_quality", "9 AS n", "10 AS words", "11 AS rest_columns")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(200 + i, i % 2, 0) for i in range(20)] + [(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
