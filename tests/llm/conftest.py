import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    a, b, passage = prose(80), prose(70), prose(30)
    rows = [
        (1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b + " " + passage, None, None, None), (4, None, "en", "s", 0), (5, "", "en", "s", 0),
        (None, a, "en", "s", 1), (None, prose(40), "en", "s", 1), (6, "one", "en", "s", 3), (7, prose(9000) + "\n" + passage, "en", "s", 5), (8, passage + "  \t" + prose(20), "en", "s", 5),
        (9, "x" * 60_000, "en", "s", 5), (10, "\n \n", "en", "s", 5), (11, a.replace(a.split()[3], "zz", 1), "en", "s", 5), (12, "w " * 400, "en", "s", 5), (12, prose(50), "en", "s", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS fp", "2 AS h", "3 AS n_words", "4 AS spans", "5 AS f0", "'x' AS component_id", "6 AS ids").repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
