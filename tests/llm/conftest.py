import pytest

#: Documents with nulls everywhere, empty and long texts, ties, repeated rows and a clashing extra column.
LONG = " ".join(f"word{k % 977} the" for k in range(20_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog over there", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog over there", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog over there", "en", "b"),
    (3, "le chat est sur la table et regarde le chien dans la cour", "fr", "b"),
    (4, "", "en", None),
    (5, None, None, "a"),
    (6, "one two", "en", "a"),
    (7, "ONE\ttwo", "en", "c"),
    (8, LONG, "en", "c"),
    (9, "12 34 !!", None, "c"),
    (None, "no id at all", "en", "c"),
    (10, "\u4f60\u597d \u4e16\u754c \x1c \u0130stanbul e\u0301 <|endoftext|> x", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, Score string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
