import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, name string, key string, level int, pos long, component_id long, slot long, doc_id_key long, copy int, text_sha256 string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    texts = [
        "the cat sat on the mat and looked at the dog. " * 3, "the cat sat on the mat and looked at the dog. " * 3, "", None, "   \n\t ", "one", "one two", "é ß 日本 ñandú", "x" * 9000, "word " * 40_000, "12345 67890 !!!",
        "the cat sat on the mat and looked at the dog. " * 3 + "end", "ÀB cd EF" * 600, "x <|endoftext|> y",
    ]
    rows = [(i, t, "en" if i % 2 else None, None, None, "r", "n", "k", 1, 2, 3, 4, 5, 6, "s", "w") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "one", *[None] * 14), (5, "other text of the same id", "fr", "s", 1, "", "", "", 0, 0, 0, 0, 0, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
