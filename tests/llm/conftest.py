import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids long, size long, shard int, fingerprint string, token string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named like results."""
    long = "ab cd éf " * 30_000
    texts = [None, "", "   ", "a", "one two three four five", "one two three four five", long, long + "x", "  a  b \n\n c\t", "it's <|im_end|> we'll 42 ok.", "x" * 5_000, "日本語 テキスト über"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", 7, 1, 2, 3, "f", "t") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here at all", "en", "src0", None, None, None, None, None, None), (-5, "one two three four five", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
