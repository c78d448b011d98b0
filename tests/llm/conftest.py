import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, kept boolean, node bigint, digest string"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "!!! ... ###", "en", "a", 11),
        (5, "One two three four five six seven eight nine ten eleven twelve.", "en", "b", 64),
        (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "b", 64),
        (7, "one, two three four five six seven eight nine ten eleven thirteen", None, "b", 64),
        (8, LONG, "en", None, len(LONG)), (8, LONG, "en", None, len(LONG)), (None, "a row without an id", "en", "c", 19),
        (-9, "Größe über alles: naïve café, é ½ 漢字 \U0001f389", "de", "c", 40), (10, "a" * 5000, "fr", "d", 5000),
    ]
    return spark.createDataFrame([(*r, 0.5, "xx", True, 7, "z") for r in rows], DOCUMENT)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
