import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, Doc int, key string"


def _doc(i, text, source="a"):
    return (i, text, "en", source, 0 if text is None else len(text), "s", 1, "k")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        _doc(1, "one two three four five six seven eight nine ten eleven twelve"),
        _doc(1, "one two three four five six seven eight nine ten eleven twelve"),
        _doc(2, "one two three four five six seven eight nine ten eleven TWELVE", "b"),
        _doc(3, None, None),
        _doc(4, ""),
        _doc(5, " \t\n "),
        _doc(6, long, "b"),
        _doc(7, "a"),
        _doc(1, "another text under the same id, quite unlike the first one."),
        _doc(None, "a text without an id that stands alone in this small table"),
        _doc(None, None),
        _doc(8, "é ü 漢字 😀 mixed\nlines  and   spaces", None),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
