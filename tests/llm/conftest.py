import pytest

from indicata.llm.common import importable


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    importable(spark)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long_ = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] for i in range(150_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 44, "x"),
        (2, None, "en", "s", None, "x"),
        (3, "", None, None, 0, None),
        (4, " \n\t ", "en", "s", 4, "x"),
        (5, long_, "en", "s", len(long_), "x"),
        (6, "12345 !!", "de", "s", 8, "x"),
        (7, "Le renard brun saute par dessus le chien paresseux.", "fr", "s", 51, "x"),
        (7, "Le renard brun saute par dessus le chien paresseux.", "fr", "s", 51, "x"),
        (None, "The quick brown fox jumps over the lazy dog.", None, "s", 44, "x"),
        (8, "The quick brown fox jumps over the lazy dog.", "en", "s", 44, "y"),
        (9, "née \U0001f642 漢字 mail a.b@c.example.org or +1 (555) 555-1234", "en", "s", 50, "y"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, Lang_Pred string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
